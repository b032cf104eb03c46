"""Kept state: bucketed logs, keyed frontier, block search and merged runs, against plain versions and their plans."""

import random
import threading
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftspark.operators import blocks, frontier, index, ranks, search
from weftspark.sources import store
from weftspark.sources.log import BucketedLog
from weftspark.streaming import ingest, keyed, runs


@pytest.fixture
def unbroadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- logs


def test_logs_are_joined_without_a_shuffle(spark, unbroadcast):
    a, b = (BucketedLog(spark, "url string, score double", "url", 4) for _ in range(2))
    for k in range(3):
        a.append(spark.range(50 * k, 50 * k + 50).select(F.concat(F.lit("u"), "id").alias("url"), F.col("id").cast("double").alias("score")))
    b.append(spark.range(0, 150, 7).select(F.concat(F.lit("u"), "id").alias("url"), F.lit(0.0).alias("score")))
    left = a.read().groupBy("url").agg(F.min("score").alias("score")).join(b.read().select("url"), "url", "left_anti")
    assert "Exchange" not in plan_of(left) and left.count() == 150 - 22
    a.compact()
    after = a.read().groupBy("url").agg(F.min("score").alias("score"))
    assert "Exchange" not in plan_of(after) and after.count() == 150
    assert len([n for n in store.names(spark, a.path) if n.startswith("part")]) <= 4
    a.close(), b.close()
    assert store.names(spark, a.path) == []


def test_a_round_writes_its_own_urls_only(spark, unbroadcast):
    page = lambda k: f'<a href="/{2 * k}">a</a><a href="/{2 * k + 1}">b</a><a href="/1">up</a>'
    site = spark.createDataFrame([(f"https://s.test/{k}", page(k)) for k in range(1, 64)], "url string, html string")
    c = frontier.Crawl(frontier.seed(spark, "https://s.test/1", ["s.test"]), buckets=4, compact_after=3)
    none = F.array().cast("array<string>")
    for k in range(4):
        before = c.visited.read().count(), c.found.read().count()
        c.round(site, none, n=8)
        grown = c.visited.read().count() - before[0], c.found.read().count() - before[1]
        assert grown == (min(2**k, 8), 2 * min(2**k, 8) + 1)
    assert plan_of(c.frontier()).count("Exchange") == 0
    popped = {(r.url, r.score, r.round) for r in c.popped().collect()}
    assert popped == {(f"https://s.test/{k}", float(k.bit_length() - 1), k.bit_length() - 1) for k in range(1, 16)} and c.visited.appended == 2


# ---------------------------------------------------------------- keyed frontier


def plain_frontier(rows, keep_ms, end):
    """Popped (url, score, ms) from candidates (url, score, ms) by the definition."""
    out, now = [], {}
    for url, score, at in sorted(rows, key=lambda r: (r[2], r[1])):
        due = at + int(max(score, 0) * 3_600_000)
        e = now.get(url)
        if e and e[2] is None and at > e[1]:
            out.append((url, e[0], e[1]))
            e = now[url] = (e[0], e[1], float("inf") if keep_ms is None else e[1] + keep_ms)
        if e and e[2] is not None and at <= e[2]:
            continue
        now[url] = (min(e[0], score), min(e[1], due), None) if e and e[2] is None else (score, due, None)
    return sorted(out + [(u, s, due) for u, (s, due, until) in now.items() if until is None and due <= end])


@pytest.mark.parametrize("keep_hours", [None, 5])
def test_keyed_frontier_over_restarts(spark, tmp_path, keep_hours):
    r, start = random.Random(4), datetime(2024, 3, 1)
    rows = sorted(((f"u{r.randrange(12)}", r.choice([-1.0, 0.0, 0.5, 1.0, 3.25]), start + timedelta(seconds=r.randrange(200_000))) for _ in range(150)), key=lambda x: x[2])
    schema, got = "url string, score double, ts timestamp", None
    for k in range(3):
        part = [*rows[50 * k : 50 * k + 50], (None, 1.0, rows[50 * k][2]), ("u1", None, rows[50 * k][2])]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        keyed.run(keyed.frontier(stream, keep_hours=keep_hours), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        got = sorted((x.url, x.score, x.ms) for x in spark.read.schema(keyed.POPPED).parquet(str(tmp_path / "out")).select("url", "score", F.unix_millis("popped_at").alias("ms")).collect())
        ms = [(u, s, int(t.timestamp() * 1000)) for u, s, t in rows[: 50 * k + 50]]
        assert got == plain_frontier(ms, keep_hours and keep_hours * 3_600_000, ms[-1][2])
    assert len(got) > 12 if keep_hours else len({u for u, _, _ in got}) == len(got)


# ---------------------------------------------------------------- block search


def test_block_search_reads_few_blocks_and_finds_the_same(spark, tmp_path):
    r = random.Random(7)
    rows = [(w, f"p{p:04d}", max(1, int(r.paretovariate(0.6)) if p % 9 else 3)) for p in range(1500) for w in r.sample(["red", "green", "blue", "rare", "common"], 3) if w != "rare" or p % 50 == 0]
    words = spark.createDataFrame(rows, "word string, url string, tf long").coalesce(2)
    ranks = spark.createDataFrame([(f"p{p:04d}", p / 100) for p in range(0, 1500, 3)], "url string, rank double")
    at = str(tmp_path / "i")
    blocks.write(words, at, ranks=ranks, stripe=16)
    for query, k, share in (("red green", 10, 0.0), ("blue", 5, 0.0), ("Common rare nothing", 20, 0.0), ("green", 7, 2.0), ("red blue", 2000, 0.5), ("nothing", 5, 0.0), ("red", 0, 0.0)):
        got, did = blocks.search(spark, at, query, k, share, first=2)
        want = search.search(words, query, k, ranks=ranks if share else None, share=share).collect()
        near = lambda rows: [(x.url, round(x.score, 9), x.terms) for x in rows]
        assert near(got.collect()) == near(want), query
        assert did.read <= did.blocks
        if query in ("red green", "blue", "green"):
            assert did.read < did.blocks / 2, (query, did)
    blocks.write(words.limit(0), str(tmp_path / "e"))
    assert blocks.search(spark, str(tmp_path / "e"), "red")[0].count() == 0


def test_equal_scores_go_by_url(spark, tmp_path):
    words = spark.createDataFrame([("a", f"p{p:03d}", 1) for p in range(200)] + [("b", "q", 5)], "word string, url string, tf long")
    blocks.write(words, str(tmp_path / "i"), stripe=8)
    got, _ = blocks.search(spark, str(tmp_path / "i"), "a", 5, first=1)
    assert [r.url for r in got.collect()] == [f"p{p:03d}" for p in range(5)]


# ---------------------------------------------------------------- merged runs


def english(words):
    return f"<p>this is the and of it to {words}</p>"


def crawl(spark, rows):
    return spark.createDataFrame([(f"https://s.test/{u}", h) for u, h in rows], "url string, html string")


def has(kept):
    return sorted((r.url[-1], r.word) for r in kept.postings().collect() if r.word in ("red", "green", "blue"))


def test_runs_replace_pages_and_merge(spark, tmp_path):
    kept = runs.KeptIndex(spark, str(tmp_path / "i"), fan=3)
    assert kept.postings().count() == 0 and kept.metadata().count() == 0
    kept.add(crawl(spark, [("a", english("red")), ("b", english("green red"))]), "one")
    kept.add(crawl(spark, [("a", english("green"))]), "two")
    assert has(kept) == [("a", "green"), ("b", "green"), ("b", "red")]
    kept.add(crawl(spark, [("a", english("blue"))]), "two")  # again: left out
    assert has(kept) == [("a", "green"), ("b", "green"), ("b", "red")] and len(kept.manifest()["runs"]) == 2
    kept.add(crawl(spark, [("b", "<p>der die das und</p>"), ("c", english("blue"))]), "three")  # the third one: merged
    assert has(kept) == [("a", "green"), ("c", "blue")] and [r["level"] for r in kept.manifest()["runs"]] == [1]
    assert sorted(r.url[-1] for r in kept.metadata().collect()) == ["a", "c"]
    assert store.names(spark, str(tmp_path / "i" / "runs")) == [kept.manifest()["runs"][0]["name"]]
    files = kept.lookup(["blue"]).inputFiles()
    assert files and all(kept.manifest()["runs"][0]["name"] in f for f in files)
    kept.add(crawl(spark, [("c", english("red"))]), "four")
    kept.add(crawl(spark, []), "five")
    assert has(kept) == [("a", "green"), ("c", "red")] and [r["level"] for r in kept.manifest()["runs"]] == [1, 0, 0]
    kept.merge(1)  # rows that hide older ones stay
    assert has(kept) == [("a", "green"), ("c", "red")]
    assert sorted(r.url[-1] for r in kept.lookup(["blue", "red"]).collect()) == ["c"]


def test_a_second_writer_gets_a_conflict(spark, tmp_path):
    one, two = (runs.KeptIndex(spark, str(tmp_path / "i")) for _ in range(2))
    stale = two.manifest()
    one.add(crawl(spark, [("a", english("red"))]), "one")
    two.manifest = lambda: stale
    with pytest.raises(runs.Conflict):
        two.add(crawl(spark, [("a", english("green"))]), "other")
    assert has(one) == [("a", "red")]
    assert not [n for n in store.names(spark, str(tmp_path / "i" / "manifest")) if n.endswith("draft")]


# ---------------------------------------------------------------- ranks


def dense(edges, damping):
    urls = sorted({u for e in edges for u in e})
    at, n = {u: i for i, u in enumerate(urls)}, len(urls)
    walk = np.full((n, n), 1 / n)
    for u in {a for a, _ in edges}:
        out = [b for a, b in edges if a == u]
        walk[at[u]] = [out.count(v) / len(out) for v in urls]
    r = np.full(n, 1 / n)
    for _ in range(400):
        r = (1 - damping) / n + damping * r @ walk
    return dict(zip(urls, r))


def test_ranks_sum_to_one_and_follow_changes(spark):
    r = random.Random(3)
    edges = sorted({(f"p{a}", f"p{b}") for a, b in ((r.randrange(24), r.randrange(30)) for _ in range(70)) if a != b})
    frame = lambda es: spark.createDataFrame(es, "src string, dst string")
    same = lambda mass, es: {x.url: x["rank"] for x in ranks.ranks(mass).collect()} == pytest.approx(dense(es, 0.6), abs=1e-8)
    before = ranks.masses(frame(edges), 0.6)
    assert same(before, edges)
    chain = ranks.ranks(ranks.masses(frame([("a", "b"), ("b", "c")]))).collect()
    assert sum(x["rank"] for x in chain) == pytest.approx(1) and {x.url: x["rank"] for x in chain} == pytest.approx(dense([("a", "b"), ("b", "c")], 0.85))
    later = [e for e in edges if e[0] != "p3" and e != edges[5]] + [("p3", "p999"), ("q", "p1")]
    assert same(ranks.update(before, frame(edges), frame(later), 0.6), later)


def test_an_update_touches_only_what_it_reaches(spark):
    """Two parts without links between them: rows of the part that did not change are not sent again."""
    ring = lambda name: [(f"{name}{i}", f"{name}{(i + 1) % 9}") for i in range(9)]
    frame = lambda es: spark.createDataFrame(es, "src string, dst string")
    a, b = ring("a"), ring("b")
    before = ranks.masses(frame(a + b), 0.5)
    sent, spread = [], ranks.spread

    def watched(first, *rest):
        out = spread(first, *rest)
        sent.extend(x.url for x in out.collect())
        return out

    try:
        ranks.spread = watched
        ranks.update(before, frame(a + b), frame([*a, *b, ("a0", "a4")]), 0.5).count()
    finally:
        ranks.spread = spread
    assert sent and all(u.startswith("a") for u in sent)


# ---------------------------------------------------------------- queue


def test_a_producer_waits_at_the_mark_and_a_drain_loses_no_page(spark, tmp_path):
    schema, done, slow = "url string, html string", [], threading.Event()
    put_page = lambda k: spark.createDataFrame([(f"https://s.test/{k}", english(f"word{k}"))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    gate, kept = ingest.Gate(high=3), runs.KeptIndex(spark, str(tmp_path / "i"), fan=100)
    spark.streams.addListener(gate)
    try:
        for k in range(3):
            assert gate.wait(1, 0)
            put_page(k), gate.put(1)
        assert gate.waiting == 3 and not gate.wait(1, 0.2)  # the producer pauses at the mark

        def start(drain, before=lambda: None):
            stream = ingest.page_stream(spark, str(tmp_path / "in"), schema, max_files=1)
            add = kept.add
            kept.add = lambda *a: (before(), add(*a), done.append(a[1]))
            return runs.index_stream(gate.watch(stream), kept, str(tmp_path / "checkpoint"), drain=drain)

        drain = ingest.Drain()
        query = start(drain, lambda: slow.wait(60))
        stopper = threading.Timer(0.5, slow.set)
        time.sleep(3)  # the first batch is at hand
        stopper.start()
        drain.stop(query)
        assert not query.isActive and len(done) < 3
        first = len(kept.manifest()["batches"])
        assert first == len(done)
        del kept.add
        query = start(ingest.Drain())
        query.awaitTermination()
        assert gate.wait(3, 30) and gate.waiting == 0
        assert {r.word for r in kept.postings().collect() if r.word.startswith("word")} == {"word0", "word1", "word2"}
        assert len(kept.manifest()["batches"]) == 3
    finally:
        spark.streams.removeListener(gate)


# ---------------------------------------------------------------- small ones


def test_bodies_are_cut_at_characters(spark):
    body = "aéb€c😀d"
    rows = [(n, body, 200, "text/html") for n in range(20)] + [(0, None, 200, "text/html"), (1, "x", None, "text/html"), (1, "x", 200, None)]
    df = spark.createDataFrame(rows, "n int, html string, status_code int, content_type string")
    for most in range(16):
        got = [r.html for r in index.fetched(df.filter(f"n = {most}"), most).collect() if r.html is not None]
        assert got[:1] == [body.encode()[:most].decode(errors="ignore")]


def test_absent_rows_with_null_keys(spark):
    a = spark.createDataFrame([(None, 1), ("x", 1)], "k string, v int")
    new = spark.createDataFrame([(None, 2), ("x", 2), ("y", 4), ("y", 3)], "k string, v int")
    assert sorted(map(str, index.insert_absent(a, new, ["k"]).collect())) == sorted(map(str, [*a.collect(), *new.filter("v = 3").collect()]))


def test_staged_rows_are_deleted(spark):
    df = store.stage(spark.range(5), "x")
    assert df.count() == 5
    store.release(df, None, spark.range(1))
    assert store.names(spark, df.staged_at) == []


def test_a_page_of_open_quotes_is_read_in_linear_time(spark):
    from weftspark.functions import markup

    rows = [("<a " * 60_000,), ('<a href="' * 60_000,), ("<a" + " x='" * 60_000 + ">",), ("<!--" * 60_000,), ("<script " * 60_000,), ("<a " + 'b="c" ' * 60_000 + "href=/x>",)]
    began = time.time()
    got = [r[0] for r in spark.createDataFrame(rows, "html string").select(F.size(markup.shown(F.col("html")))).collect()]
    assert got[-1] == 1 and time.time() - began < 60
