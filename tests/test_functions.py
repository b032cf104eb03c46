"""Golden urls and the streaming index."""

import html

import pytest
from pyspark.sql import functions as F

from weftspark.functions import markup, urls
from weftspark.operators import frontier, graph, index
from weftspark.sources import store
from weftspark.streaming import ingest, runs

NORMAL = [
    ("HTTP://WWW.Fjord.TEST/Map/North/", "http://fjord.test/Map/North"),
    ("https://fjord.test/list?gclid=77&zone=4&UTM_Term=x", "https://fjord.test/list?zone=4"),
    ("https://fjord.test/list#end", "https://fjord.test/list"),
    ("gopher://fjord.test/list", None),
    ("https://www.fjord.test/", "https://fjord.test"),
    ("https://fjord.test/l?z=1&k=2&z=0", "https://fjord.test/l?k=2&z=1&z=0"),
    ("https://fjord.test:8443/l?on", "https://fjord.test:8443/l?on="),
    ("https://me:pw@fjord.test/two%20words?q=a%7Eb%2A", "https://fjord.test/two words?q=a~b%2A"),
    ("fjord.test/list", None),
    ("https:///list", None),
    (None, None),
]


@pytest.mark.parametrize("raw,want", NORMAL)
def test_normalize(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "u string")
    assert df.select(urls.normalize_url(F.col("u"))).first()[0] == want


def test_strip_and_allow(spark):
    df = spark.createDataFrame([("ftp://fjord.test/a?b=c#d",), ("http://www.Elm.test:81/q",), ("http://sub.elm.test/x",), ("elm.test",)], "u string")
    assert [r[0] for r in df.select(urls.strip_url(F.col("u"))).collect()] == ["ftp://fjord.test/a?b=c", "http://www.Elm.test:81/q", "http://sub.elm.test/x", None]
    own = urls.allowed_domains(F.lit(" Elm.test.,,fjord.test:80,www.elm.test, "))
    assert [r[0] for r in df.select(urls.is_allowed(F.col("u"), own)).collect()] == [True, True, False, None]
    assert spark.range(1).select(own).first()[0] == ["elm.test", "fjord.test"]
    none = urls.allowed_domains(F.lit(" ,"))
    assert [r[0] for r in df.select(urls.is_allowed(F.col("u"), none)).collect()] == [True] * 4


def test_seed(spark):
    assert frontier.seed(spark, "https://www.elm.test/a/", ["elm.test"]).collect() == [("https://elm.test/a", 0.0)]
    with pytest.raises(ValueError):
        frontier.seed(spark, "https://oak.test/", ["elm.test"])


def test_references(spark):
    cases = ["&eacute;&Eacute;", "&#233;&#xe9;&#XE9", "&amp;lt;&lt;", "&#38;lt;", "&nosuch;&;&#;&", "&#150;&#0;&#xD800;&#1114112;", "&NotEqualTilde;&#128512;", "plain", ""]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "t string").select(markup.decode(F.col("t"))).collect()]
    assert got == [html.unescape(c) for c in cases]


def test_paragraphs_without_any(spark):
    df = spark.createDataFrame([(None,), ("",), ("<p>",), ("<p>a<p>&lt;p&gt; [1]b",)], "h string")
    assert [r[0] for r in df.select(markup.paragraphs(F.col("h"))).collect()] == [[], [], [""], ["a", "<p> b"]]


def test_hubs_get_several_arrays(spark):
    e = spark.createDataFrame([(f"s{i:03}", "hub") for i in range(250)] + [("s001", "leaf")], "src string, dst string")
    got = graph.backlinks(e, 40).collect()
    assert max(len(r.links) for r in got) < 80 and sorted(x for r in got if r.url == "hub" for x in r.links) == [f"s{i:03}" for i in range(250)]
    assert [(r.part, r.links) for r in got if r.url == "leaf"] == [(0, ["s001"])]


def test_filters_do_not_copy_expressions(spark):
    pages = spark.createDataFrame([("https://elm.test/a", "<p>the words of a page</p>")], "url string, html string")
    plan = index.postings(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("('s|'re|'ve|'ll|'d|'m|n't)") <= 2  # the sample's words and the text's


def test_numbers_go_on_across_ranges(spark):
    rows = [("hot", i) for i in range(500)] + [(None, 7), (None, 3), ("b", 1)]
    df = spark.createDataFrame(rows, "host string, at int").repartition(7)
    got = {(r.host, r.at): r.n for r in store.numbered(df, "host", "at", "n").collect()}
    assert got == {**{("hot", i): i for i in range(500)}, (None, 3): 0, (None, 7): 1, ("b", 1): 0}


def test_boost(spark):
    text = "<p>Sailing needs wind and a boat for sailing.</p><p>The boat [2] of wood: well-built. Sailing!</p>"
    p = spark.createDataFrame([("https://harbour.test/sailing-boat/sailing", text)], "url string, html string")
    tf = {r.word: r.tf for r in index.postings(p).collect()}
    assert tf["sailing"] == 3 * 50 * 50 and tf["boat"] == 2 * 50 and tf["wind"] == 1
    assert tf["https"] == tf["harbour"] == tf["test"] == 10
    assert "well" not in tf and "2" not in tf and "the" not in tf


def test_stream_equals_batch(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("url", "html").dropDuplicates(["url"])
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    kept = runs.KeptIndex(spark, str(tmp_path / "out"), fan=2)
    q = runs.index_stream(ingest.page_stream(spark, str(tmp_path / "in"), pages.schema, 1), kept, str(tmp_path / "cp"))
    q.awaitTermination(120)
    a = {tuple(r) for r in kept.postings().select("word", "url", "tf").collect()}
    b = {tuple(r) for r in index.postings(pages).select("word", "url", "tf").collect()}
    assert a == b


def test_rules_by_prefix_keys_equal_prefix_tests(spark):
    from weftspark.operators import policy

    paths = ["/", "/a", "/a/b", "/ab", "/a/b/c", "/a//b", "/b/a", "/é/ü", "/a/b/c/d/e/f/g", "//", "/A/b"]
    prefixes = ["/", "/a", "/a/", "/a/b", "/a/b/", "/ab", "/a//", "/a//b", "/é", "/b/a/", "/a/b/c/d", "/c"]
    table = spark.createDataFrame([(h, i, p, i % 2 == 0, float(i), p) for h in ("x.test", "y.test") for i, p in enumerate(prefixes) if h == "x.test" or i % 3], policy.RULE)
    rows = spark.createDataFrame([(h, p) for h in ("x.test", "y.test", "z.test", None) for p in [*paths, None]], "h string, p string")
    got = {(r.h, r.p): r.rule and r.rule.reason for r in policy.with_rules(rows, "h", "p", table, "rule").collect()}
    holds = lambda path, p: p == "/" or (path.startswith(p) if p.endswith("/") else path == p or path.startswith(p + "/"))
    for (h, path), reason in got.items():
        own = [p for i, p in enumerate(prefixes) if h == "x.test" or h == "y.test" and i % 3]
        assert reason == (None if path is None else next((p for p in own if holds(path, p)), None)), (h, path)
    assert len(got) == 4 * (len(paths) + 1)
    assert policy.with_rules(rows, "h", "p", table.limit(0), "rule").filter("rule is not null").count() == 0


def test_fixed_rules_as_a_table_decide_alike(spark):
    from weftspark.operators import policy

    urls_ = [f"https://{h}{p}" for h in ("github.com", "stackoverflow.com", "kubernetes.io") for p in ("", "/login", "/login/x", "/loginless", "/users/ada", "/users/login", "/questions/tagged/x", "/questions/8", "/a/b/blob/m", "/topics/x", "/a/b")]
    df = spark.createDataFrame([(u,) for u in [*urls_, "nohost", None]], "u string")
    none = F.array().cast("array<string>")
    a = {(r.u, str(r.d)) for r in policy.decide(df, "u", none).collect()}
    b = {(r.u, str(r.d)) for r in policy.decide(df, "u", none, table=policy.rules(spark)).collect()}
    assert a == b


def test_starts_of_requests_at_their_own_times(spark):
    import random

    from weftspark.operators import robots

    r = random.Random(2)
    rows = [(i, r.choice(["hot", "hot", "hot", "a", None]), float(r.randrange(0, 4000))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, host string, at double").repartition(7)
    got = {x.id: x.start_s for x in robots.schedule(df, "id", 0.5, arrival="at").collect()}
    last, want = {}, {}
    for i, host, at in sorted(rows, key=lambda x: (x[2], x[0])):
        want[i] = last[host] = max(at, last[host] + 2.0) if host in last else at
    assert got == want
