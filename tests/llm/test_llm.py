"""The training-data operators against brute force on small inputs with nulls, empties, ties and repeats."""

import io
import zlib

import numpy as np
import pytest

from weftspark.llm import html_text, jaccard, mixing, neardup_vectors, packing, token_files, topk, toxicity, urlgraph, warc
from weftspark.llm.wordpieces import Encoder, tokenizer_path

ODD = ["", " ", "Hello, WORLD. don't", "J̌ İ  x\x1cy", "<|endoftext|> a <|ENDOFTEXT|>", "é ́a ..a.. ,b 'S 12", "x" * 300, " a　b"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "other") for i, t in rows], "doc_id long, text string, score string")


def test_encoder_equals_library():
    e = Encoder(tokenizer_path(), store=3)
    for _ in range(2):
        want = [np.array(x.ids, np.uint32).tobytes() for x in e.tokenizer.encode_batch(ODD, add_special_tokens=False)]
        assert e.encode(ODD) == want
    assert e.encode([None]) == [b""]


def test_token_files_round_trip(spark):
    rows = [(5, "a b c"), (1, None), (3, ""), (3, "x y"), (2, "long text " * 3000)]
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_tokens(token_files.write_tokens(docs(spark, rows), tokenizer_path())).collect())
    e, at, want = Encoder(tokenizer_path()), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = np.concatenate([np.frombuffer(e.encode([t])[0], np.uint32), [2]]).astype("<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.read_tokens(token_files.write_tokens(docs(spark, []), tokenizer_path())).count() == 0


def test_sequence_access(tmp_path):
    w = token_files.SequenceWriter(str(tmp_path / "f" / "a.arrows"), length=4, rows=2)
    w.append(np.arange(10))
    w.append(np.arange(100, 109))
    w.close()
    r = token_files.SequenceReader(str(tmp_path / "f" / "a.arrows"))
    assert r.ids(10, 9).tolist() == list(range(100, 109))
    ids, mask = r.sequence(4)
    assert ids.tolist() == [106, 107, 108, 0] and mask.tolist() == [True, True, True, False]


def test_packing(spark):
    rows = [(i, "word " * (i * 37 % 900)) for i in range(60)] + [(7, None), (7, None), (None, "x"), (99, "many words " * 4000)]
    got = packing.pack(packing.pieces(docs(spark, rows), tokenizer_path())).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    q = got.sort_values(["sequence_id", "offset"])
    assert ((q.groupby("sequence_id").length.cumsum() - q.length) == q.offset).all()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
    assert (got.piece == 0).sum() == len(rows)


def test_local_search_empties_a_bin():
    lengths = np.array([6, 4, 5, 3, 3, 5, 4])
    bins = packing.local_search([[0, 3], [1, 4], [2, 6], [5]], lengths, 10)
    assert sorted(i for b in bins for i in b) == list(range(7)) and len(bins) == 3
    assert max(lengths[b].sum() for b in bins) <= 10


def test_local_search_tries_every_giver():
    lengths = np.random.default_rng(700).integers(300, 1000, 400)
    bins = packing.local_search(packing.best_fit(lengths), lengths)
    assert sorted(i for b in bins for i in b) == list(range(400)) and max(lengths[b].sum() for b in bins) <= packing.CAPACITY
    assert len(bins) <= 130


def test_mixing(spark):
    t = mixing.targets([("a", 100), ("b", 10), (None, 50)], [1, 2, 3])
    assert t["b"] == 30 and abs(sum(t.values()) - 160) < 1e-9 and t[None] <= 150
    rows = spark.createDataFrame([(i, "w " * (i % 9), "ab"[i % 2] if i % 10 else None) for i in range(200)] + [(0, None, "a")], "doc_id long, text string, source string")
    one, two = (mixing.mix(rows).toPandas().sort_values(["doc_id", "size"]).reset_index(drop=True) for _ in range(2))
    assert one.equals(two) and len(one) == 201 and (one.taken <= 3 * one["size"]).all()
    for _, g in one.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 8
    assert mixing.mix(rows.limit(0)).count() == 0


@pytest.mark.parametrize("group", [64, 200])
def test_sources_of_any_size_meet_their_targets(spark, group):
    # the hot source has many groups, some have two or three, one has less than one; each has a very long document
    counts = {"hot": 1500, "three": 3 * group - 5, "two": 2 * group - 3, "one": group - 2, None: 40}
    rng, rows = np.random.default_rng(6), []
    for s, n in counts.items():
        rows += [(len(rows) + i, "w " * int(k), s) for i, k in enumerate(np.append(rng.integers(0, 60, n - 1), 300))]
    share = dict(zip(counts, (0.83, 1.37, 0.61, 1.45, 0.77)))  # no source is taken a whole number of times
    own = {s: sum(len(t) // 2 for _, t, of in rows if of == s) for s in counts}
    weights = [share[s] * own[s] for s in ["hot", "one", "three", "two", None]]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights, group=group).toPandas()
    assert len(got) == len(rows) and (got.copies <= 3).all()
    miss = {s: abs(g.taken.sum() - g.target.iloc[0]) for s, g in got.groupby("source", dropna=False)}
    assert max(miss.values()) <= 1, miss


def test_flight_keeps_the_probabilities():
    size = np.array([400.0, 0, 0, 7, 7, *range(1, 30)])
    p = np.linspace(0.2, 0.7, len(size))
    runs = np.array([mixing.flight(p, size, np.random.default_rng(k), 4) for k in range(2000)])
    assert np.abs(runs.mean(0) - p).max() < 0.05
    assert np.abs(runs @ size - p @ size).max() < 1e-6 and ((runs > 0) & (runs < 1)).sum(1).max() <= 6


def test_segments_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        w = rng.normal(-0.3, 1, 12)  # no ties
        got = toxicity.segments(list(enumerate(w.tolist())), -0.1)

        def split(a, b):  # the definition: the best segment first, then both sides
            best = max(((w[i:j].sum(), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            return [] if best[0] <= 1e-9 else split(a, best[1]) + [(best[1], best[2])] + split(best[2], b)

        assert [(a, b) for a, b, _ in got] == split(0, 12)


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    plain = [f"w{i}" .replace("w", "wo") + "rd" for i in range(10)] + "the of and to in is on at by it".split()
    rows, labels = [], []
    for i in range(400):
        t, bad = rng.choice(plain, 40).tolist(), i % 5 == 0
        t[10:12] = ["vile", "scum"] if bad else t[10:12]
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (None, "vile scum")]
    d = docs(spark, rows)
    model = toxicity.fit(d, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert all(got[i].predicted == y for i, y in labels) and got[900].predicted == got[901].predicted == 0
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in labels)
    assert toxicity.clean(d, model).filter("doc_id < 400").count() == 320
    assert toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int")).score("vile") < 0.3


@pytest.mark.parametrize("part,n,threshold", [(jaccard.PART, 4, 85), (3, 4, 85), (3, 5, 80)])
def test_jaccard(spark, monkeypatch, part, n, threshold):
    monkeypatch.setattr(jaccard, "PART", part)
    rng = np.random.default_rng(2)
    base = [rng.choice(300, 120).astype(str).tolist() for _ in range(12)]
    rows = []
    for k, words in enumerate(base):
        for c in range(1 + 5 * (k % 4)):
            t = list(words)
            for i in rng.choice(120, c % 5, replace=False):
                t[i] = "new"
            rows.append((len(rows) * 3, " ".join(t).upper() if c == 1 else " ".join(t)))
    rows += [(1, None), (2, ""), (4, "one two"), (5, "One  two"), (7, "one"), (8, rows[3][1]), (8, rows[3][1])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, rows), n, threshold).collect()}

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    s, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for _ in range(len(s)):
        for a in s:
            for b in s:
                if s[a] and s[b] and 100 * len(s[a] & s[b]) >= threshold * len(s[a] | s[b]):
                    up[a] = up[b] = min(up[a], up[b])
        if all(up[up[a]] == up[a] for a in up):
            break
    assert got == {i: (len(s[i]), up[i]) for i in s}
    assert jaccard.join(docs(spark, [])).count() == 0


@pytest.mark.parametrize("threshold", [80, 85])
@pytest.mark.parametrize("size", [6, 40, 300, 2000])
def test_linked_sets_share_a_block(size, threshold):
    rng, bands = np.random.default_rng(size), jaccard.Bands(threshold)
    for _ in range(30):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        cut = int(rng.integers(0, size * (100 - threshold) // 100 + 1))
        b = np.unique(a[cut:])
        if jaccard.verified(a, b, threshold):
            assert len(np.intersect1d(jaccard.block_keys(a, bands), jaccard.block_keys(b, bands)))


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 16))
    x = np.concatenate([base, np.repeat(base[:5], 10, 0) + rng.normal(size=(50, 16)) * 0.03, base[:3]])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, base[0].tolist(), None)]
    got = {r.vec_id: r for r in neardup_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x))[None] % 2)
    np.fill_diagonal(near, False)
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903))


def test_top_k(spark):
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(300, 8)) * rng.choice([1, 50], 300)[:, None])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, x array<double>")
    got = [tuple(r) for r in topk.top_k(v, v.filter("vec_id % 50 = 0"), 5, bucket=40, block=3).orderBy("query_id", "rank").collect()]
    want = []
    for q in range(0, 300, 50):
        best = sorted((-int(x[q] @ x[i]), i) for i in range(300) if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want


def test_url_graph(spark):
    link = lambda *to: "".join(f'<a href="https://{t}/">x</a>' for t in to)
    rows = [(1, "https://good.net/de/1", link("friend.test")), (2, "https://bad.com/en/1", ""), (3, "http://friend.test/x?y#z", ""), (4, "http://helper.test", link("bad.com")), (5, None, None), (6, "no url", ""), (7, "HTTPS://A.Example.COM/en/77", "")]
    got = {r.page_id: r for r in urlgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].verdict for i in range(1, 8)] == ["allow", "block", "allow", "block", "allow", "allow", "allow"]
    assert (got[3].host, got[3].path, got[5].host, got[6].path, got[7].rule) == ("friend.test", "/x", "", "", "example.com/en/7")
    assert got[3].trust > 0 and got[4].distrust > 0


def test_url_graph_follows_long_chains(spark):
    link = lambda to: f'<a href="https://{to}/">x</a>'
    chain = lambda name, n: [(f"https://{name}{i}.test/", link(f"{name}{i + 1}.test") if i < n else "") for i in range(n + 1)]
    rows = [("https://good.net/de/1", link("g0.test")), *chain("g", 14), *chain("b", 14), ("https://b15.test/", link("bad.com")), ("https://bad.com/en/1", "")]
    rows[-3] = (rows[-3][0], link("b15.test"))
    got = {r.host: r for r in urlgraph.judge(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")).collect()}
    assert all(got[f"g{i}.test"].trust > 0 and got[f"g{i}.test"].verdict == "allow" for i in range(15))
    assert all(got[f"b{i}.test"].distrust > 0 and got[f"b{i}.test"].verdict == "block" for i in range(16))
    assert got["g14.test"].trust == pytest.approx(0.15 * 0.85**15 / (1 - 0.85**16))


def test_warc_salvage(spark):
    rows = [(i, f"http://x/{i}", h) for i, h in enumerate(["<p>a</p>", None, "é" * 50000, "<p>a</p>", "", "b"])]
    a = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to, r.reason) for r in warc.read(a).collect()}
    assert got == {0: (8, "revisit", 3, None), 1: (0, "revisit", 4, None), 2: (100000, "response", None, None), 3: (8, "response", None, None), 4: (0, "response", None, None), 5: (1, "response", None, None)}


@pytest.mark.parametrize("pack", [warc.member, bytes])
def test_damage_costs_one_record(pack):
    records = [pack(warc.record(i, f"http://x/{i}", b"payload %d" % i * 2000)) for i in range(5)]
    for broken in range(5):
        bad = bytearray(records[broken])
        bad[len(bad) // 2] ^= 255
        data = b"".join(records[:broken]) + bytes(bad) + b"".join(records[broken + 1 :])

        class File(io.BytesIO):
            def size(self):
                return len(data)

        found = list(warc.salvage(File(data)))
        assert [int(f.head["x-page-id"]) for f in found if f.head] == [i for i in range(5) if i != broken]
        gap = [f for f in found if f.reason]
        assert len(gap) == 1 and gap[0].begin == sum(map(len, records[:broken])) and gap[0].end - gap[0].begin == len(bad)


def test_long_urls_keep_their_records(spark):
    urls = {i: "http://x/" + "u" * n for i, n in enumerate((10, 65_000, 100_000, 1_000_000))}
    a = warc.write(spark.createDataFrame([(i, u, f"page {i}") for i, u in urls.items()], "page_id long, url string, html string"))
    got = {r.page_id: (r.url, bytes(r.payload)) for r in warc.read(a).filter("reason is null").collect()}
    assert got == {i: (u, b"page %d" % i) for i, u in urls.items()}


@pytest.mark.parametrize("length", [100_000, 1_000_000])
@pytest.mark.parametrize("pack", [warc.member, bytes])
def test_long_headers_are_read(pack, length):
    data = b"".join(pack(warc.record(i, "http://x/" + "u" * (length if i % 2 else 9), b"payload %d" % i)) for i in range(5))

    class File(io.BytesIO):
        def size(self):
            return len(data)

    found = list(warc.salvage(File(data)))
    assert [(f.reason, f.head and f.head["x-page-id"]) for f in found] == [("", str(i)) for i in range(5)]


def test_a_member_may_hold_many_records():
    records = [warc.record(i, f"http://x/{i}", b"payload %d" % i * 2000) for i in range(6)]
    for broken in (None, *range(6)):
        parts = list(map(bytearray, records))
        if broken is not None:
            parts[broken][-100] ^= 255
        data = warc.member(b"".join(parts[:5])) + warc.member(bytes(parts[5]))

        class File(io.BytesIO):
            def size(self):
                return len(data)

        found = list(warc.salvage(File(data)))
        assert [int(f.head["x-page-id"]) for f in found if f.head] == [i for i in range(6) if i != broken]
        gaps = [f.reason for f in found if f.reason]
        assert len(gaps) == (broken is not None)
        if broken is not None and broken < 5:
            begin = sum(map(len, records[:broken]))
            assert gaps == [f"block digest differs (bytes {begin} to {begin + len(records[broken])} of the member)"]


def test_html(spark):
    page = "<html><head><title>T</title><script>'</p>'</script></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div><article><h1>Head &amp; tail</h1><p>One<br>two  <b>three<p>four<aside>side</aside><div id='comments'><p>reader</p></div><form>f</form></article><footer>foot</footer>"
    bare = lambda own: f"<body><div>Site name</div><p>{own}</p><div>Shared end</div></body>"
    rows = [(1, "http://h/a/1", page), (2, "http://k/b/1", bare("first")), (3, "http://k/b/2", bare("second")), (4, "http://k/z", bare("third")), (5, None, None), (6, "http://solo/", bare("alone"))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Head & tail\n\nOne two three\n\nfour", 2: "first", 3: "second", 4: "third", 5: "", 6: "Site name\n\nalone\n\nShared end"}


@pytest.mark.parametrize("span", [html_text.RANGE, 1])
def test_html_copies_meet_a_page_that_differs(spark, monkeypatch, span):
    monkeypatch.setattr(html_text, "RANGE", span)  # with ranges of a page or two, runs of copies fill whole ranges
    bare = lambda own: f"<body><div>Site name</div><p>{own}</p><div>Shared end</div></body>"
    rows, want = [], {}

    def add(host, path, own, text):
        rows.append((len(rows), f"http://{host}/{path}", bare(own)))
        want[len(rows) - 1] = text

    add("a", "first", "one", "one")
    for k in range(40):
        add("a", f"story?copy={k:02}", "told", "told")
    add("a", "third", "two", "two")
    for k in range(3):
        add("b", f"only?copy={k}", "alone", "Site name\n\nalone\n\nShared end")
    for k in range(20):
        add("c", f"mirror/{k:02}", "twice", "twice")
    add("c", "z", "last", "last")
    add("d", "a", "start", "start")
    for k in range(20):
        add("d", f"mirror/{k:02}", "again", "again")
    pages = spark.createDataFrame([rows[i] for i in np.random.default_rng(1).permutation(len(rows))], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == want
