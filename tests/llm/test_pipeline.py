"""The corpus pipeline against plain versions of its stages, each on its own input, and on odd rows."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from weftspark.llm import mixing, packing, toxicity
from weftspark.llm.common import table
from weftspark.llm.wordpieces import Encoder, tokenizer_path

DATA, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and result of each stage, and what the whole returns."""
    docs, out = table(spark, DATA, "documents"), {}
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, DATA).cache()
        out[name] = ([tuple(r) for r in docs.collect()], [tuple(r) for r in after.collect()], after.columns)
        docs = after
    assert all(out[name][2] == names for name, _ in corpus_pipeline.STAGES[:-1])
    return out


def test_toxicity_drops_what_scores_high(spark):
    docs = table(spark, MORE, "documents")
    model = toxicity.fit(docs, table(spark, MORE, "labels"))

    def plain(text):  # the evidence by the definition of maximal segments: the best one first, then both sides
        tokens = re.findall(r"[^\W\d_]+", (text or "").lower())
        w = [model.drift] * len(tokens)
        for i, x in model.weights(tokens):
            w[i] = x
        if not any(x > 0 for x in w):
            return 0.0
        level = np.log(max(model.area * max(len(tokens), 1), 1.0))

        def best(a, b):  # Kadane
            top, lo, hi, run, at = 0.0, a, a, 0.0, a
            for i in range(a, b):
                if run <= 0:
                    run, at = 0.0, i
                run += w[i]
                if run > top + 1e-12:
                    top, lo, hi = run, at, i + 1
            return top, lo, hi

        total, todo = 0.0, [(0, len(w))]
        while todo:
            a, b = todo.pop()
            top, lo, hi = best(a, b)
            if model.scale * top > level and top > 0:
                total += model.scale * top - level
                todo += [(a, lo), (hi, b)]
        return total

    before, after = docs.collect(), corpus_pipeline.drop_toxic(spark, docs, MORE).collect()
    keep = [r for r in before if 1 / (1 + np.exp(-(model.slope * np.log1p(plain(r[1])) + model.intercept))) < 0.3]
    assert Counter(after) == Counter(keep) and 0 < len(keep) < len(before)


def test_one_document_of_each_group_stays(stages):
    before, after, _ = stages["jaccard_join"]

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    s, up = {r[0]: shingles(r[1]) for r in before}, {r[0]: r[0] for r in before}
    links = [(a, b) for a in s for b in s if a < b and s[a] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(up[a], up[b])
            if up[a] != low or up[b] != low:
                up[a] = up[b] = low
                changed = True
    assert sorted(r[0] for r in after) == sorted(i for i in up if up[i] == i)
    assert links and not set(after) - set(before)


def test_mix_meets_its_targets(stages):
    before, after, _ = stages["mixing"]
    words = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    own, got = Counter(), Counter()
    for r in before:
        own[r[3]] += words(r[1])
    for r in after:
        got[r[3]] += words(r[1])
    goal = mixing.targets(list(own.items()), [1, 2, 3])
    assert not set(after) - set(before) and max(Counter(after).values()) <= 3
    longest = {s: max(words(r[1]) for r in before if r[3] == s) for s in own}
    assert all(abs(got[s] - goal[s]) <= max(20, 0.02 * goal[s], longest[s] * 0.05) for s in own)


def test_packing_holds_every_token(stages):
    before, after, names = stages["packing"]
    e, want = Encoder(tokenizer_path()), Counter()
    for r in before:
        want[r[0]] += len(e.encode([r[1]])[0]) // 4 + 1
    row = [dict(zip(names, r)) for r in after]
    held = Counter()
    for r in row:
        held[r["doc_id"]] += r["length"]
    assert held == want
    bins: dict = {}
    for r in sorted(row, key=lambda r: r["offset"]):
        assert bins.setdefault(r["sequence_id"], 0) == r["offset"]
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= packing.CAPACITY and len(bins) <= -(-sum(bins.values()) // packing.CAPACITY) + 1


SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("extra", ["", ", copies long, key string, copy int, own_id int, doc string, fp long, score double"])
def test_odd_rows_pass_the_stages(spark, extra):
    long = " ".join(f"w{i}" for i in range(5000))
    texts = [(1, None, "a"), (2, "", None), (None, "some words of no id here", "b"), (None, None, None), (4, long, "a"), (5, long, "b"), (6, "six words stand in this text", "a"), (6, "six words stand in this text", "a")]
    rest = ("x",) * 0 if not extra else (7, "k", 1, 2, "d", 3, 0.5)
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), *rest) for i, t, s in texts], SHAPE + extra)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, DATA)
        rows = after.collect()
        assert rows
        if name != "packing":
            assert after.columns == docs.columns
        if name == "jaccard_join":
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, 1), (False, 2), (False, 4), (False, 6), (True, 0), (True, 0)]
        docs = after
    none = spark.createDataFrame([], SHAPE + extra)
    assert [stage(spark, none, DATA).count() for _, stage in corpus_pipeline.STAGES] == [0, 0, 0, 0]
