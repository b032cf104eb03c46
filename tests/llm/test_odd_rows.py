"""Odd rows that the other tests leave out: empty tables, repeats, very long texts, clashing columns."""

import random
from collections import Counter

import pytest

from weftspark.llm import html_text, mixing, topk, toxicity

CLASH = "doc_id long, text string, source string, id long, y int, w double, score double, predicted string, held_out string, size string, key string, n int, part int, p double, target string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, 0.5, 0.1, "x", "y", "z", "k", 3, 4, 0.2, "t") for i, t, s in rows], CLASH)


def test_toxicity_of_odd_tables(spark):
    r = random.Random(1)
    own = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    clean = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    text = lambda i: own(clean, 12) + (" " + own(["vile", "cruel", "scum", "filth", "trash"], 6) if i % 4 == 0 else "")
    rows = [(i, text(i), "s") for i in range(300)]
    bad = rows[4][1]
    rows += [rows[7]] * 3 + [rows[4]] * 2 + [(None, bad, "s"), (None, None, None), (900, "", "s"), (901, own(clean, 400_000) + " " + own(["vile", "cruel", "scum", "filth", "trash"], 60), "s")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(4, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), labels)
    got = toxicity.score(docs(spark, rows), model).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, set()).add((r.score, r.held_out))
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    assert len(of[7]) == len(of[4]) == 1 and all(not h for _, h in of[None])
    assert min(s for s, _ in of[4]) > max(s for s, _ in of[7]) and max(s for s, _ in of[901]) > max(s for s, _ in of[900])
    kept = toxicity.clean(docs(spark, rows), model)
    assert kept.schema == docs(spark, rows).schema and kept.filter("doc_id = 7").count() == 4
    none = docs(spark, [])
    assert toxicity.score(none, model).count() == toxicity.clean(none, model).count() == 0
    blank = toxicity.fit(none, labels)
    assert 0 <= blank.score("anything") < 0.3
    assert toxicity.score(docs(spark, rows), toxicity.fit(docs(spark, rows), labels.limit(0))).filter("predicted = 1").count() == 0


def test_mixing_of_clashing_columns_and_many_repeats(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATS", 8)
    rows = [(1, "a b c", "x")] * 50 + [(i, "word " * (i % 7), "y") for i in range(40)] + [(2, None, None), (None, "n", None), (3, "", "z")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r.source == "x" for r in got) == 50
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(6, max(r.size for r in own))
        assert all(r.taken <= 3 * r.size for r in own)
    again = mixing.mix(docs(spark, rows)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, text string, host string")
    got = html_text.extract(none)
    assert got.count() == 0 and got.columns[:4] == ["page_id", "url", "text", "n_chars"]


def test_of_a_repeated_query_id_the_smallest_vector_asks(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 5.0]), (1, [3.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, x array<double>")
    got = topk.top_k(v, v.filter("vec_id = 0"), 2)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == [(0, 1, 2, 10), (0, 2, 1, 0)]


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, x array<double>")
    assert topk.top_k(none, none).count() == 0


@pytest.mark.parametrize("stage", range(4))
def test_stages_of_the_pipeline_take_an_empty_table(spark, stage):
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    none = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    assert run(spark, none, "/root/testdata/sf0.001").count() == 0, name
