"""The trained language model on rows it has not seen."""

import pytest
from pyspark.sql import functions as F

from weftspark.operators import language

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return language.fit(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))


def test_held_out_rows(spark, model):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    got = model.classify(docs.select("doc_id", "text", "lang"), "text")
    right = F.col("language") == F.col("lang")
    n, ok, sure = got.agg(F.count("*"), F.sum(right.cast("int")), F.avg("confidence")).first()
    print("held-out", n, ok, sure)  # with -s
    assert n > 200 and ok / n > 0.981
    assert abs(sure - ok / n) < 0.03  # the confidence says how often it is right


def test_the_index_may_ask_the_model(spark, model):
    from weftspark.operators import index

    rows = [("https://s.test/en", "<p>The garden was quiet in the morning and the people of the town had gone to the market</p>"), ("https://s.test/de", "<p>Der Garten war am Morgen ruhig und die Leute aus der Stadt waren auf den Markt gegangen</p>"), ("https://s.test/none", "<p></p>")]
    got = index.postings(spark.createDataFrame(rows, "url string, html string"), languages=model)
    assert {r.url for r in got.collect()} == {"https://s.test/en"} and "garden" in {r.word for r in got.collect()}


def test_odd_texts(spark, model):
    got = model.classify(spark.createDataFrame([(1, None), (2, ""), (3, "é"), (4, "x" * 100_000), (5, "\x00")], "language_id int, text string"), "text")
    assert got.columns == ["language_id", "text", "language", "confidence"]
    rows = {r.language_id: r for r in got.collect()}
    assert [(rows[i].language, rows[i].confidence) for i in (1, 2)] == [("unknown", 0.0)] * 2
    assert all(0 < rows[i].confidence <= 1 and rows[i].language in model.names for i in (3, 4, 5))


def test_no_rows(spark):
    with pytest.raises(ValueError):
        language.fit(spark.createDataFrame([(None, "en"), ("x", None)], "text string, lang string"))


def test_grams(spark):
    got = spark.createDataFrame([("aÉ",)], "t string").select(language.grams(F.col("t"))).first()[0]
    assert sorted(got) == sorted(["61", "C3", "A9", "61C3", "C3A9", "61C3A9"])
