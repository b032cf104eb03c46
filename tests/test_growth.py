"""Queries on tables that have what larger copies have: repeated urls, large page numbers."""

import os
import random

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from weftspark.functions import markup, text
from weftspark.operators import index, search
from weftspark.plans import catalogue, crawled, kept  # noqa: F401  their queries join the catalogue
from weftspark.streaming import keyed, runs

from test_catalogue import DATA, rows


def like_sql(spark, folder, name):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{folder}/{f}/*.parquet')")
    df = catalogue.QUERIES[name](spark, str(folder))
    got = con.execute(catalogue.ORACLES[name])
    names = [c[0] for c in got.description]
    mine, sql = rows([tuple(r) for r in df.collect()], df.columns), rows(got.fetchall(), names)
    assert mine == sql
    return mine


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Pages, and as many again with larger numbers and the same urls."""
    folder = tmp_path_factory.mktemp("repeated")
    p = spark.read.parquet(f"{DATA}/pages.parquet")
    p.unionByName(p.withColumn("page_id", F.col("page_id") + 1000)).write.parquet(f"{folder}/pages.parquet")
    return folder


def test_each_queued_page_comes_once_where_urls_repeat(spark, repeated):
    found = like_sql(spark, repeated, "queued_pages")
    assert len(found) == len(set(found)) > 0


def test_bodies_that_pages_are_given_do_not_grow_with_their_numbers(spark, tmp_path):
    p = spark.read.parquet(f"{DATA}/pages.parquet").limit(60)
    p.withColumn("page_id", F.col("page_id") + 600_000_000).write.parquet(f"{tmp_path}/pages.parquet")
    assert all("True" in r for r in like_sql(spark, tmp_path, "status_filter"))  # all are cut


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_counts_by_document_are_dealt_once(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    assert exchanges(index.top_words(index.term_counts(docs, "doc_id", "text", together=True), "doc_id", 1000)) == 1


#: Tokens as the public rules set them apart, signs kept as tokens until the end.
RULES = [(r'([;@#$%&?!\[\](){}<>"…]|--)', " $1 "), (r"([:,])([^\d])", " $1 $2"), (r"([:,])$", " $1"), (r"\.(\s|$)", " . $1"), (r"('s|'re|'ve|'ll|'d|'m|n't)(\s|$)", " $1 $2")]


def test_words_are_those_of_the_rules_on_odd_texts(spark):
    pick, parts = random.Random(5), [*"ab1 .:,;-'sn\n\t", "n't", "'re", "--", "..", "é", "…", "::", "don't", "'ll", ", "]
    t = spark.createDataFrame([("".join(pick.choice(parts) for _ in range(pick.randint(0, 14))),) for _ in range(5000)], "t string")
    plain = F.lower("t")
    for pattern, to in RULES:
        plain = F.regexp_replace(plain, pattern, to)
    plain = F.filter(F.split(plain, r"\s+"), lambda w: w.rlike(r"^[\p{L}\p{N}]+$"))
    assert t.filter(~plain.eqNullSafe(text.words(F.col("t")))).count() == 0


def test_new_postings_are_read_twice_but_made_once(spark):
    made = spark.sparkContext.accumulator(0)
    docs = spark.range(40).select(F.concat(F.lit("u"), F.col("id") % 4).alias("url"), F.lit("w").alias("word"), F.col("id").alias("tf"))
    seen = F.udf(lambda x: made.add(1) or x, "long").asNondeterministic()
    new = docs.select("url", "word", seen("tf").alias("tf")).filter("tf >= 0")
    assert index.replace_pages(docs.withColumn("url", F.concat("url", F.lit("x"))), new).count() == 80
    assert made.value == 40


def counted(spark, pages):
    """Pages that count how often their html is read."""
    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: made.add(1) or x, "string").asNondeterministic()
    return made, pages.withColumn("html", seen("html"))


def test_a_kept_index_parses_each_page_of_a_batch_once(spark, tmp_path):
    made, pages = counted(spark, spark.read.parquet(f"{DATA}/pages.parquet").limit(30).coalesce(1))
    kept = runs.KeptIndex(spark, str(tmp_path))
    kept.add(pages, "a", "page_id")
    assert kept.metadata().count() > 0 and made.value == 30


def test_found_pages_alone_get_their_metadata_put_together(spark):
    words = spark.createDataFrame([(w, f"u{i}", i + 1) for i in range(30) for w in ("a", "b")][:-1], "word string, url string, tf long")
    made, about = counted(spark, spark.range(30).select(F.concat(F.lit("u"), "id").alias("url"), F.col("id").cast("string").alias("html")))
    found = search.search(words, "b", 3, metadata=about.groupBy("url").agg(F.max("html").alias("html"))).collect()
    assert {(r.url, r.html) for r in found} == {(f"u{i}", str(i)) for i in (26, 27, 28)}
    plan = search.search(words, "b", 3, metadata=about)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_title_and_description_read_the_metas_once(spark):
    p = spark.createDataFrame([('<meta name="title" content="T"><meta property="og:title" content="O"><meta name=description content=D>',), ("",), (None,)], "html string")
    both = p.select(markup.head(F.col("html")).alias("h"), markup.title(F.col("html")).alias("t"), markup.description(F.col("html")).alias("d"))
    assert [(tuple(r.h), r.t, r.d) for r in both.collect()] == [(("O", "D"), "O", "D"), ((None, None), None, None), ((None, None), None, None)]


def test_an_entry_is_read_in_one_call():
    calls = []

    class State:
        now = None

        def get(self):
            calls.append("get")
            return self.now

        def exists(self):
            calls.append("exists")
            return self.now is not None

        def update(self, now):
            calls.append("update")
            self.now = now

    class Handle:
        def getValueState(self, *_):
            return State()

        def registerTimer(self, _):
            calls.append("timer")

        def deleteTimer(self, _):
            calls.append("delete")

    e = keyed.Entries(None)
    e.init(Handle())
    assert list(e.handleInputRows(("u",), iter([Row(at_ms=1, score=2.0, due_ms=9)]), None)) == []
    assert calls == ["get", "update", "timer"] and e.entry.now == (2.0, 9, -1)
