"""TF-IDF weights and ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stage


def tfidf(words: DataFrame) -> DataFrame:
    """(word, url, tf, weight): weight = tf * ln(N / df). Postings are written once, as they are read three times."""
    words = stage(words.select("word", "url", "tf"), "postings")
    n = words.select(F.count_distinct("url").alias("n"))  # one row
    df = words.groupBy("word").agg(F.count("*").alias("df"))
    return words.join(df, "word").crossJoin(F.broadcast(n)).select("word", "url", "tf", (F.col("tf") * F.log(F.col("n") / F.col("df"))).alias("weight"))


def search(words: DataFrame, query: str, k: int = 20, ranks: DataFrame | None = None, share: float = 1.0, metadata: DataFrame | None = None) -> DataFrame:
    """The k best urls for a query: summed tf-idf weights of its terms, plus `share` times the url's rank, with
    the titles of `metadata` where given. For one query over postings: these are read once and only one row a url, its counts of the
    query's terms, is written. For many queries over a kept index see blocks.search()."""
    terms = sorted(set(query.lower().split()))
    if not terms:
        raise ValueError("the query has no words")
    own = [F.max(F.when(F.col("word") == t, F.col("tf"))).alias(f"t{i}") for i, t in enumerate(terms)]
    counts = stage(words.select("word", "url", "tf").groupBy("url").agg(*own), "counts")
    n = counts.agg(F.count("*").alias("n"), *(F.count(f"t{i}").alias(f"n{i}") for i in range(len(terms))))  # one row
    weights = [F.col(f"t{i}") * F.log(F.col("n") / F.col(f"n{i}")) for i in range(len(terms))]
    score = sum((F.coalesce(w, F.lit(0.0)) for w in weights), F.lit(0.0))
    have = sum((F.col(f"t{i}").isNotNull().cast("long") for i in range(len(terms))), F.lit(0).cast("long"))
    hits = counts.filter(F.coalesce(*(F.col(f"t{i}") for i in range(len(terms)))).isNotNull()).crossJoin(F.broadcast(n)).select("url", score.alias("score"), have.alias("terms"))
    if ranks is not None:
        hits = hits.join(ranks, "url", "left").select("url", (F.col("score") + share * F.coalesce("rank", F.lit(0.0))).alias("score"), "terms")
    best = hits.orderBy(F.desc("score"), "url").limit(k)
    if metadata is None:
        return best
    best = stage(best, "best")  # k rows, so only their urls' metadata is put together
    return best.join(metadata.join(F.broadcast(best.select("url")), "url", "left_semi"), "url", "left")
