"""A training corpus from raw documents: toxic texts out, near copies merged, sources mixed, texts packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.llm import jaccard, mixing, packing, toxicity
from weftspark.llm.common import materialize, table
from weftspark.llm.wordpieces import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below the cut; the model learns from the labelled rows of the whole corpus.

    Null and empty texts score like a text without evidence and stay; repeated rows stay or go together; without labels
    nothing goes. An empty table stays empty.
    """
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def merge_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked documents, the one with the smallest id, and one row of exact copies.

    Documents without words (null and empty texts too) are linked with nothing and stay; null ids come last. An empty table stays empty.
    """
    return jaccard.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, which may be never.

    A null source is a source; null and empty texts have size 0 and are taken like others; rows that repeat an id, text and
    source share what is taken of them. An empty table stays empty.
    """
    id_, key = F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    # columns of the documents may have any name, so they stay together while others are beside them
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), id_.alias("own_id"), key.alias("own_key"), F.col("source").alias("own_source"))
    copies = mixing.mix(docs).filter("copies > 0").groupBy("doc_id", "key", "source").agg(F.sum("copies").alias("copies"))
    # rows that repeat id, text and source share their copies, and one of them stands for all
    one = whole.dropDuplicates(["own_id", "own_key", "own_source"])
    both = one.join(copies, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("key")) & F.col("own_source").eqNullSafe(F.col("source")))
    return both.select("doc", F.expr("explode(sequence(1L, copies))").alias("copy")).select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences. A null or empty text has only its end id; repeated rows are packed each; an
    empty table gives no rows."""
    return packing.pack(packing.pieces(docs, tokenizer_path()))


STAGES = [("toxicity", drop_toxic), ("jaccard_join", merge_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: The trained scores and the sampling cannot be said in SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents, each written and read again. Other columns than doc_id, text and source may have any name."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
