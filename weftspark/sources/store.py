"""Shared scratch storage, and steps that keep an expression from being evaluated twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors write: below spark.checkpoint.dir, or a temporary one if there is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _own.setdefault("dir", tempfile.TemporaryDirectory(prefix="weftspark-", ignore_cleanup_errors=True))
        base = _own["dir"].name
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it again: several readers then cost one evaluation, and the lineage ends here. `release` deletes it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete staged rows that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "staged_at", None):
            drop(df.sparkSession, path)


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(spark: SparkSession, path: str) -> None:
    at, files = _at(spark, path)
    files.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if there is no such folder."""
    at, files = _at(spark, path)
    return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    at, files = _at(spark, path)
    stream = files.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, content: str) -> bool:
    """Write a small file that readers see whole or not at all; False if there is one of this name."""
    jvm = spark.sparkContext._jvm
    at, files = _at(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    out = files.create(draft, False)
    out.write(bytearray(content.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, at, how)
    except Exception:
        files.delete(draft, False)
        if files.exists(at):
            return False
        raise
    return True


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections read without evaluating their expressions again.

    The optimizer copies an expression into every filter above its projection, but not through an explode.
    """
    out = df.withColumn("_once", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
    return out.select(*(f"`{c}`" for c in df.columns if c not in columns), *(F.col("_once")[n].alias(n) for n in columns))


def numbered(df: DataFrame, key: str, order: str | Column, number: str, part: str | None = None) -> DataFrame:
    """Add each row's place (from 0) among the rows of its key in this order, however many rows a key has.

    Rows are dealt by ranges of key and order; places count from the first row of the key in a range, and the rows of the
    key in earlier ranges (one count a range and key) are added. `part` names a column for the range's number, if wanted.
    """
    if isinstance(order, Column):
        df, order = df.withColumn("_order", order), "_order"
    df = df.repartitionByRange(F.col(key), F.col(order)).sortWithinPartitions(key, order).withColumn("_at", F.monotonically_increasing_id())
    if order == "_order":
        df = df.drop("_order")
    df = stage(df, "numbered").withColumn("_part", F.shiftright("_at", 33))
    runs = df.groupBy("_part", F.col(key).alias("_key")).agg(F.min("_at").alias("_first"), F.count("*").alias("_count"))
    before = F.coalesce(F.sum("_count").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("_before", before)
    out = df.join(runs.withColumnRenamed("_part", "_p"), (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_key")))
    out = out.withColumn(number, F.col("_before") + F.col("_at") - F.col("_first"))
    return (out.withColumnRenamed("_part", part) if part else out.drop("_part")).drop("_at", "_p", "_key", "_first", "_count", "_before")


def largest_so_far(df: DataFrame, key: str, part: str, number: str, value: Column, into: str) -> DataFrame:
    """Add the greatest value of each key up to each row, for rows of numbered(..., part=part).

    Two passes: within each range of rows, and over the ranges' own greatest values (one row a range and key), so the rows of one
    key never meet in one task.
    """
    df = df.withColumn("_value", value)
    inner = Window.partitionBy(part, key).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    tops = df.groupBy(F.col(part).alias("_p"), F.col(key).alias("_key")).agg(F.max("_value").alias("_top"))
    before = F.max("_top").over(Window.partitionBy("_key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select("_p", "_key", before.alias("_before"))
    out = df.withColumn("_inner", F.max("_value").over(inner)).join(tops, (F.col(part) == F.col("_p")) & F.col(key).eqNullSafe(F.col("_key")))
    return out.withColumn(into, F.greatest("_inner", "_before")).drop("_p", "_key", "_before", "_inner", "_value")
