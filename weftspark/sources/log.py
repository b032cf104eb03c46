"""Append-only logs bucketed by a key: rows are written once and joined on the key without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import drop, folder


class BucketedLog:
    """A table below spark.checkpoint.dir whose files are dealt by a hash of the key into a fixed number of buckets.

    `append` writes only the rows it is given (one shuffle of these); `read` gives all rows with the buckets as partitioning, so
    an aggregation or join on the key has no exchange on this side. `compact` writes each bucket as one file again. One
    writer at a time; readers keep the files that were listed when they were planned.
    """

    def __init__(self, spark: SparkSession, columns: str, key: str, buckets: int | None = None):
        self.spark, self.columns, self.key = spark, columns, key
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.appended = 0
        self._make()

    def _make(self) -> None:
        self.name, self.path = f"log_{uuid.uuid4().hex}", folder(self.spark, "log")
        self.spark.sql(f"CREATE TABLE {self.name} ({self.columns}) USING parquet CLUSTERED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def append(self, rows: DataFrame) -> None:
        own = rows.select(*self.spark.table(self.name).columns)
        self._put(own)
        self.appended += 1

    def _put(self, rows: DataFrame) -> None:
        """One file a bucket. By the bucket's number and not the key: a shuffle by the key of rows that are bucketed alike would be left out."""
        rows.repartition(self.buckets, F.expr(f"pmod(hash({self.key}), {self.buckets})")).write.insertInto(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def compact(self) -> None:
        """One file a bucket in place of one for each append; the old files go when the new ones are complete."""
        old_name, old_path, rows = self.name, self.path, self.read()
        self._make()
        self._put(rows)
        self.spark.sql(f"DROP TABLE {old_name}")
        drop(self.spark, old_path)
        self.appended = 1

    def close(self) -> None:
        """Forget the table and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop(self.spark, self.path)
