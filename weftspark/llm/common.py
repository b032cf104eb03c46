"""What the training-data operators share: shared scratch space, storage access, grouped streams."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes an Arrow batch holds; long texts make larger batches heavy.
BATCH_ROWS, BATCH_BYTES = 1024, 1 << 24
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to what whole texts allow; smaller settings stay.

    Spark reads these settings when a plan runs, which for an operator's result is after the operator has
    returned; so they are left lowered. What an operator runs itself uses `arrow_batches`.
    """
    for key, most in _BATCHES.items():
        if _number(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))


def _number(value: str) -> int:
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = value.lower().rstrip("b") if value[-1:].lower() == "b" and value[-2:-1].isalpha() else value.lower()
    return int(digits[:-1]) * units[digits[-1]] if digits[-1:] in units else int(digits)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession):
    """Small Arrow batches for what runs inside; the session's settings come back afterwards."""
    before = {key: spark.conf.get(key) for key in _BATCHES}
    tune(spark)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


_own_scratch: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the storage that driver and executors share (spark.checkpoint.dir).

    Where that is unset, a session of one process (master local) gets a temporary folder, as in tests; on a cluster,
    whose executors could not see such a folder, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if "base" not in _own_scratch:
            folder = tempfile.TemporaryDirectory(prefix="weftspark-", ignore_cleanup_errors=True)  # goes with the process
            _own_scratch["base"], _own_scratch["keep"] = folder.name, folder
        base = _own_scratch["base"]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to shared storage and read it again: the lineage ends here, and a lost executor loses no rows.

    `release` deletes it when nothing reads it any more; what results still read stays in the shared folder.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    with arrow_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.kept_at = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete materialized rows that no later result reads."""
    for df in frames:
        if path := getattr(df, "kept_at", None):
            hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    import pyarrow.fs as pafs

    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def batched(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys as one table each; the input must be sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_pylist() for k in keys]
        tags = list(zip(*cols))
        begin = 0
        for i, tag in enumerate(tags):
            if tag != last:
                if i > begin:
                    held.append(b.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, begin, last = [], i, tag
        held.append(b.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def crc_fold(column: Column) -> Column:
    """crc32 of the id as text, mod 4; 2 is the held-out fold."""
    return F.crc32(column.cast("string").cast("binary")) % 4
