"""Vector code compression: integer codebooks for each part of the vectors.

A vector's components become integers and are cut into equal parts; a part is stored as the number of the nearest entry of
its position's codebook. The codebooks (entries x components, whatever the number of vectors) are broadcast. Arrow batches
take all squared distances as |x|^2 - 2 x.c + |c|^2 with exact integer products and the first smallest one. Each task sums
its parts by entry, the sums are merged by a grouped shuffle, and the entries move to the floor of their means.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
#: Rows whose distances to all entries are held at once.
ROWS = 4096


def largest(dims: int) -> int:
    """Components of larger amount count as this: with it, squared distances of whole vectors fit a long."""
    return int(np.sqrt(2.0**60 / max(dims, 1)))


def usable(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(rows, components) of the vectors in column "vector" that are not null and hold finite components only."""
    col = batch.column("vector")
    offsets, flat = col.offsets.to_numpy().astype(np.int64), col.values
    values = flat.to_numpy(zero_copy_only=False).astype(float)
    bad = ~np.isfinite(values)
    if flat.null_count:
        bad |= flat.is_null().to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(bad)])
    keep = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False) & (before[offsets[1:]] == before[offsets[:-1]]))
    if not len(keep):
        return keep, np.zeros((0, 0))
    size = offsets[keep + 1] - offsets[keep]
    if (size != size[0]).any():
        raise ValueError("vectors must all have the same number of components")
    return keep, values[offsets[keep][:, None] + np.arange(size[0])]


def quantise(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * component) as integers."""
    most = largest(x.shape[1])
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -most, most).astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row and its squared distance, exactly.

    Products are taken in doubles where every sum on the way is a whole number below 2^53, else in int64, whose
    overflow on the way cancels out as distances fit.
    """
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = float if 4 * most * most * max(1, x.shape[1]) < 2**53 else np.int64
    c = entries.astype(kind)
    square = (c * c).sum(1)
    best, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for i in range(0, len(x), ROWS):
        y = x[i : i + ROWS].astype(kind)
        d = square - 2 * (y @ c.T) + (y * y).sum(1)[:, None]
        best[i : i + ROWS] = k = d.argmin(1)
        distance[i : i + ROWS] = d[np.arange(len(d)), k]
    return best, distance


def _cut(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Parts of each row: (rows, parts, components)."""
    if x.shape[1] != books.shape[0] * books.shape[2]:
        raise ValueError("vectors must all have the same number of components")
    return x.reshape(len(x), books.shape[0], books.shape[2])


def first_entries(vectors: DataFrame, parts: int, entries: int, scale: float) -> np.ndarray | None:
    """The parts of the smallest ids' vectors, (parts, entries, components); None without vectors. At most `entries` rows are fetched."""
    finite = ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    rows = vectors.filter(F.col("vector").isNotNull() & finite).select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    if not rows:
        return None
    if len({len(r.vector) for r in rows}) > 1 or len(rows[0].vector) % parts:
        raise ValueError(f"vectors must all have the same number of components, a multiple of {parts}")
    x = quantise(np.array([r.vector for r in rows], float).reshape(len(rows), -1), scale)
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> np.ndarray | None:
    """Codebooks (parts, entries, components) of (vec_id, vector) after some rounds over all rows; None without vectors.

    The rows are read again in each round and nothing of them is written; what travels are a task's sums by entry and, to
    the driver, one row an entry.
    """
    spark = vectors.sparkSession
    books = first_entries(vectors, parts, entries, scale)
    if books is None:
        return None
    width = books.shape[2]
    schema = ", ".join(["part int", "entry int", "n long", *(f"s{i} long" for i in range(width))])
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            c = sent.value
            n, s = np.zeros(c.shape[:2], np.int64), np.zeros(c.shape, np.int64)
            for b in batches:
                _, x = usable(b)
                if len(x):
                    x = _cut(quantise(x, scale), c)
                    for p in range(len(c)):
                        k, _ = nearest(x[:, p], c[p])
                        np.add.at(s[p], k, x[:, p])
                        n[p] += np.bincount(k, minlength=c.shape[1])
            p, k = np.nonzero(n)
            cols = [p.astype(np.int32), k.astype(np.int32), n[p, k], *s[p, k].T]
            yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in cols], names=["part", "entry", "n", *(f"s{i}" for i in range(width))])

        # sums of very many rows may leave a long
        total = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *(f"s{i}" for i in range(width)))]
        merged = vectors.select("vector").mapInArrow(sums, schema).groupBy("part", "entry").agg(*total).collect()
        books = books.copy()
        for r in merged:
            books[r.part, r.entry] = [int(v) // int(r.n) for v in r[3:]]
        sent.unpersist()
    return books


CODED = "code string, error long"


def encode(vectors: DataFrame, books: np.ndarray, scale: float = SCALE) -> DataFrame:
    """Code (two hex digits a part) and summed squared distance of each usable vector, beside its other columns."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    rest = [f for f in vectors.schema.fields if f.name != "vector"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        digits = max(2, len(f"{c.shape[1] - 1:x}"))
        for b in batches:
            keep, x = usable(b)
            if not len(keep):
                continue
            x = _cut(quantise(x, scale), c)
            found = [nearest(x[:, p], c[p]) for p in range(len(c))]
            codes = ["".join(f"{k:0{digits}x}" for k in row) for row in zip(*(k.tolist() for k, _ in found))]
            own = b.take(pa.array(keep))
            cols = [own.column(f.name) for f in rest] + [pa.array(codes), pa.array(sum(d for _, d in found))]
            yield pa.record_batch(cols, names=[f.name for f in rest] + ["code", "error"])

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    return vectors.mapInArrow(each, StructType([*rest, StructField("code", StringType()), StructField("error", LongType())]))


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    digits = max(2, len(f"{books.shape[1] - 1:x}"))
    return np.concatenate([books[p, int(code[p * digits : (p + 1) * digits], 16)] for p in range(len(books))])


def checksum(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimals between commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) of every usable vector, written once, and the codebooks.

    Vectors that are null or hold null or non-finite components are left out; all others must have one length, a
    multiple of `parts` (else an error). The first codebooks are the vectors with the smallest ids, null ids last, repeated
    ids by their vectors; with fewer vectors than entries the codebooks are that much smaller. Entries that no part uses
    stay. Repeated ids keep one row each; other columns are ignored. A table without usable vectors gives no rows and None.
    Components whose integers are too large for exact distances count as the largest allowed (see largest()).
    """
    vectors = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vector"))
    books = fit(vectors, parts, entries, rounds, scale)
    if books is None:
        none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CODED.split(", ")]
        return vectors.limit(0).select("vec_id", "label", *none), None
    return materialize(encode(vectors, books, scale), "codes"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Add the errors summed over each label, nulls together."""
    total = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(total, F.col("label").eqNullSafe(F.col("of"))).drop("of")
