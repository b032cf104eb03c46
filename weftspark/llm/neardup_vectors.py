"""Embedding near-duplicates by randomised-rotation binary codes with stored correction factors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, release, tune
from .components import components

#: Vectors of one bucket that a task compares with each other; a larger bucket is dealt in chunks of a sixteenth, of this
#: many vectors at least and CHUNK_MOST at most.
CHUNK, CHUNK_MOST = 128, 4096
#: Width of the confidence bound, in standard deviations of the estimate.
WIDTH = 4.0
#: Chance that a pair at exactly the threshold meets in no band.
MISS = 0.002
#: Levels of a quantised component on either side of zero (four bits).
LEVELS = 7
#: Buckets up to this size are compared many at once; pairs of one comparison.
SMALL, PAIRS = 64, 1 << 15


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def plan(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits of a band and number of bands: buckets stay small as n grows, recall stays the same.

    A sign bit of a rotated vector differs with probability angle / pi, so a band of b bits agrees with
    probability (1 - angle / pi)^b.
    """
    bits = max(4, min(48, math.ceil(math.log2(max(n, 2) / 16))))
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - p)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


class Codec:
    """Codes of vectors of one dimension.

    A code holds the signs of the rotated unit vector y for as many rotations as the bands need; and for the first
    rotation the correction factor <y, signs> / sqrt(dim) and y itself in four-bit steps.
    """

    def __init__(self, dim: int, bits: int, bands: int, seed: int):
        self.dim, self.bands, self.bits = dim, bands, min(bits, dim)
        self.per = max(1, dim // bits)  # bands of a rotation
        self.seeds = [seed + r for r in range(-(-bands // self.per))]
        self.turns: list[np.ndarray] = []
        self.bytes = -(-dim // 8)
        self.kind = np.dtype([("dim", "<i4"), ("factor", "<f4"), ("step", "<f4"), ("signs", "u1", (len(self.seeds), self.bytes)), ("levels", "u1", (-(-dim // 2),))])

    def encode(self, x: np.ndarray) -> np.ndarray:
        self.turns = self.turns or [rotation(self.dim, s) for s in self.seeds]
        u, out = unit(x), np.zeros(len(x), self.kind)
        out["dim"] = self.dim
        for r, turn in enumerate(self.turns):
            y = u @ turn.T
            out["signs"][:, r] = np.packbits(y > 0, 1)
            if not r:
                out["factor"] = np.abs(y).sum(1) / math.sqrt(self.dim)
                step = np.maximum(np.abs(y).max(1) / LEVELS, 1e-30)
                out["step"] = step
                q = (np.rint(y / step[:, None]) + 8).astype(np.uint8)
                q = np.pad(q, ((0, 0), (0, self.dim % 2)))
                out["levels"] = q[:, ::2] << 4 | q[:, 1::2]
        return out

    def signs(self, code: np.ndarray) -> np.ndarray:
        """Signs of the first rotation, -1 or 1."""
        return np.unpackbits(code["signs"][:, 0], 1, self.dim).astype(np.float32) * 2 - 1

    def levels(self, code: np.ndarray) -> np.ndarray:
        """The rotated vectors as the steps give them."""
        q = np.stack([code["levels"] >> 4, code["levels"] & 15], 2).reshape(len(code), -1)[:, : self.dim]
        return (q.astype(np.float32) - 8) * code["step"][:, None]

    def values(self, code: np.ndarray) -> np.ndarray:
        """The bits of each band as a number."""
        all_ = np.unpackbits(code["signs"], 2, self.dim)
        out = []
        for k in range(self.bands):
            at = k % self.per * self.bits
            part = all_[:, k // self.per, at : at + self.bits].astype(np.int64)
            out.append(part @ (np.int64(1) << np.arange(part.shape[1], dtype=np.int64)))
        return np.stack(out, 1)

    def first_common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first band in which codes agree, for pairs of rows; the number of bands if there is none."""
        differ = np.ones((len(a), self.bands + 1), bool)
        differ[:, :-1] = self.values(a) != self.values(b)
        differ[:, -1] = False
        return np.argmin(differ, 1)

    def floor(self, code: np.ndarray, threshold: float, width: float) -> np.ndarray:
        """The least estimate that a pair at the threshold gives, by the factor of the side whose signs are used.

        With <signs, y> / factor the part of the other vector along this one is estimated without bias; what is left, of
        length sqrt(1 - cos^2), meets the code's own error sqrt(1 - factor^2) at a random angle.
        """
        f = code["factor"].astype(float)
        wide = min(1.0, width / math.sqrt(max(self.dim - 1, 1)))
        return threshold - wide * math.sqrt(1 - threshold**2) * np.sqrt(np.maximum(0, 1 - f * f)) / f

    def rounding(self, code: np.ndarray, width: float) -> np.ndarray:
        """What the steps of the other side may add to an estimate, before division by the factor."""
        return min(width / math.sqrt(12), math.sqrt(self.dim) / 2) * code["step"].astype(float)


_codecs: dict[tuple, Codec] = {}


def codec(*args) -> Codec:
    if args not in _codecs:
        _codecs[args] = Codec(*args)
    return _codecs[args]


def matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each dimension of a list column without nulls."""
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    ends = np.cumsum(n)
    for dim in np.unique(n):
        rows = np.flatnonzero(n == dim)
        yield rows, flat[(ends[rows] - dim)[:, None] + np.arange(dim)]


def binaries(rows: np.ndarray) -> pa.Array:
    """A binary column of the bytes of each row of a structured array."""
    size = rows.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * size), pa.py_buffer(rows.tobytes())])


def by_length(column: pa.BinaryArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, bytes) for each length of a binary column."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    n = np.diff(ends)
    for size in np.unique(n):
        rows = np.flatnonzero(n == size)
        yield rows, raw[ends[rows][:, None] + np.arange(size)]


def spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def pairs_within(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions within consecutive runs of these sizes."""
    n = int(size.sum())
    left = np.repeat(np.cumsum(size), size) - np.arange(n) - 1  # rows of the run after this one
    a = np.repeat(np.arange(n), left)
    return a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(left) - left, left)


def settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each of n positions reaches along pairs (a, b)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def whole_runs(batches: Iterator[pa.RecordBatch], key: str = "key") -> Iterator[pa.RecordBatch]:
    """The rows again in batches that end where a key ends; the input is sorted by key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        cut = int(np.searchsorted(k == k[-1], True)) if k[0] != k[-1] else 0
        if cut or held and held[0].column(key)[0].as_py() != k[-1]:
            yield pa.concat_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.concat_batches(held)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", seed: int = 11, chunk: int = CHUNK, width: float = WIDTH, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row: links are pairs of equal label with cosine >= threshold.

    Codes travel in place of vectors (see Codec). Codes of a label meet in a bucket when a band of their bits is equal; a
    bucket of more than `chunk` points is dealt in pairs of chunks, and a pair counts in its first common band only.
    <signs_a, y_b> / factor_a and <signs_b, y_a> / factor_b estimate the inner product without bias; where one of them
    falls short of the threshold by more than `width` standard errors the pair is settled. The vectors of the points
    that are left with an open pair are fetched, and those pairs recomputed in double precision. A task adds up links
    and returns one edge a vector (a spanning tree), never all pairs. Rows equal in label and vector share one
    point and its comparisons, each counting as a link of the others.

    Null, zero or non-finite vectors, null labels and null ids link with nothing. Of rows that repeat an id one vector
    counts (the first by a hash), and all get its result. Vectors of different dimension never link; lengths may be as
    large or small as doubles go. An empty table gives no rows; other columns are ignored. Links below the threshold
    are never reported; a pair at the threshold is missed with probability about `miss`, a closer one with less.
    """
    spark = vectors.sparkSession
    tune(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    zero = ~F.exists("x", lambda v: v != 0)
    # 128 bits name a label and vector; adding 0 makes both zeros equal
    same = F.transform("x", lambda v: v + F.lit(0).cast("float"))
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~bad & ~zero)
    good = good.select("vec_id", "x", F.xxhash64("label", same).alias("k1"), F.xxhash64(F.lit(seed), same, "label").alias("k2"), F.xxhash64("label").alias("lab"), F.xxhash64(F.lit(seed), "label").alias("lab2"))
    most = good.groupBy("lab").count().agg(F.max("count")).first()[0] or 0
    bits, bands = plan(most, threshold, miss)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in matrices(b.column("x")):
                part = b.select(["vec_id", "k1", "k2", "lab"]).take(pa.array(at))
                yield part.append_column("code", binaries(codec(x.shape[1], bits, bands, seed).encode(x)))

    coded = good.select("vec_id", "k1", "k2", "lab", "x").mapInArrow(encode, "vec_id long, k1 long, k2 long, lab long, code binary")
    coded = materialize(coded.groupBy("vec_id").agg(F.min(F.struct("k1", "k2", "lab", "code")).alias("v")).select("vec_id", "v.*"), "codes")
    points = materialize(coded.groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("lab").alias("lab"), F.first("code").alias("code")), "points")

    def parse(raw: np.ndarray) -> tuple[Codec, np.ndarray]:
        dim = int(raw[0, :4].copy().view("<i4")[0])
        c = codec(dim, bits, bands, seed)
        return c, np.ascontiguousarray(raw).view(c.kind)[:, 0]

    def keys(lab: np.ndarray, c: Codec, code: np.ndarray) -> np.ndarray:
        """The bucket of each band: a hash of label, dimension, band and its bits."""
        band = (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = spread(lab.astype(np.int64).view(np.uint64) + np.uint64(c.dim))
        return spread(spread(h[:, None] + band) + c.values(code).view(np.uint64)).view(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, raw in by_length(b.column("code")):
                c, code = parse(raw)
                yield pa.record_batch({"key": pa.array(keys(b.column("lab").to_numpy()[at], c, code).ravel())})

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, raw in by_length(b.column("code")):
                c, code = parse(raw)
                out = np.zeros((len(at), bands), [("id", "<i8"), ("band", "<i4"), ("code", c.kind)])
                out["id"], out["band"], out["code"] = b.column("id").to_numpy()[at][:, None], np.arange(bands), code[:, None]
                yield pa.record_batch({"key": pa.array(keys(b.column("lab").to_numpy()[at], c, code).ravel()), "row": binaries(out.ravel())})

    large = points.select("lab", "code").mapInArrow(count, "key long").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > chunk)
    size = F.greatest(F.lit(chunk), F.least(F.col("n") / 16, F.lit(CHUNK_MOST)))
    large = materialize(large.select("key", F.ceil(F.col("n") / size).cast("int").alias("parts")), "large-buckets")
    met = points.select("id", "lab", "code").mapInArrow(emit, "key long, row binary").join(large, "key", "left")
    # chunk k of a large bucket meets every chunk: the lower one of two is side 0
    part = F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int")
    turns = F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda k: F.struct(F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least(k, part), F.greatest(k, part))).alias("key"), (part > k).alias("second"), (k != part).alias("two")))
    n_out = max(partitions(spark), 1)
    dealt = met.select("row", F.explode(turns).alias("t")).select("t.*", "row").repartition(n_out, "key").sortWithinPartitions("key")
    head = np.dtype([("id", "<i8"), ("band", "<i4")])

    def candidates(key: np.ndarray, second: np.ndarray, two: np.ndarray, score) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows within each run of a key that `score` leaves open."""
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(begin, len(key)))
        left, right = [], []
        few = size <= SMALL
        row = np.flatnonzero(np.repeat(few, size))
        a, b = pairs_within(size[few])
        for s in range(0, len(a), PAIRS):
            x, y = row[a[s : s + PAIRS]], row[b[s : s + PAIRS]]
            ok = score(x, y) & (~two[x] | (second[x] != second[y]))
            left.append(x[ok])
            right.append(y[ok])
        for lo, n in zip(begin[~few], size[~few]):
            run = np.arange(lo, lo + n)
            sides = (run[~second[run]], run[second[run]]) if two[lo] else (run, run)
            for s in range(0, len(sides[0]), max(1, PAIRS // max(1, len(sides[1])))):
                some = sides[0][s : s + max(1, PAIRS // max(1, len(sides[1])))]
                x, y = np.repeat(some, len(sides[1])), np.tile(sides[1], len(some))
                if not two[lo]:
                    x, y = x[x < y], y[x < y]
                ok = score(x, y)
                left.append(x[ok])
                right.append(y[ok])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *left]), np.concatenate([none, *right])

    def estimates(c: Codec, code: np.ndarray, band: np.ndarray):
        """Which pairs of rows meet first in this bucket's band and may reach the threshold, by their codes."""
        sign, level, floor, f, extra = c.signs(code), c.levels(code), c.floor(code, threshold, width), code["factor"].astype(float), c.rounding(code, width)

        def score(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            root = math.sqrt(c.dim)
            ok = np.einsum("ij,ij->i", sign[x], level[y]) / root / f[x] >= floor[x] - extra[y] / f[x]
            at = np.flatnonzero(ok)
            x, y = x[at], y[at]
            other = np.einsum("ij,ij->i", sign[y], level[x]) / root / f[y] >= floor[y] - extra[x] / f[y]
            other &= (band[x] == band[y]) & (c.first_common(code[x], code[y]) == band[x])
            ok[at] = other
            return ok

        return score

    def open_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_runs(batches):
            for at, raw in by_length(b.column("row")):
                own = np.ascontiguousarray(raw[:, : head.itemsize]).view(head)[:, 0]
                c, code = parse(raw[:, head.itemsize :])
                key, second, two = (b.column(n).to_numpy(zero_copy_only=False)[at] for n in ("key", "second", "two"))
                x, y = candidates(key, second, two, estimates(c, code, own["band"]))
                hit = np.unique(np.concatenate([x, y]))
                yield pa.record_batch({"key": pa.array(key[hit]), "second": pa.array(second[hit]), "two": pa.array(two[hit]), "id": pa.array(own["id"][hit]), "band": pa.array(own["band"][hit])})

    open_ = materialize(dealt.mapInArrow(open_points, "key long, second boolean, two boolean, id long, band int"), "open-points")
    need = open_.select("id").distinct().join(points.select("id", "k1", "k2", "weight"), "id")
    found = good.select(F.col("vec_id").alias("id"), "k1", "k2", "lab", "lab2", "x").join(need, ["id", "k1", "k2"]).dropDuplicates(["id"]).select("id", "weight", "lab", "lab2", "x")
    again = open_.join(found, "id").repartition(n_out, "key").sortWithinPartitions("key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_runs(batches):
            for at, x in matrices(b.column("x")):
                c = codec(x.shape[1], bits, bands, seed)
                code = c.encode(x)
                key, second, two, ids, band, w, lab, lab2 = (b.column(n).to_numpy(zero_copy_only=False)[at] for n in ("key", "second", "two", "id", "band", "weight", "lab", "lab2"))
                e, f = candidates(key, second, two, estimates(c, code, band))
                large_ = x / np.abs(x).max(1)[:, None]
                length = np.sqrt((large_ * large_).sum(1))
                ok = np.zeros(len(e), bool)
                for s in range(0, len(e), PAIRS):  # exact recomputation
                    i, j = e[s : s + PAIRS], f[s : s + PAIRS]
                    ok[s : s + PAIRS] = ((large_[i] * large_[j]).sum(1) / (length[i] * length[j]) >= threshold) & (lab[i] == lab[j]) & (lab2[i] == lab2[j])
                e, f = e[ok], f[ok]
                n = np.bincount(e, w[f], len(ids)) + np.bincount(f, w[e], len(ids))
                root, hit = settle(len(ids), e, f), np.flatnonzero(n)
                yield pa.record_batch({"id": pa.array(ids[hit]), "n": pa.array(n[hit].astype(np.int64)), "to": pa.array(ids[root[hit]])})

    links = materialize(again.mapInArrow(compare, "id long, n long, to long"), "vector-links")
    release(open_, large)
    group = components(links.select(F.col("id").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "id")
    # from points back to all rows: equal rows link with each other too
    some = points.select("id", "k1", "k2", "weight").join(links.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").join(group, "id", "left").filter("weight > 1 or n is not null")
    some = some.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    ids = coded.select("vec_id", "k1", "k2").join(some, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    out = rows.select("vec_id").join(ids, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
