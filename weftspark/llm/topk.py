"""Exact top-k inner products by norm-bucketed retrieval."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, release
from .neardup_vectors import matrices

#: Candidates that travel together, of which each `BUCKET` in order of length are pruned alone; queries of a block.
RANGE, BUCKET, BLOCK = 65536, 4096, 16384
#: A local cosine threshold from which coordinates prune better than lengths.
COORDINATE = 0.3
#: Products up to here are exact in doubles; scores beyond the range of a long count as its ends.
EXACT, MOST = 2.0**53, 2**63 - 1


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x array<double>) of rows whose vector is not null and has only finite components."""
    bad = F.exists(vec_col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return df.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda v: v.cast("double")).alias("x"))


def quantised(df: DataFrame, scale: float = 256.0) -> DataFrame:
    """floor(scale * component) as double, also beyond the range of a long; what overflows a double is the largest one."""
    most = float(np.finfo(float).max)

    def step(c):
        v = F.greatest(F.least(F.lit(scale) * c, F.lit(most)), F.lit(-most))
        return F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v)

    return df.withColumn("x", F.transform("x", step))


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths without overflow on the way."""
    top = np.abs(x).max(1, initial=0.0)
    y = x / np.where(top > 0, top, 1.0)[:, None]
    with np.errstate(over="ignore"):
        return top * np.sqrt((y * y).sum(1))


def _search(q: np.ndarray, qid: np.ndarray, floor: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, out: list) -> None:
    """Candidates of one bucket, longest first, that can enter a query's top k: the k best of each."""
    length, qlen = lengths(x), lengths(q)
    top, eps = float(length[0]), 1e-9
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        large = ~(qlen * top < EXACT)
        local = floor / (qlen * top)
    for j in np.flatnonzero(large):
        _exactly(q[j], qid[j], floor[j], x, xid, k, out)
    free = ~large & ((floor == -np.inf) | (qlen == 0) | (top == 0))
    # a bucket whose longest vector is too short holds nothing for a query
    live = ~large & ~free & (local <= 1 + eps)
    # length pruning: only the first vectors are long enough, if the threshold is positive
    n = np.full(len(q), len(x))
    bound = live & (floor > 0)
    n[bound] = np.searchsorted(-length, -(floor[bound] / qlen[bound]) * (1 - eps), side="right")
    dense = np.flatnonzero(free | live & (local < COORDINATE))
    by_coord = unit = None
    for j in np.flatnonzero(live & (local >= COORDINATE)):
        # coordinate pruning: a unit vector p with cosine >= local to u lies in a cap around u, so on the
        # query's largest coordinate f it stays within u_f * local -+ r, or reaches the axis if the cap holds it
        if unit is None:
            unit, by_coord = x / np.maximum(length, 1e-300)[:, None], {}
        u = q[j] / qlen[j]
        f = int(np.argmax(np.abs(u)))
        if f not in by_coord:
            order = np.argsort(unit[:, f], kind="stable")
            by_coord[f] = order, unit[order, f]
        order, values = by_coord[f]
        r = np.sqrt(max(0.0, (1 - u[f] ** 2) * (1 - min(local[j], 1.0) ** 2))) + eps
        low_f = -1.0 if -u[f] >= local[j] - eps else u[f] * local[j] - r
        high_f = 1.0 if u[f] >= local[j] - eps else u[f] * local[j] + r
        near = order[np.searchsorted(values, low_f - eps) : np.searchsorted(values, high_f + eps, side="right")]
        near = near[near < n[j]]
        if len(near):
            _keep(out, qid[j], xid[near], x[near] @ q[j], floor[j], k)
    # queries that only lengths prune: products of a whole block at once
    dense = dense[np.argsort(n[dense], kind="stable")]
    for b in range(0, len(dense), 256):
        part = dense[b : b + 256]
        s = q[part] @ x[: n[part].max()].T
        for j, row in zip(part, s):
            _keep(out, qid[j], xid[: n[j]], row[: n[j]], floor[j], k)


def _exactly(q: np.ndarray, query: int, low: float, x: np.ndarray, xid: np.ndarray, k: int, out: list) -> None:
    """Products that doubles may round, in whole numbers of any size."""
    whole = [int(c) for c in q]
    s = [max(-MOST - 1, min(MOST, sum(a * int(b) for a, b in zip(whole, row)))) for row in x.tolist()]
    best = sorted((-v, int(i)) for v, i in zip(s, xid) if i != query and v >= low)[:k]
    out.append((np.full(len(best), query), np.array([i for _, i in best], np.int64), np.array([-v for v, _ in best], np.int64)))


def _keep(out: list, query: int, ids: np.ndarray, s: np.ndarray, low: float, k: int) -> None:
    ok = (ids != query) & (s >= low)
    ids, s = ids[ok], s[ok]
    if len(s) > k:
        near = s >= np.partition(s, len(s) - k)[len(s) - k]
        ids, s = ids[near], s[near]
    best = np.lexsort((ids, -s))[:k]
    if len(best):
        out.append((np.full(len(best), query), ids[best], s[best].astype(np.int64)))


def local(spark: SparkSession, kinds: dict[str, pa.DataType], rows: list[tuple]) -> DataFrame:
    """A small table whose size the planner knows."""
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(kinds), kinds.values())], names=list(kinds)))


def in_order(df: DataFrame, order: list, n: int, size: int, name: str, kept: str) -> DataFrame:
    """The n rows of df, materialized, with the number of each run of `size` rows in the order of these columns."""
    spark = df.sparkSession
    df = df.repartitionByRange(max(1, -(-n // size)), *order).sortWithinPartitions(*order)
    # the id holds the partition, in the upper bits, and the row's place in it
    df = materialize(df.withColumn("at", F.monotonically_increasing_id()), kept)
    begin, starts = 0, []
    for r in df.groupBy(F.shiftright("at", 33).cast("int").alias("part")).count().orderBy("part").collect():  # one row a partition
        starts.append((r.part, begin))
        begin += r["count"]
    df = df.join(local(spark, {"part": pa.int32(), "begin": pa.int64()}, starts), F.shiftright("at", 33).cast("int") == F.col("part"))
    return df.withColumn(name, F.floor((F.col("begin") + F.col("at").bitwiseAND(2**33 - 1)) / size).cast("int")).drop("at", "part", "begin")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, bucket: int = BUCKET, block: int = BLOCK, span: int = RANGE) -> DataFrame:
    """Each query's k largest inner products over all vectors but its own id: query_id, rank, vec_id, score (long).

    `vectors` and `queries` are (vec_id, x array<double>) with integral components. Vectors are sorted by length
    and cut into ranges of `span`. The longest range is searched first and gives each query its k-th score so far: what it
    must beat. Queries are then dealt into blocks by that score over their own length, which is the length
    that a vector needs; a block meets only the ranges whose longest vector has it, and nothing else is shipped. Within a
    range each `bucket` vectors are pruned by length, or by the query's largest coordinate where the local
    cosine threshold is high, and what is left is verified by exact products. A task holds one range and one block.

    Products that doubles would round are taken in whole numbers of any size; scores beyond the range of a long count as its
    ends. Ties go to the smaller id. Vectors of another dimension than a query never meet it; repeated rows are
    separate candidates, and of repeated query ids the smallest vector asks. No rows give no result.
    """
    spark = vectors.sparkSession
    top = F.aggregate("x", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v)))
    scaled = F.aggregate("x", F.lit(0.0), lambda a, v: a + (v / F.col("top")) * (v / F.col("top")))
    norm = F.when(F.col("top") > 0, F.col("top") * F.sqrt(scaled)).otherwise(0.0)
    v = vectors.withColumn("top", top).withColumn("norm", norm).select("vec_id", "x", "norm", F.size("x").alias("dim"))
    n = v.count()
    ranged = in_order(v, ["dim", F.desc("norm"), "vec_id"], n, span, "range", "norm-ranges")
    # one row a range
    tops = sorted((r.dim, r.range, float(r.top)) for r in ranged.groupBy("dim", "range").agg(F.max("norm").alias("top")).collect())
    q = queries.groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("top", top).withColumn("norm", norm).select("vec_id", "x", "norm", F.size("x").alias("dim"))
    q = materialize(q, "queries")
    nq = q.count()
    blocks = max(1, -(-nq // block))
    shape = "query_id long, vec_id long, score long"
    rank = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    # ranges of a dimension by their longest vector
    place = [(d, r, sum(1 for e in tops[:i] if e[0] == d)) for i, (d, r, _) in enumerate(tops)]
    place = local(spark, {"dim": pa.int32(), "range": pa.int32(), "pos": pa.int32()}, place)

    def meet(qs: DataFrame, xs: DataFrame, met: DataFrame) -> DataFrame:
        """Blocks of queries (dim, block) against the ranges from `begin` to `end` that `met` gives each."""
        pairs = met.select("dim", "block", F.explode(F.sequence("begin", "end")).alias("pos")).join(place, ["dim", "pos"]).select("dim", "block", "range")
        left = qs.join(pairs, ["dim", "block"]).select("dim", "block", "range", "vec_id", "x", "low")
        right = xs.join(pairs, ["dim", "range"]).select("dim", "block", "range", "vec_id", "x")

        def search(a: pa.Table, b: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if a.num_rows and b.num_rows:
                (_, qx), (_, x) = (next(matrices(t.column("x").combine_chunks())) for t in (a, b))
                qid, xid, low = a.column("vec_id").to_numpy(), b.column("vec_id").to_numpy(), a.column("low").to_numpy()
                order = np.lexsort((xid, -lengths(x)))
                for s in range(0, len(x), bucket):
                    at = order[s : s + bucket]
                    _search(qx, qid, low, x[at], xid[at], k, out)
            cols = [np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
            ids, vec, score = cols
            # of a range's buckets the k best of each query
            best = np.lexsort((vec, ~score, ids))  # ~ turns the order round, also for the least long
            ids, vec, score = ids[best], vec[best], score[best]
            new = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
            keep = np.arange(len(ids)) - np.repeat(new, np.diff(np.append(new, len(ids)))) < k
            return pa.table({"query_id": ids[keep], "vec_id": vec[keep], "score": score[keep]})

        keys = ["dim", "block", "range"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, shape)

    any_ = q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("low", F.lit(float("-inf")))
    spans = {"dim": pa.int32(), "block": pa.int32(), "begin": pa.int32(), "end": pa.int32()}
    first = meet(any_, ranged, local(spark, spans, [(d, b, 0, 0) for d in sorted({d for d, *_ in tops}) for b in range(blocks)]))
    first = materialize(first, "longest-range")
    low = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("low")).withColumnRenamed("query_id", "vec_id")
    # the length that a vector needs to beat a query's k-th score; a double may round the score, hence the little less
    need = F.when(F.col("low") > 0, F.col("low") / F.col("norm") * (1 - 1e-9)).otherwise(0.0)
    asked = q.join(low, "vec_id", "left").withColumn("low", F.coalesce("low", F.lit(float("-inf")))).withColumn("need", F.coalesce(need, F.lit(0.0)))
    asked = asked.withColumn("low", F.col("low") - F.abs("low") * 1e-12)
    asked = in_order(asked, ["dim", "need", "vec_id"], nq, block, "block", "query-blocks")
    met = []  # one row a block
    for b in asked.groupBy("dim", "block").agg(F.min("need").alias("need")).collect():
        end = bisect_right([-t for d, _, t in tops if d == b.dim], -b.need) - 1
        if end >= 1:
            met.append((b.dim, b.block, 1, end))
    both = first.unionByName(meet(asked, ranged, local(spark, spans, met))) if met else first
    release(q)
    return both.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
