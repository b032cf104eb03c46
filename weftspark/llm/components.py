"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, release


def _with_minimum(rows: DataFrame, of: DataFrame, total: int, parts: int) -> DataFrame:
    """rows (u, v) with m, the least of u and its neighbours v in `of`.

    A node of more than a `parts`-th of `total` rows, which `of` has at most, is a hub: there are fewer than `parts` of
    them, and their minima are sent to all tasks, so that their rows are not dealt by the node. The others' are joined.
    """
    low = of.groupBy("u").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "v").alias("m"), "n")
    hub = F.col("n") * parts > total
    hubs = F.broadcast(low.filter(hub).select("u", "m"))
    # a key of its own makes the minima a side that is dealt for the join, whose larger nodes adaptive execution can then split
    rest = low.filter(~hub).select((F.col("u") + 0).alias("u"), "m")
    return rows.join(hubs, "u").unionByName(rows.join(hubs, "u", "left_anti").join(rest, "u"))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) for every node of an edge table with columns a, b (long); component is the smallest node.

    Every step rewrites edges to point at smaller nodes: a node's larger neighbours to its smallest one, then its
    smaller neighbours to the smallest. Minima are combined before the shuffle, so a node with very many edges
    costs one row for each task, and the minima of such nodes are sent to where their edges are. Each step is written to shared
    storage. It ends when no node that others point at points at a further one, and raises an error if that has
    not come after `rounds` steps (they grow with the logarithm of the nodes). Loops and nulls are dropped.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v and v is not null").distinct()
    e, parts = materialize(e, "edges"), partitions(edges.sparkSession)
    for _ in range(rounds):
        # stars only: no node that edges point at has an edge of its own, and no node has two
        ends = e.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        if not ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or (out > 0 and into > 0)").limit(1).count():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        total = 2 * e.count()
        large = _with_minimum(both.filter("v > u"), both, total, parts).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        small = _with_minimum(large, large, total, parts).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u > v").distinct()
        before, e = e, materialize(small, "edges")
        release(before)
    else:
        raise RuntimeError(f"components are not settled after {rounds} steps")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
