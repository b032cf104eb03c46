"""PageRank that conserves mass, to a tolerance, and its update when edges change.

Mass is what flows: every page sends out 1, and each page passes on `damping` times what it gets, in equal parts over its links.
A page's mass is all it got with its own 1. Pages without links pass nothing on; as both they and the restart would spread over all
pages evenly, dividing by the total of all masses gives the ranks of the walk in which sinks restart, which sum to 1.
Mass is linear, so when edges change, only the difference that the changed pages cause is sent out again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import release, stage

DAMPING, TOLERANCE = 0.85, 1e-9
#: Steps that one job takes; what lies between jobs is written.
STEPS = 4


def shares(e: DataFrame) -> DataFrame:
    """(src, dst, deg): links with the number of their page's links."""
    return e.join(e.groupBy("src").agg(F.count("*").alias("deg")), "src")


def spread(first: DataFrame, share: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(url, mass): all that `first` (url, mass) becomes, itself included. Amounts up to `tolerance` are kept and not passed on, so
    the total of a graph of n pages is off by at most n * tolerance * damping / (1 - damping)."""
    now, parts, held = first, first, []
    while True:
        got, steps = now, None
        for k in range(STEPS):
            got = got.filter(F.abs("mass") > tolerance).join(share, F.col("url") == F.col("src")).groupBy(F.col("dst").alias("url")).agg((damping * F.sum(F.col("mass") / F.col("deg"))).alias("mass"))
            one = got.withColumn("_step", F.lit(k))
            steps = one if steps is None else steps.unionByName(one)
        held.append(stage(steps, "mass"))
        parts = parts.unionByName(held[-1].drop("_step"))
        now = held[-1].filter(F.col("_step") == STEPS - 1).drop("_step")
        if now.filter(F.abs("mass") > tolerance).isEmpty():
            break
    total = stage(parts.groupBy("url").agg(F.sum("mass").alias("mass")), "masses")
    release(*held)
    return total


def nodes(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("url")).unionByName(e.select(F.col("dst").alias("url"))).distinct()


def masses(e: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(url, mass) of every page of distinct links (src, dst), written once."""
    e = stage(e, "edges")
    share, first = stage(shares(e), "shares"), stage(nodes(e).withColumn("mass", F.lit(1.0)), "first")
    out = spread(first, share, damping, tolerance)
    release(e, share, first)
    return out


def update(old: DataFrame, before: DataFrame, after: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """masses(after) from `old` = masses(before): what is sent out is 1 from each new page, minus 1 from each page that is gone, and from
    pages whose links changed the difference of what they pass on. Pages that none of it reaches above the tolerance are only
    read; their masses stay as they are."""
    before, after = stage(before, "edges"), stage(after, "edges")
    # pages with a link more or less
    both = before.withColumn("_o", F.lit(1)).withColumn("_n", F.lit(0)).unionByName(after.withColumn("_o", F.lit(0)).withColumn("_n", F.lit(1)))
    changed = stage(both.groupBy("src", "dst").agg(F.sum("_o").alias("o"), F.sum("_n").alias("n")).filter("o <> n").select("src").distinct(), "changed")
    part = lambda e, sign: shares(e.join(changed, "src", "left_semi")).join(old, F.col("src") == F.col("url")).select(F.col("dst").alias("url"), (sign * damping * F.col("mass") / F.col("deg")).alias("mass"))
    new, gone = nodes(after).join(nodes(before), "url", "left_anti"), nodes(before).join(nodes(after), "url", "left_anti")
    first = part(after, 1.0).unionByName(part(before, -1.0)).unionByName(new.withColumn("mass", F.lit(1.0))).unionByName(gone.withColumn("mass", F.lit(-1.0)))
    first = stage(first.groupBy("url").agg(F.sum("mass").alias("mass")), "first")
    share = stage(shares(after), "shares")
    more = spread(first, share, damping, tolerance)
    total = old.unionByName(more).groupBy("url").agg(F.sum("mass").alias("mass"))
    out = stage(total.join(nodes(after), "url", "left_semi"), "masses")
    release(before, after, changed, first, share, more)
    return out


def ranks(mass: DataFrame) -> DataFrame:
    """(url, rank) that sum to 1."""
    return mass.crossJoin(F.broadcast(mass.agg(F.sum("mass").alias("_all")))).select("url", (F.col("mass") / F.col("_all")).alias("rank"))  # one row
