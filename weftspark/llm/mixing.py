"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

WORD = "[^\\x20\\x09-\\x0D]+"
#: Units that one flight takes.
GROUP = 4096
#: Numbers of repeated rows that one array holds on the way.
REPEATS = 65536
#: Units that a flight leaves to the next one or to the landing, besides two that no step settles.
HOLD = 12
#: Units that move together in a flight.
WINDOW = 64


def word_count(col: F.Column) -> F.Column:
    """Words between ASCII white space; null and empty texts have none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple], weights: list[float], limit: float = 3.0) -> dict:
    """Words to take of each source: the whole by weight, at most `limit` times a source's own words.

    What a source cannot take is shared again among the rest by weight, until no target is above its limit.
    Sources are in code-point order, null last, and take the weights in turn.
    """
    named = sorted((r for r in sizes if r[0] is not None), key=lambda r: r[0]) + [r for r in sizes if r[0] is None]
    own = {s: n for s, n in named}
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(named)}
    left, free, out = float(sum(own.values())), list(own), {}
    while free:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = [s for s in free if share[s] > limit * own[s]]
        if not over:
            out.update(share)
            break
        for s in over:
            out[s] = limit * own[s]
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, hold: int = 0) -> np.ndarray:
    """Cube flight: inclusion probabilities move in the null space of the balancing constraints.

    Constraints are the expected number of units and of tokens. Units without tokens are settled among themselves. The
    others are flown longest first: the longest of a window moves, the shorter ones beside it make up for it a little
    each, until one of them is 0 or 1. So a long unit is settled while many are left to balance it, and the `hold` + 2
    units that stay undecided are the shortest.
    """
    p, eps = p.copy(), 1e-9
    live = np.flatnonzero((p > eps) & (p < 1 - eps))
    draws, at = rng.random(len(live) + 1), 0

    def move(i: np.ndarray, d: np.ndarray) -> np.ndarray:
        nonlocal at
        x, use = p[i], np.abs(d) > 1e-12
        up = (np.where(d > 0, 1 - x, x)[use] / np.abs(d[use])).min()
        down = (np.where(d > 0, x, 1 - x)[use] / np.abs(d[use])).min()
        x = x + (up if draws[at % len(draws)] * (up + down) < down else -down) * d
        at += 1
        x[x <= eps], x[x >= 1 - eps] = 0.0, 1.0
        p[i] = x
        return i[(x > 0) & (x < 1)]

    empty = live[:0]
    for i in live[size[live] == 0]:
        empty = np.append(empty, i)
        if len(empty) == 2:
            empty = move(empty, np.array([1.0, -1.0]))
    todo = live[size[live] > 0]
    todo = np.concatenate([todo[np.argsort(-size[todo], kind="stable")], empty])
    held, todo = todo[:WINDOW], todo[WINDOW:]
    while len(held) + len(todo) > hold + 2:
        # the first of the window, projected on the directions that keep both sums; units near 0 or 1 move less
        x, s = p[held], size[held]
        w = x * (1 - x)
        far = s - (w @ s) / w.sum()
        spread = w @ (far * far)
        tilt = far[0] / spread if spread > 1e-9 * (w @ (s * s)) else 0.0
        d = -w * w[0] * (1 / w.sum() + tilt * far)
        d[0] += w[0]
        if d[0] > 1e-6 * w[0]:
            d /= np.abs(d).max()
            held = move(held, d)
        else:  # nothing balances the first: three that always can move
            a, b, c = s[:3]
            u = np.array([b - c, c - a, a - b])
            held = np.concatenate([move(held[:3], u / np.abs(u).max() if u.any() else np.array([1.0, -1.0, 0.0])), held[3:]])
        need = WINDOW - len(held)
        held, todo = np.concatenate([held, todo[:need]]), todo[need:]
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The few undecided units: the choice whose token total, then unit count, is nearest to the expected one."""
    i = np.flatnonzero((p > 0) & (p < 1))
    if not len(i):
        return p
    choices = (np.arange(1 << len(i))[:, None] >> np.arange(len(i)) & 1).astype(float)
    words, units = np.abs((choices - p[i]) @ size[i]), np.abs((choices - p[i]).sum(1))
    best = choices[np.lexsort((units, words))[0]]
    p = p.copy()
    p[i] = best
    return p


UNITS = "source string, key long, doc_id long, copy_no long, size long, source_size long, target double, base long, p double"


def mix(docs: DataFrame, weights: tuple = (1, 2, 3), limit: float = 3.0, seed: int = 7, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each document is taken so that sources meet their targets.

    A source's factor is target / own words. Each document is taken floor(factor) times, and once more with
    the fractional part as probability, by the cube method in random groups within the source; groups' few
    undecided units are flown again together until the source has one group left, which lands, whatever the other
    sources have. Documents of size 0, null
    texts and null sources take part; repeated rows are separate units; other columns are ignored. An empty
    table gives no rows. The random draws depend on the seed, source and document only, so reruns agree.
    """
    spark = docs.sparkSession
    units = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    units = units.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("key"))
    # rows that repeat id, text and source are counted first and numbered apart, so that no group gets them all
    units = units.groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("n"))
    units = materialize(units, "mix-sizes")
    # one row a source; the number of sources is the size of what the driver holds
    totals = [(r.source, int(r.n), int(r.rows)) for r in units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("n"), F.sum("n").alias("rows")).collect()]
    goal = targets([(s, n) for s, n, _ in totals], list(weights), limit)
    facts = []
    for s, n, rows in totals:
        f = goal[s] / n if n else 0.0
        base = int(min(np.floor(f + 1e-12), limit))
        facts.append((s, n, float(goal[s]), base, max(0.0, f - base), max(1, -(-rows // group))))
    fact = spark.createDataFrame(facts, "name string, source_size long, target double, base long, p double, parts long")
    units = units.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / REPEATS))))
    last = F.least((F.col("run") + 1) * REPEATS, F.col("n")) - 1
    units = units.withColumn("copy_no", F.explode(F.sequence(F.col("run") * REPEATS, last))).drop("n", "run")
    units = units.join(fact, units.source.eqNullSafe(fact.name)).drop("name")
    names = [c.split()[0] for c in UNITS.split(", ")]

    hold = min(HOLD, max(0, group // 4 - 1))  # a group settles more than it keeps

    def fly(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["key", "doc_id", "copy_no"], kind="stable")
        last = df["parts"].iloc[0] == 1
        rng = np.random.default_rng([seed, int(df["key"].iloc[0]) & 0xFFFFFFFF, len(df)])
        size = df["size"].to_numpy(float)
        p = flight(df["p"].to_numpy(float), size, rng, HOLD if last else hold)
        return df[names].assign(p=land(p, size) if last else p)

    done, level, parts = None, 0, max((f[-1] for f in facts), default=1)
    while True:
        units = units.withColumn("part", F.pmod(F.xxhash64("key", "copy_no", F.lit(level)), F.col("parts")))
        flown = materialize(units.groupBy("source", "part").applyInPandas(fly, UNITS), "mix-flown")
        settled = flown.filter("p = 0 or p = 1")
        done = settled if done is None else done.unionByName(settled)
        if parts == 1:  # the largest number of groups of a source: all have landed
            break
        open_ = flown.filter("p > 0 and p < 1")
        n = open_.groupBy("source").agg(F.ceil(F.count("*") / group).alias("parts"))
        n = n.withColumnRenamed("source", "name")
        parts = n.agg(F.max("parts")).first()[0] or 1
        units = open_.join(n, open_.source.eqNullSafe(n.name)).drop("name")
        level += 1
    copies = F.col("base") + F.round("p").cast("long")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "key")
