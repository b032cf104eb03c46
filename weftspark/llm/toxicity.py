"""Toxicity by maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, materialize, tune

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows that the model is fitted on, the first by a hash of the id.
SAMPLE = 20_000
#: Of the prior: pseudo-tokens in all. Evidence from which a term has a weight (signed root of the likelihood ratio); least
#: documents.
PRIOR, EVIDENCE, LEAST = 500.0, 4.0, 3
#: Lengths of word beginnings that stand in for words without a weight.
BEGINNINGS = (6, 5, 4)
CUT = 0.3


@dataclass
class Model:
    """words and beginnings: log-odds. drift: any other token. scale, area: of the extreme-value distribution of a
    clean text's best segment. slope, intercept: from evidence to a probability."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    drift: float = -0.05
    scale: float = 1.0
    area: float = 1.0
    slope: float = 1.0
    intercept: float = -3.0

    def weights(self, tokens: list[str]) -> list[tuple[int, float]]:
        """Position and log-odds of the tokens that have one."""
        get, short, out = self.words.get, self.beginnings, []
        for i, t in enumerate(tokens):
            w = get(t)
            if w is None:
                for n in BEGINNINGS:
                    if len(t) > n and (w := short.get(t[:n])) is not None:
                        break
                else:
                    continue
            out.append((i, w))
        return out

    def evidence(self, text: str | None) -> tuple[float, list[tuple[int, int, float]], int]:
        """Summed evidence of the significant segments, those segments (first, end token, score), and the token count."""
        tokens = WORD.findall((text or "").lower())
        found = segments(self.weights(tokens), self.drift)
        level = math.log(max(self.area * max(len(tokens), 1), 1.0))
        kept = [(a, b, s) for a, b, s in found if self.scale * s > level]
        return sum(self.scale * s - level for _, _, s in kept), kept, len(tokens)

    def score(self, text: str | None) -> float:
        z = self.slope * math.log1p(self.evidence(text)[0]) + self.intercept
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def segments(points: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments in linear time (Ruzzo and Tompa): (first token, end token, score).

    Tokens without a point score `drift`, below zero.
    """
    out: list[tuple[int, int, float, float]] = []  # first, end, total before, total after
    total, last = 0.0, 0
    for i, w in points:
        total += drift * (i - last)
        last = i + 1
        before, total = total, total + w
        if w <= 0:
            continue
        a, b, left, right = i, i + 1, before, total
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j -= 1
            if j < 0 or out[j][3] >= right:
                out.append((a, b, left, right))
                break
            a, left = out[j][0], out[j][2]
            del out[j:]
    return [(a, b, right - left) for a, b, left, right in out]


def log_odds(y1: np.ndarray, y0: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Log-odds of terms under an informative Dirichlet prior with their overall frequencies."""
    n1, n0 = y1.sum(), y0.sum()
    a = prior * (y1 + y0) / max(n1 + n0, 1)
    p1, p0 = y1 + a, y0 + a
    return np.log(p1 / np.maximum(n1 + prior - p1, 1e-9)) - np.log(p0 / np.maximum(n0 + prior - p0, 1e-9))


def likelihood(y1: np.ndarray, y0: np.ndarray, d1: float, d0: float) -> np.ndarray:
    """Root of the likelihood ratio of a term's documents among d1 and d0 documents."""
    e1, e0 = (y1 + y0) * d1 / (d1 + d0), (y1 + y0) * d0 / (d1 + d0)
    part = lambda y, e: np.where(y > 0, y * np.log(np.maximum(y, 1e-12) / np.maximum(e, 1e-12)), 0.0)
    return np.sqrt(np.maximum(0, 2 * (part(y1, e1) + part(y0, e0))))


def _counts(rows: DataFrame) -> DataFrame:
    """(term, kind, weighted documents of label 1, of label 0); kind 0 is a word, n a beginning of n letters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, y, w in zip(*(b.column(k).to_pylist() for k in ("text", "y", "w"))):
                terms = {(t, 0) for t in WORD.findall((text or "").lower())}
                terms |= {(t[:n], n) for t, _ in list(terms) for n in BEGINNINGS if len(t) > n}
                own = c[y]
                for t in terms:
                    own[t] += w
            both = list(c[0].keys() | c[1].keys())
            yield pa.record_batch({"term": pa.array([t for t, _ in both], pa.string()), "kind": pa.array([k for _, k in both], pa.int32()), "n1": pa.array([float(c[1][t]) for t in both], pa.float64()), "n0": pa.array([float(c[0][t]) for t in both], pa.float64())})

    return rows.mapInArrow(count, "term string, kind int, n1 double, n0 double").groupBy("term", "kind").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def _weighted(rows: DataFrame) -> DataFrame:
    """Copies share one vote: a row weighs 1 / rows with the same smallest hash of four words in sequence."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        for b in batches:
            keys = []
            for text in b.column("text").to_pylist():
                t = (text or "").lower().encode().split()
                keys.append(min((crc32(b" ".join(t[i : i + 4])) for i in range(max(1, len(t) - 3))), default=0))
            yield b.append_column("copy", pa.array(keys, pa.int64()))

    rows = materialize(rows.mapInArrow(key, "id long, text string, y int, copy long"), "toxic-sample")
    # one row a key at most, of a bounded sample: the texts stay where they are
    n = rows.groupBy("copy", "y").agg((1 / F.count("*")).alias("w"))
    return rows.join(F.broadcast(n), ["copy", "y"]).select("id", "text", "y", "w")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most `sample` labelled rows outside the held-out fold, chosen by a hash of the id.

    Of repeated labels of an id the largest counts; null labels and ids are left out. Without a row of either
    label the model gives every text its prior probability. Rows of equal id and text count as copies. A window over
    the sample is not needed: copies are counted by key, and the counts (one for each row of the sample at most) go to every task.
    """
    tune(docs.sparkSession)
    y = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (crc_fold(F.col(id_col)) != 2)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    y = y.orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most `sample` rows, so they can go to every executor
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(y), "id").select("id", "text", "y")
    rows = materialize(_weighted(rows.withColumn("id", F.col("id").cast("long"))), "toxic-weights")
    have = {r.y: r.n for r in rows.groupBy("y").agg(F.sum("w").alias("n")).collect()}
    model, n1, n0 = Model(), have.get(1, 0), have.get(0, 0)
    if not n1 or not n0:
        model.slope, model.intercept = 0.0, math.log((n1 + 0.5) / (n0 + 0.5 + 9 * (n1 + n0 == 0)))
        return model
    # terms of a bounded sample, in at least LEAST documents
    got = _counts(rows).filter(F.col("n1") + F.col("n0") >= LEAST).toPandas().sort_values(["kind", "term"])
    for kind, part in got.groupby("kind"):
        # counts are documents, so a text that repeats a word a thousand times weighs as any other
        y1, y0 = part["n1"].to_numpy(), part["n0"].to_numpy()
        d, keep = log_odds(y1, y0), likelihood(y1, y0, n1, n0) >= EVIDENCE
        into = model.words if kind == 0 else model.beginnings
        into.update((t, float(w)) for t, w in zip(part["term"].to_numpy()[keep], d[keep]))
    if any(w > 0 for w in model.words.values()):
        model.drift = -0.25 * float(np.median([w for w in model.words.values() if w > 0])) / 10

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text, y in zip(*(b.column(c).to_pylist() for c in ("id", "text", "y"))):
                tokens = WORD.findall((text or "").lower())
                out.append((max((s for *_, s in segments(model.weights(tokens), model.drift)), default=0.0), len(tokens), y))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.float64(), pa.int64(), pa.int32()))], names=["s", "n", "y"])

    # extreme values: P(best segment of a clean text > s) = 1 - exp(-area * tokens * exp(-scale * s))
    seen = rows.mapInArrow(best, "s double, n long, y int").toPandas().sort_values(["y", "n", "s"])
    clean = seen[(seen.y == 0) & (seen.n > 0)]
    s, n = clean.s.to_numpy(), clean.n.to_numpy(float)
    if len(s) > 1 and s.std() > 0:
        model.scale = math.pi / math.sqrt(6) / s.std()
        model.area = float(len(s) / (n * np.exp(-model.scale * s)).sum())  # its maximum likelihood for this scale

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"e": pa.array([model.evidence(t)[0] for t in b.column("text").to_pylist()], pa.float64()), "y": b.column("y")})

    seen = rows.mapInArrow(evidence, "e double, y int").toPandas()
    model.slope, model.intercept = _logistic(np.log1p(seen.e.to_numpy()), seen.y.to_numpy(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept by Newton's method."""
    design, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), design.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted and the significant passages of every whole text.

    A null or empty text has no segment and so the score of a text without evidence. held_out of a null id
    is false. Repeated rows are scored alike; other columns are ignored. The model holds the weighted
    terms of a bounded sample, and goes to the executors with the function.
    """
    tune(docs.sparkSession)
    shape = "doc_id long, score double, passages array<struct<first: int, end: int, score: double>>"
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, spans = [], []
            for text in b.column(1).to_pylist():
                e, found, _ = model.evidence(text)
                z = model.slope * math.log1p(e) + model.intercept
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                spans.append([{"first": x, "end": y, "score": s} for x, y, s in found])
            yield pa.record_batch({"doc_id": b.column(0), "score": pa.array(scores, pa.float64()), "passages": pa.array(spans, kind)})

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, shape)
    held = F.coalesce(crc_fold(F.col("doc_id")) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "passages")


def clean(docs: DataFrame, model: Model, cut: float = CUT, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below the cut, with the columns they came with."""
    tune(docs.sparkSession)
    schema = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t) < cut for t in b.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, schema)
