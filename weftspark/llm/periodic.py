"""Periodic runs of words by bit-parallel lags.

A run is a stretch of consecutive words with smallest period q and at least `repeats` periods (and `least` words) that no
neighbouring word extends. The words of a document are numbered and the numbers' bits kept as planes, big integers with one
bit a word. For each lag q the planes are XORed with themselves shifted by q and ORed: a zero is a word that equals the one q
later. ANDs with shifts that double keep only zeros that begin a stretch long enough, so a lag without a run ends after a few
operations on whole integers.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

LEAST, REPEATS = 6, 4
#: Planes after which a lag is first tested; the others are read only where these leave a stretch.
FIRST = 4
#: In documents of more words, lags are first tried on the multiples of the lag.
LONG = 4096

RUN = "struct<start: long, length: long, period: long>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, best {RUN}, collapsed string"


def planes(ids: np.ndarray) -> list[int]:
    """Bit i of plane j is bit j of the number of word i."""
    return [int.from_bytes(np.packbits((ids >> j) & 1, bitorder="little").tobytes(), "little") for j in range(max(1, int(ids.max()).bit_length()))]


def _stretches(same: int, need: int) -> int:
    """The positions from which `need` ones follow in a row."""
    have = 1
    while same and have < need:
        step = min(have, need - have)
        same &= same >> step
        have += step
    return same


def _recurs(ids: np.ndarray, lag: int, repeats: int) -> bool:
    """Whether a run of this period is possible: a run covers `repeats - 1` multiples of its period in a row, each of
    which equals the next one."""
    at = ids[::lag]
    same = at[1:] == at[:-1]
    ahead = same[: max(0, len(same) - repeats + 2)].copy()
    for k in range(1, repeats - 1):
        ahead &= same[k : k + len(ahead)]
    return bool(ahead.any())


def find(ids: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and then period. `repeats` is at least 2."""
    n = len(ids)
    if n < max(least, repeats):
        return []
    bits, out = planes(ids), []
    seen: dict[int, tuple[list[int], list[int]]] = {}  # starts and ends of every stretch with a period, also a multiple of a smaller one
    for lag in range(1, n // repeats + 1):
        if n > LONG and not _recurs(ids, lag, repeats):
            continue
        need, mask = max(least, repeats * lag) - lag, (1 << (n - lag)) - 1
        differs, starts = 0, 0
        for k, p in enumerate(bits, 1):
            differs |= p ^ (p >> lag)
            if k == FIRST and k < len(bits) and not _stretches(mask & ~differs, need):
                break
        else:
            starts = _stretches(mask & ~differs, need)
        while starts:
            begin = (starts & -starts).bit_length() - 1
            rest = starts >> begin
            more = (~rest & (rest + 1)).bit_length() - 1  # ones in a row
            starts = rest >> more << (begin + more)
            end = begin + more - 1 + need + lag
            firsts, lasts = seen.setdefault(lag, ([], []))
            firsts.append(begin)
            lasts.append(end)
            if not any(_within(seen.get(lag // prime), begin, end) for prime in _primes(lag)):
                out.append((begin, end - begin, lag))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def _within(known: tuple[list[int], list[int]] | None, begin: int, end: int) -> bool:
    """Whether a known stretch holds this one. A stretch of 2 q words or more whose smallest period is not q has it among
    the divisors of q, so it has a period q / p with a prime p."""
    if not known:
        return False
    k = bisect_right(known[0], begin) - 1
    return k >= 0 and known[1][k] >= end


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; ties: smallest start, then period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that any run repeats, joined by one space."""
    if not found:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    return b" ".join([w for w, d in zip(words, np.cumsum(drop).tolist()) if not d])


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """One row a document: its words, runs (by start, then period), strongest run and text without repeated words.

    Words are what stands between ASCII white space. A null or empty text has no words, no runs (an empty array) and an
    empty collapsed text; its strongest run is null. Null and repeated ids keep one row each; other columns are ignored; an
    empty table gives no rows. Texts stay in the task that reads them: nothing is shuffled.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_run = lambda r: dict(zip(("start", "length", "period"), r))
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for b in batches:
            counts, all_runs, bests, texts = [], [], [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                numbers: dict[bytes, int] = {}
                number = numbers.setdefault
                ids = np.array([number(w, len(numbers)) for w in words], np.int64)
                found = find(ids, least, repeats) if len(numbers) < len(words) else []
                best = strongest(found)
                counts.append(len(words))
                all_runs.append([as_run(r) for r in found])
                bests.append(best and as_run(best))
                texts.append(collapse(words, found))
            yield pa.record_batch({"doc_id": b.column(0), "n_words": pa.array(counts, pa.int64()), "runs": pa.array(all_runs, pa.list_(kind)), "best": pa.array(bests, kind), "collapsed": pa.array(texts, pa.binary()).cast(pa.string())})

    tune(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, SCHEMA)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by the checksum h of its id repeats a stretch to its end, as the query's contract says.

    With n words and g = h / 10: word i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + (n - a) / (3 + g % 8).
    A null id has no checksum and its text stays, as do texts without words.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    at = F.col("x")["a"] + (F.col("i") - F.col("x")["a"]) % F.col("x")["p"]

    def repeated(own):
        n, g = F.size(own).cast("long"), F.floor(h / 10)
        a = F.try_mod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        again = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(own, again(i).cast("int"))), " ")
        return F.when(n > 0, text)

    planted = F.element_at(F.transform(F.array(words), repeated), 1)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when((h % 10 == 0) & F.col("text").isNotNull(), F.coalesce(planted, F.col("text"))).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the strongest run and checksums of runs() in place of its arrays and texts."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = [F.col("best")[c].alias(c) for c in ("start", "length", "period")]
    milli = F.expr("best.length * 1000 div best.period").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
