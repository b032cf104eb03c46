"""Periodic runs against a search over all stretches, and the query against plain Python."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from weftspark.llm import periodic
from weftspark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plain(words, least=6, repeats=4):
    """Every maximal stretch with its smallest period, from the definition."""
    n, out = len(words), set()
    for q in range(1, n // repeats + 1):
        begin = 0
        while begin + q < n:
            end = begin + q
            while end < n and words[end] == words[end - q]:
                end += 1
            own = words[begin:end]
            if len(own) >= max(least, repeats * q) and not any(own[d:] == own[:-d] for d in range(1, q)):
                out.add((begin, end - begin, q))
            begin = max(begin + 1, end - q + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbers(words):
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


@pytest.mark.parametrize("letters", [1, 2, 3, 40])
def test_random_words(letters):
    r = random.Random(letters)
    for _ in range(400):
        w = [r.randrange(letters) for _ in range(r.randrange(60))]
        if r.random() < 0.7 and w:
            at, p = r.randrange(len(w)), r.randrange(1, 9)
            w[at:at] = (w[at : at + p] * 9)[: r.randrange(1, 60)]
        for least, repeats in ((6, 4), (2, 2), (9, 3)):
            assert periodic.find(numbers(w), least, repeats) == plain(w, least, repeats), w


def test_long_documents_skip_lags_exactly(monkeypatch):
    r = random.Random(5)
    w = [r.randrange(50) for _ in range(900)]
    w[100:100] = [r.randrange(50) for _ in range(37)] * 6
    w[700:700] = [1, 2] * 40
    whole = periodic.find(numbers(w))
    monkeypatch.setattr(periodic, "LONG", 10)
    assert periodic.find(numbers(w)) == whole == plain(w) and len(whole) >= 2


def test_a_very_long_text():
    w = ["a"] * 30_000 + list("xyz") * 20_000
    assert periodic.find(numbers(w)) == [(0, 30_000, 1), (30_000, 60_000, 3)]


def by_hand(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), None if doc is None else zlib.crc32(str(doc).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_plain_python(spark):
    rows = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    got = QUERIES["op13_periodic_runs"](spark, DATA)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(by_hand(r["doc_id"], r["text"]) for r in rows)


def test_odd_rows(spark, tmp_path):
    tenth = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = [None, "", " \t\n", "one", "a a a a a a", "a\x0ba\x0ca\ra a\xa0a a", "x y " * 40, "é ß " * 3 + "é ß é ß é", "w" * 5000 + " v" * 300, "a b c d e f g h i j k l m n"]
    rows = [(i, t) for i in [*tenth[:6], 1, 2, None, 1] for t in texts]
    odd = spark.createDataFrame([(i, t, "n_runs", "words") for i, t in rows], "doc_id long, text string, runs string, best string")
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str(by_hand(i, t)) for i, t in rows)
    assert periodic.digest(periodic.runs(odd.limit(0))).count() == 0


def test_real_outputs(spark):
    r = periodic.runs(spark.createDataFrame([(7, "go " + "to be " * 5 + "or not")], "doc_id long, text string")).first()
    assert (r.n_words, [tuple(x) for x in r.runs], tuple(r.best), r.collapsed) == (13, [(1, 10, 2)], (1, 10, 2), "go to be or not")
