"""Vector codes against plain Python integers."""

import hashlib

import numpy as np
import pyarrow.parquet as pq

from weftspark.llm import codebooks
from weftspark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """(vec_id, code, error, label_error, sha) of (vec_id, vector, label) by the definition, with Python's integers."""
    import math

    kept = [(i, [math.floor(scale * float(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]

    def assign(part, p):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        sums = [[None] * len(first) for _ in range(parts)]
        for _, v, _ in kept:
            for p, part in enumerate(cut(v)):
                _, k = assign(part, p)
                n, s = sums[p][k] or (0, [0] * w)
                sums[p][k] = (n + 1, [a + b for a, b in zip(s, part)])
        books = [[e if sums[p][k] is None else [x // sums[p][k][0] for x in sums[p][k][1]] for k, e in enumerate(books[p])] for p in range(parts)]
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        at = [assign(part, p) for p, part in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in at), sum(d for d, _ in at), label))
    total = {}
    for *_, e, label in out:
        total[label] = total.get(label, 0) + e
    return sorted(((i, c, e, total[label], sha) for i, c, e, label in out), key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, code string")
    coded, books = codebooks.compress(df, **more)
    sha = books is not None and codebooks.checksum(books)
    return sorted(((r.vec_id, r.code, r.error, r.label_error, sha) for r in codebooks.with_label_errors(coded).collect()), key=str), books


def test_odd_rows_ties_and_repeats(spark):
    rng = np.random.default_rng(1)
    near = lambda k: (rng.integers(-3, 4, (k, 8)) / 1024 * 5).astype(np.float32)  # noqa: E731  many equal distances
    rows = [(int(i), v.tolist(), int(i) % 3 or None) for i, v in enumerate(near(90))]
    rows += [(5, near(1)[0].tolist(), 1), (5, rows[5][1], 1), (None, near(1)[0].tolist(), None), (201, None, 1), (202, [1.0] * 7 + [None], 1), (203, [1.0] * 7 + [float("nan")], 1), (204, [float("inf")] * 8, None)]
    for entries, rounds in ((16, 4), (256, 2), (1, 1)):
        got, _ = run(spark, rows, entries=entries, rounds=rounds)
        assert got == plain(rows, entries=entries, rounds=rounds)
    assert run(spark, [])[0] == [] and run(spark, rows[-4:])[0] == []


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist(), 0) for i, v in enumerate((rng.standard_normal((60, 8)) * 20_000).astype(np.float32))]
    assert run(spark, rows, entries=8)[0] == plain(rows, entries=8)
    x = rng.integers(-(2**26), 2**26, (50, 4))
    k, d = codebooks.nearest(x, x[:7])
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, e)), j) for j, e in enumerate(x[:7])) for v in x]
    assert list(zip(d.tolist(), k.tolist())) == want


def test_codes_stand_for_entries(spark):
    rows = [(i, [float(i % 5)] * 4, 0) for i in range(40)]
    got, books = run(spark, rows)
    assert all(e == 0 for _, _, e, _, _ in got)
    assert {tuple(codebooks.decode(c, books)) for _, c, *_ in got} == {(1024 * k,) * 4 for k in range(5)}


def test_query_equals_plain_python(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{DATA}/embeddings.parquet").to_pylist()]
    got = QUERIES["op11_vector_codes"](spark, DATA).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
