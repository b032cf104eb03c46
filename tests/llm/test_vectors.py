"""Vector near-duplicates and exact top-k against brute force, with chunks, ties, repeats and odd components."""

import math

import numpy as np
import pytest

from weftspark.llm import neardup_vectors, topk

VECTORS = "vec_id long, embedding array<double>, label string, n_links long, key int"


def reach(n, links):
    up = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(up[a], up[b])
            changed |= up[a] != low or up[b] != low
            up[a] = up[b] = low
    return up


@pytest.mark.parametrize("chunk,threshold", [(neardup_vectors.CHUNK, 0.98), (5, 0.98), (16, 0.9)])
def test_near_duplicates_equal_brute_force(spark, chunk, threshold):
    rng = np.random.default_rng(chunk)
    base = rng.normal(size=(30, 24))
    x = np.concatenate([base, np.repeat(base[:4], 60, 0) + rng.normal(size=(240, 24)) * 0.06, np.repeat(base[7:8], 40, 0), base[10:14] * [[1e200], [1e-200], [1e300], [3.0]]])
    label = [None if i % 97 == 5 else "ab"[i % 2] for i in range(len(x))]
    # miss is far lower here, so that brute force must agree on every link
    rows = spark.createDataFrame([(3 * i, v.tolist(), lab, 0, 0) for i, (v, lab) in enumerate(zip(x, label))], VECTORS)
    got = {r.vec_id: r for r in neardup_vectors.near_duplicates(rows, threshold, chunk=chunk, miss=1e-9, width=7).collect()}
    u = neardup_vectors.unit(x)
    links = [(i, j) for i in range(len(x)) for j in range(i) if label[i] == label[j] and label[i] and u[i] @ u[j] >= threshold]
    n = np.bincount(np.array(links).ravel(), minlength=len(x))
    up = reach(len(x), links)
    assert len(links) > 1000 and len(got) == len(x)
    assert [(got[3 * i].n_links, got[3 * i].component_id, got[3 * i].kept) for i in range(len(x))] == [(n[i], 3 * up[i], up[i] == i) for i in range(len(x))]


def test_recall_at_the_threshold():
    # pairs whose cosine is the threshold meet in some band and pass the bound about as often as the plan says
    rng, met, n, dim = np.random.default_rng(8), 0, 4000, 64
    for size in (500, 10**6, 10**9):
        bits, bands = neardup_vectors.plan(size, 0.98)
        c = neardup_vectors.Codec(dim, bits, bands, 11)
        a = neardup_vectors.unit(rng.normal(size=(n, dim)))
        b = rng.normal(size=(n, dim))
        b = 0.98 * a + math.sqrt(1 - 0.98**2) * neardup_vectors.unit(b - (a * b).sum(1)[:, None] * a)
        x, y = c.encode(a), c.encode(b)
        met = (c.values(x) == c.values(y)).any(1)
        estimate = (c.signs(x) * c.levels(y)).sum(1) / 8 / x["factor"]
        passed = estimate >= c.floor(x, 0.98, 4.0) - c.rounding(y, 4.0) / x["factor"]
        assert met.mean() >= 0.995 and passed.mean() >= 0.999
        assert abs(estimate.mean() - 0.98) < 0.002  # unbiased


def test_near_duplicates_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (1, [-5.0, 1.0], "a"), (2, [2.0, 4.0], "a"), (3, [2.0, 4.0, 0.0], "a"), (None, [1.0, 2.0], "a"), (4, [1.0, nan], "a"), (5, [inf, 1.0], "a"), (6, None, "a"), (7, [0.0, 0.0], "a"), (8, [1.0, None], "a"), (9, [1.0, 2.0], None), (10, [], "a"), (11, [1.0, 2.0], "b"), (12, [-0.0, 1.0], "b"), (13, [0.0, 1.0], "b")]
    got = neardup_vectors.near_duplicates(spark.createDataFrame([(*r, 0, 0) for r in rows], VECTORS)).collect()
    assert len(got) == len(rows)
    alone = [(r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id not in (1, 2, 12, 13)]
    assert sorted(alone, key=str) == sorted([(r[0], 0, r[0]) for r in rows if r[0] not in (1, 2, 12, 13)], key=str)
    # of id 1 one of its two vectors counts, in all three rows alike
    assert len({(r.n_links, r.component_id) for r in got if r.vec_id == 1}) == 1
    assert {(r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id in (12, 13)} == {(12, 1, 12), (13, 1, 12)}
    assert neardup_vectors.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def best(x, ids, qids, k):
    want = []
    for q in qids:
        own = [int(v) for v in x[ids.index(q)]]
        score = [(max(-(2**63), min(2**63 - 1, sum(a * int(b) for a, b in zip(own, v)))), i) for v, i in zip(x, ids) if i != q and len(v) == len(own)]
        want += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(score, key=lambda t: (-t[0], t[1]))[:k])]
    return want


@pytest.mark.parametrize("bucket,block,span", [(7, 2, 25), (50, 100, 1000), (3, 1, 3)])
def test_top_k_equals_brute_force(spark, bucket, block, span):
    rng = np.random.default_rng(bucket)
    x = np.floor(rng.normal(size=(260, 6)) * rng.choice([1, 9, 80], 260)[:, None])
    x[40:60] = x[40]  # ties
    x[100] = 0
    x = [v.tolist() for v in x] + [rng.integers(-9, 9, 3).astype(float).tolist() for _ in range(20)]
    ids = list(range(len(x)))
    v = spark.createDataFrame(list(zip(ids, x)), "vec_id long, x array<double>")
    got = [tuple(r) for r in topk.top_k(v, v.filter("vec_id % 10 = 0"), 5, bucket=bucket, block=block, span=span).orderBy("query_id", "rank").collect()]
    assert got == best(x, ids, range(0, len(x), 10), 5)


def test_top_k_of_large_products(spark):
    rng = np.random.default_rng(3)
    x = [np.floor(v).tolist() for v in rng.normal(size=(60, 4)) * 10.0 ** rng.choice([1, 7, 9, 19, 300], 60)[:, None]]
    v = spark.createDataFrame(list(enumerate(x)), "vec_id long, x array<double>")
    got = [tuple(r) for r in topk.top_k(v, v.filter("vec_id % 5 = 0"), 3, bucket=8, block=4, span=20).orderBy("query_id", "rank").collect()]
    assert got == best(x, list(range(60)), range(0, 60, 5), 3)


def test_top_k_of_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0], 9), (1, [1.0, 2.0], 9), (1, [1.0, 2.0], 9), (2, None, 9), (3, [1.0, nan], 9), (4, [None, 1.0], 9), (None, [1.0, 1.0], 9), (5, [1e19, -1e300], 9), (6, [0.5, 0.001], 9)]
    v = topk.quantised(topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, norm int"), "vec_id", "embedding"))
    assert {r.vec_id: r.x for r in v.collect()}[6] == [128.0, 0.0]
    got = [tuple(r) for r in topk.top_k(v, v.filter("vec_id = 0"), 5).orderBy("rank").collect()]
    s = 256 * 256 * 5
    assert got == [(0, 1, 1, s), (0, 2, 1, s), (0, 3, 6, 128 * 256), (0, 4, 5, -(2**63))]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0 == topk.top_k(v, v.limit(0)).count()
