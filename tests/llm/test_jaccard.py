"""The n-gram join on null and repeated ids, exact copies and shared passages, against brute force."""

import numpy as np
import pytest

from weftspark.llm import jaccard

DOCS = "doc_id long, text string, fp string, th int, comp long"


def shingles(t, n):
    w = (t or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def by_definition(rows, n, threshold):
    """(id, shingles, smallest id reachable) of every row; rows that share an id are one document."""
    s = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and (rows[i][0] is not None and rows[i][0] == rows[j][0] or 100 * len(s[i] & s[j]) >= threshold * len(s[i] | s[j])):
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(((k, len(s[i]), k if not s[i] else least.get(root(i))) for i, (k, _) in enumerate(rows)), key=str)


def corpus(seed, passage):
    """Texts around a passage that most share, with copies and near copies."""
    rng, rows = np.random.default_rng(seed), []
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    common = words(passage)
    for _ in range(60):
        own = words(int(rng.integers(1, 60)))
        rows.append(common + own)
        for c in range(int(rng.integers(0, 4))):
            t = common + own
            for i in rng.integers(0, len(t), c):
                t[i] = "changed"
            rows.append(t)
    return [(int(i), " ".join(rows[i])) for i in rng.permutation(len(rows))]


@pytest.mark.parametrize("passage,part,few", [(0, 512, 6), (60, 512, 2), (60, 7, 6), (200, 5, 2)])
def test_groups_equal_brute_force(spark, monkeypatch, passage, part, few):
    monkeypatch.setattr(jaccard, "PART", part)
    monkeypatch.setattr(jaccard, "COMMON", few)
    rows = corpus(passage + part, passage)
    rows += [(None, rows[3][1]), (None, rows[3][1]), (None, "only without an id stands here"), (None, "Only without an id  stands here"), (rows[5][0], "another text of that id"), (rows[5][0], rows[9][1]), (900, None), (900, " \t"), (901, rows[7][1].upper()), (902, "x " * 30_000)]
    got = jaccard.join(spark.createDataFrame([(*r, "f", 1, 2) for r in rows], DOCS)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == by_definition(rows, 5, 80)


def test_one_row_of_each_group_stays(spark):
    text = "these are more than five words of text"
    rows = [(3, text), (3, text), (5, text.upper()), (None, text), (None, "nobody numbered this text at all"), (None, "nobody numbered this text at all"), (8, None), (8, None), (9, ""), (4, "a text that is near to none of the others")]
    docs = spark.createDataFrame([(*r, "f", 1, 2) for r in rows], DOCS)
    got = jaccard.representatives(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, text), (None, rows[4][1]), (8, None), (8, None), (9, ""), (4, rows[-1][1])], key=str)
    assert jaccard.representatives(docs.limit(0)).count() == 0


def test_blocks_that_differ_are_no_more_than_elements():
    rng, bands = np.random.default_rng(1), jaccard.Bands(80)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
        b = np.unique(np.concatenate([a[int(rng.integers(0, 30)) :], rng.integers(0, 2**63, int(rng.integers(0, 30))).astype(np.uint64)]))
        for (x, _, _), (y, _, _) in zip(jaccard.all_blocks(a, bands)[:1], jaccard.all_blocks(b, bands)[:1]):
            if len(x) == len(y):
                assert (x != y).sum() <= len(np.setxor1d(a, b))
