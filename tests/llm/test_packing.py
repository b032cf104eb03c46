"""Packing against exhaustive search, over several groups, and on odd rows."""

import numpy as np
import pytest

from weftspark.llm import packing
from weftspark.llm.wordpieces import Encoder, tokenizer_path


def least(lengths, capacity):
    """The smallest number of bins, by trying every placement."""
    best = len(lengths)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                put(i + 1, rooms[:k] + [rooms[k] - lengths[i]] + rooms[k + 1 :])
        put(i + 1, rooms + [capacity - lengths[i]])

    put(0, [])
    return best


def test_small_inputs_need_the_fewest_sequences_almost_always():
    rng, more = np.random.default_rng(2), 0
    for _ in range(150):
        lengths = np.sort(rng.integers(1, 21, rng.integers(1, 10)))[::-1]
        bins = packing.local_search(packing.best_fit(lengths, 20), lengths, 20)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and max(lengths[b].sum() for b in bins) <= 20
        more += len(bins) - least(lengths.tolist(), 20)
    assert more <= 2


def test_exchanges_empty_bins_that_best_fit_leaves():
    lengths = np.random.default_rng(5).integers(600, 1100, 600)
    before = packing.best_fit(lengths)
    after = packing.local_search(before, lengths)
    assert sorted(i for b in after for i in b) == list(range(600)) and max(lengths[b].sum() for b in after) <= packing.CAPACITY
    assert len(after) < len(before)


@pytest.mark.parametrize("group", [40, 200, packing.GROUP])
def test_groups_share_what_they_leave(spark, group):
    rng = np.random.default_rng(group)
    rows = [(int(i), 0, 0, int(n), i) for i, n in enumerate(rng.integers(1, 700, 900))]
    cut = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, deal int")
    got = packing.pack(cut, group=group).toPandas()
    assert sorted(zip(got.doc_id, got.length, got.ids_crc32)) == sorted((r[0], r[3], r[4]) for r in rows)
    q = got.sort_values(["sequence_id", "offset"])
    assert ((q.groupby("sequence_id").length.cumsum() - q.length) == q.offset).all()
    fill = got.groupby("sequence_id").length.sum()
    assert fill.max() <= packing.CAPACITY and len(fill) <= -(-fill.sum() // packing.CAPACITY) + 1


def test_odd_documents(spark):
    docs = spark.createDataFrame([(1, None, 0, "p"), (1, None, 0, "p"), (None, "a b", 0, "p"), (2, "word " * 5000, 0, "p"), (3, "", 0, "p")], "doc_id long, text string, pid int, piece string")
    cut = packing.pieces(docs, tokenizer_path())
    got = packing.pack(cut).toPandas()
    n = len(Encoder(tokenizer_path()).encode(["word " * 5000])[0]) // 4 + 1
    assert sorted(zip(got.doc_id.fillna(-1), got.piece, got.start, got.length)) == sorted([(1, 0, 0, 1), (1, 0, 0, 1), (-1, 0, 0, 3), (3, 0, 0, 1)] + [(2, k, 2048 * k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048))])
    assert packing.pack(packing.pieces(docs.limit(0), tokenizer_path())).count() == 0


def test_the_search_is_fast_where_best_fit_leaves_much(monkeypatch):
    """Lengths of which two seldom fill a sequence: a whole group in seconds, with fewer sequences than best fit has."""
    import time

    lengths = np.random.default_rng(0).integers(600, 1100, 8192)
    first = packing.best_fit(lengths)
    began = time.process_time()
    bins = packing.local_search(first, lengths)
    assert time.process_time() - began < 20
    assert sorted(i for b in bins for i in b) == list(range(8192)) and max(lengths[b].sum() for b in bins) <= 2048
    assert len(bins) <= 3688 < len(first)
