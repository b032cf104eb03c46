"""Best-fit packing with a swap-based local search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tune
from .wordpieces import encoder

CAPACITY = 2048
#: Pieces that one task packs together, and sequences, the emptiest, that such a group gives back to be packed with other groups'.
GROUP, OPEN = 8192, 16

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the fullest bin that still takes it. Returns items of each bin."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has r tokens left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n << n
        if fits:
            room = (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - n
        by_room[left].append(b)
        rooms |= 1 << left
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Empty bins by moves and one-for-one and two-for-one exchanges between underfull bins.

    The emptiest bins give in turn: an item moves to the fullest bin with room for it, or it, or two of its items
    together, are exchanged for a shorter item of another bin. Each step moves tokens from the emptier to the
    fuller bin, so the sum of squared fills rises and the search ends. It stops at the bound that the total
    length sets, or when every underfull bin has given once and nothing moved.
    """
    lengths = np.asarray(lengths, np.int64)
    home = np.empty(len(lengths), np.int64)
    for k, b in enumerate(bins):
        home[b] = k
    fill = np.bincount(home, lengths, len(bins)).astype(np.int64)
    gives = fill < capacity  # bins that still take part in this pass; fills and homes change in place
    left = int(gives.sum())  # underfull bins, also those that have given
    least = -(-int(fill[gives].sum()) // capacity)
    before, waiting = -1, np.zeros(len(bins), bool)
    while left > max(least, 1):
        if gives.sum() < 2:  # all have given: one more pass if this one moved anything
            gives, waiting = gives | waiting, np.zeros(len(bins), bool)
            squares = int((fill[gives] ** 2).sum())
            if squares <= before or gives.sum() < 2:
                break
            before = squares
        own = int(np.argmin(np.where(gives, fill, capacity + 1)))
        gives[own] = False
        giver = np.flatnonzero(home == own).tolist()
        while giver and (_move(giver, own, home, fill, gives, lengths, capacity) or _exchange(giver, own, home, fill, gives, lengths, capacity)):
            pass
        if giver:
            waiting[own] = True  # no step empties it as the others are now
        else:
            left -= 1
    order = np.argsort(home, kind="stable")
    cuts = np.flatnonzero(np.diff(home[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)] if len(order) else []


def _move(giver: list[int], own: int, home: np.ndarray, fill: np.ndarray, gives: np.ndarray, lengths: np.ndarray, capacity: int) -> bool:
    """Move the longest item that fits anywhere to the fullest bin with room for it."""
    room = capacity - fill[gives].min(initial=capacity)
    for i in sorted(giver, key=lambda i: -lengths[i]):
        if lengths[i] > room:
            continue
        b = int(np.argmax(np.where(gives & (fill <= capacity - lengths[i]), fill, -1)))
        giver.remove(i)
        home[i] = b
        fill[b] += lengths[i]
        fill[own] -= lengths[i]
        return True
    return False


def _exchange(giver: list[int], own: int, home: np.ndarray, fill: np.ndarray, gives: np.ndarray, lengths: np.ndarray, capacity: int) -> bool:
    """Give one or two items for a shorter one of a bin that they then fill best, the longest offers first."""
    offers: dict[int, tuple] = {}  # one of each total: equal totals allow the same exchanges
    one: dict[int, list[int]] = {}
    for i in giver:
        one.setdefault(int(lengths[i]), []).append(i)
    for x, a in one.items():
        offers.setdefault(x, (a[0],))
        for y, b in one.items():
            if x < y or x == y and len(a) > 1:
                offers.setdefault(x + y, (a[0], b[0] if x < y else a[1]))
    items = np.flatnonzero(gives[home])
    if not len(items):
        return False
    size, at = lengths[items], fill[home[items]]
    most, held = size + capacity - at, fill[own]  # the longest offer that an item's bin can take for it
    for n in sorted(offers, reverse=True):
        good = np.flatnonzero((size < n) & (n <= most) & (at + n - size > held))
        if not len(good):
            continue
        back = int(items[good[np.argmin(size[good])]])
        b, offer = int(home[back]), offers[n]
        gain = n - int(lengths[back])
        for i in offer:
            giver.remove(i)
            home[i] = b
        giver.append(back)
        home[back] = own
        fill[b] += gain
        fill[own] -= gain
        return True
    return False


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every document: whole if it fits, else cut at each `capacity` ids. A null text is empty."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, raw in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    tune(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Place every row of pieces() in a sequence of at most `capacity` ids, as few as can be found.

    Pieces are dealt by a random key in groups of about `group` and each group is packed alone; the emptiest OPEN sequences
    of each are then opened, and their pieces packed together in the same way until one group is left. Ties are
    broken by (doc_id, piece); repeated ids are separate documents; other columns are ignored; an empty table gives no rows.
    """
    names = [c.split()[0] for c in PIECES.split(", ")]
    cut = materialize(cut.select(*names).withColumn("pid", F.monotonically_increasing_id()), "pieces")

    def placer(level: int, last: bool):
        def place(t: pa.Table) -> pa.Table:
            t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("pid", "ascending")])
            lengths = t.column("length").to_numpy()
            bins = local_search(best_fit(lengths, capacity), lengths, capacity)
            fill = np.array([int(lengths[b].sum()) for b in bins])
            open_ = set() if last else {int(k) for k in np.argsort(fill, kind="stable")[:OPEN] if fill[k] < capacity}
            seq, off, again = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), np.zeros(len(lengths), bool)
            for k, b in enumerate(bins):
                seq[b], again[b] = k, k in open_
                off[b] = np.cumsum(lengths[b]) - lengths[b]
            seq += (level << 56) + (t.column("deal")[0].as_py() << 32)
            return t.drop_columns(["deal"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off)).append_column("again", pa.array(again))

        return place

    level, rest, done, n = 0, cut, None, cut.count()
    while True:
        groups = max(1, -(-n // group))
        dealt = rest.withColumn("deal", F.pmod(F.xxhash64("pid", F.lit(level)), F.lit(groups)))
        placed = dealt.groupBy("deal").applyInArrow(placer(level, groups == 1), f"{PIECES}, pid long, sequence_id long, offset long, again boolean")
        placed = placed if groups == 1 else materialize(placed, "packed")
        settled = placed.filter("not again").drop("pid", "again")
        done = settled if done is None else done.unionByName(settled)
        if groups == 1:
            return done
        rest, level = placed.filter("again").select(*names, "pid"), level + 1
        n = rest.count()
