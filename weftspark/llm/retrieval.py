"""Packing by lexical retrieval: windows of neighbouring documents.

Texts are encoded where they are read. A document's whole windows stand alone; its rest is to be placed. The rests are sorted
by two min-hashes of their rarer terms and dealt by ranges, so that copies and close texts come to lie together, and each task
takes its range in shards of a fixed number of rests with a BM25 inverted index each. Frequencies of terms and the mean
length come from all documents. A window begins with the first unused rest of its shard (or what the last window left of one);
the index returns the unused rests nearest to it, which are placed in the order of their scores until the window is
full; the last one is cut there. What a task leaves at its end is cut into sequences whose lengths are powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytepieces import Terms, byte_encoder
from .common import materialize, partitions, tune

CAPACITY = 2048
#: Rests of one inverted index.
SHARD = 2048
#: Terms of a seed that are asked for: those with the largest weights.
ASKED = 32
#: Terms' document frequencies are counted by this many values of their hash, so what is broadcast has a fixed size. Terms
#: that share a value count together.
SLOTS = 1 << 20
K1, B = 1.2, 0.75
#: Ids of a task, least (where the session asks for that many tasks) and most.
IDS_LEAST, IDS_MOST = 1 << 22, 1 << 25

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: kind 0: a whole window; 1: a rest; 2: documents (length) with a term slot (start); 3: documents (start) and terms (length) of a task.
READ = f"kind int, {PIECES}, key long, ids binary"
_NAMES = [c.split()[0] for c in READ.split(", ")]


def slots(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(44)).astype(np.int64) & (SLOTS - 1)


def distinct(texts: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, how often) of each term of each text, by text and then term."""
    order = np.lexsort((terms, texts))
    d, t = texts[order], terms[order]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])])) if len(d) else np.zeros(0, np.int64)
    return d[new], t[new], np.diff(np.append(new, len(d)))


def document_frequencies(texts: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """How many of the texts have a term in each slot."""
    at = np.sort(texts * SLOTS + slots(terms))
    return np.bincount(at[np.concatenate([[True], at[1:] != at[:-1]])] % SLOTS if len(at) else at, minlength=SLOTS)


def sort_keys(n: int, texts: np.ndarray, terms: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Two min-hashes of each text's terms of several tokens (all terms, if it has none such), the first one above the second."""
    out = np.full((2, n), np.uint64(2**63 - 1), np.uint64)
    for k, by in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        h = terms * np.uint64(by)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h >>= np.uint64(33)
        rare = tokens > 1
        own = np.full(n, np.uint64(2**62), np.uint64)
        np.minimum.at(own, texts[rare], h[rare])
        rest = own == np.uint64(2**62)
        every = np.full(n, np.uint64(2**31 - 1), np.uint64)
        np.minimum.at(every, texts, h)
        out[k] = np.where(rest, every, own)
    return (out[0].astype(np.int64) << 31) | out[1].astype(np.int64)


class Index:
    """BM25 inverted index of one shard. `idf` gives the weight of each term slot over the corpus, `mean` the mean number of terms."""

    def __init__(self, n: int, texts: np.ndarray, terms: np.ndarray, idf: np.ndarray, mean: float):
        doc, term, tf = distinct(texts, terms)
        length = np.bincount(texts, minlength=n)[:n]
        self.n, self.doc = n, doc
        self.weight = idf[slots(term)] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(mean, 1e-9))))
        self.of_doc = np.searchsorted(doc, np.arange(n + 1))
        # the rows of each term, by term and then text
        self.rows = np.argsort(term, kind="stable")
        by_term = term[self.rows]
        begins = np.flatnonzero(np.concatenate([[True], by_term[1:] != by_term[:-1]])) if len(doc) else np.zeros(0, np.int64)
        self.begin = np.append(begins, len(doc))
        self.number = np.empty(len(doc), np.int64)  # of each row's term
        self.number[self.rows] = np.repeat(np.arange(len(begins)), np.diff(self.begin))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every text of the shard for the seed's terms with the largest weights (ties: by hash)."""
        own = np.arange(self.of_doc[seed], self.of_doc[seed + 1])
        if len(own) > ASKED:
            own = own[np.argsort(-self.weight[own], kind="stable")[:ASKED]]
        term = self.number[own]
        size = self.begin[term + 1] - self.begin[term]
        if not len(size):
            return np.zeros(self.n)
        ends = np.cumsum(size)
        rows = self.rows[np.repeat(self.begin[term] - (ends - size), size) + np.arange(ends[-1])]
        return np.bincount(self.doc[rows], self.weight[rows], self.n)

    def nearest(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused texts that share a term with the seed, best first, ties in order."""
        score = np.where(unused, self.scores(seed), 0.0)
        score[seed] = 0.0
        found = np.flatnonzero(score > 0)
        most = 32
        while len(found):
            # the best ones first, as a window seldom takes more
            top = found if len(found) <= most else found[score[found] >= np.partition(score[found], len(found) - most)[len(found) - most]]
            yield from top[np.argsort(-score[top], kind="stable")].tolist()
            score[top] = 0.0
            found, most = np.flatnonzero(score > 0), 8 * most


class Windows:
    """Fills one window after another; gives the rows of full ones."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next = capacity, base
        self.held: list[tuple] = []
        self.used = 0
        self.out: list[tuple] = []

    def put(self, text: tuple, at: int) -> int:
        """Place ids of (doc_id, start, doc_tokens, ids) from `at` on; returns where the window cut them."""
        ids = text[3]
        end = min(len(ids), at + self.capacity - self.used)
        self.held.append((text, at, end))
        self.used += end - at
        if self.used == self.capacity:
            self._close(self.held)
            self.held, self.used = [], 0
        return end

    def _close(self, held: list[tuple]) -> None:
        offset = 0
        for (doc, start, total, ids), a, b in held:
            self.out.append((doc, start + a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), total, self.next, offset))
            offset += b - a
        self.next += 1

    def finish(self) -> None:
        """What is left, in sequences whose lengths are powers of two."""
        held, left = self.held, self.used
        while left:
            room, now = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                text, a, b = held.pop(0)
                cut = min(b, a + room)
                now.append((text, a, cut))
                room -= cut - a
                if cut < b:
                    held.insert(0, (text, cut, b))
            self._close(now)
        self.held, self.used = [], 0


def fill(shard: list[tuple], index: Index, windows: Windows) -> None:
    """Place all texts of a shard."""
    n = len(shard)
    unused, first, cut = np.ones(n, bool), 0, None

    def place(i: int, at: int) -> tuple[int, int] | None:
        unused[i] = False
        end = windows.put(shard[i], at)
        return (i, end) if end < len(shard[i][3]) else None

    while True:
        while first < n and not unused[first]:
            first += 1
        if cut is None and first == n:
            return
        seed, at = cut or (first, 0)
        cut = place(seed, at)
        if cut or not windows.held:
            continue
        for i in index.nearest(seed, unused):
            cut = place(i, 0)
            if cut or not windows.held:
                break


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def read(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids, whole windows and counts of all documents, as READ says, written once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, sequence = byte_encoder(tokenizer, end_id), (1 << 62) + (TaskContext.get().partitionId() << 40)
        df, n_docs, n_terms = np.zeros(SLOTS, np.int64), 0, 0
        for b in batches:
            doc_ids, rows = b.column(0).to_pylist(), []
            e = enc.encode(b.column(1).to_pylist())
            keys = sort_keys(len(doc_ids), e.texts, e.terms, e.tokens)
            df += document_frequencies(e.texts, e.terms)
            n_docs, n_terms = n_docs + len(doc_ids), n_terms + len(e.terms)
            for doc, a, z, key in zip(doc_ids, e.bounds.tolist(), e.bounds[1:].tolist(), keys.tolist()):
                ids, total = e.ids[a:z], z - a
                for start in range(0, total - total % capacity, capacity):
                    rows.append((0, doc, start, capacity, zlib.crc32(ids[start : start + capacity].astype("<u4").tobytes()), total, sequence, 0, None, None))
                    sequence += 1
                if n := total % capacity:
                    raw = ids[total - n :].tobytes()
                    rows.append((1, doc, total - n, n, zlib.crc32(raw), total, None, None, key, raw))
            yield _batch(rows, READ)
        at = np.flatnonzero(df)
        none = lambda kind, n: pa.nulls(n, kind)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            n = len(part)
            yield pa.record_batch([pa.array(np.full(n, 2, np.int32)), none(pa.int64(), n), pa.array(part), pa.array(df[part]), *(none(pa.int64(), n) for _ in range(5)), none(pa.binary(), n)], names=_NAMES)
        yield _batch([(3, None, n_docs, n_terms, *[None] * 6)], READ)

    tune(docs.sparkSession)
    return materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, READ), "ids")


def statistics(found: DataFrame) -> tuple[np.ndarray, float]:
    """BM25's weight of each term slot, and the mean number of terms of a document, over all documents. SLOTS rows at most reach the driver."""
    counts = found.filter("kind = 2").groupBy("start").agg(F.sum("length").alias("n")).toArrow()
    df = np.zeros(SLOTS)
    df[counts.column("start").to_numpy()] = counts.column("n").to_numpy()
    total = found.filter("kind = 3").agg(F.sum("start"), F.sum("length")).first()
    n = total[0] or 0
    return np.log1p((n - df + 0.5) / (df + 0.5)), (total[1] or 0) / max(n, 1)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most `capacity` ids (PIECES).

    Each document's ids with its end id lie in its pieces without gap or overlap, and a sequence is full or its length is a power
    of two. A null or empty text has only its end id. Repeated ids are separate documents; null ids stay null; texts
    without terms are placed in their order; other columns are ignored; an empty table gives no rows. `capacity` is a power of two.
    """
    spark = docs.sparkSession
    found = read(docs, tokenizer, capacity, end_id, id_col, text_col)
    idf, mean = statistics(found)
    sent = spark.sparkContext.broadcast(idf.astype(np.float32))
    rests = found.filter("kind = 1").select("key", "doc_id", "start", "doc_tokens", "ids_crc32", "ids")
    n_ids = found.filter("kind = 1").agg(F.sum("length")).first()[0] or 0
    tasks = max(min(-(-n_ids // IDS_LEAST), partitions(spark)), -(-n_ids // IDS_MOST), 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lexicon, weights = byte_encoder(tokenizer, end_id).lexicon, sent.value
        windows = Windows(capacity, TaskContext.get().partitionId() << 40)
        held: list[tuple] = []

        def flush(texts: list[tuple]) -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(t[3]) for t in texts])
            first = np.cumsum(sizes) - sizes
            at, terms, _ = lexicon.of(np.concatenate([t[3] for t in texts]), first)
            real = terms > 0
            fill(texts, Index(len(texts), np.searchsorted(first, at[real], "right") - 1, terms[real], weights, mean), windows)
            rows, windows.out = windows.out, []
            yield _batch(rows, PIECES)

        for b in batches:
            for doc, start, total, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
                held.append((doc, start, total, np.frombuffer(raw, np.uint16)))
                if len(held) == shard:
                    yield from flush(held)
                    held = []
        if held:
            yield from flush(held)
        windows.finish()
        yield _batch(windows.out, PIECES)

    names = [c.split()[0] for c in PIECES.split(", ")]
    dealt = rests.repartitionByRange(tasks, "key", "ids_crc32", "doc_id").sortWithinPartitions("key", "ids_crc32", "doc_id")
    return found.filter("kind = 0").select(*names).unionByName(dealt.mapInArrow(place, PIECES))
