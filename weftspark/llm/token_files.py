"""Token-ID output: Arrow stream files of fixed-size-list batches.

A file is one Arrow IPC stream. Each row is a sequence of exactly `length` ids and its mask; every batch but
the last has the same number of rows and so the same number of bytes, which places batch i at
`head + i * step` without an index. Over a memory map a sequence is a slice of the mapped file (no copy).
Documents follow each other without gaps; only a file's last sequence is padded (mask false).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, materialize, partitions, scratch, tune
from .wordpieces import encoder

LENGTH, ROWS = 2048, 64


class SequenceWriter:
    def __init__(self, uri: str, kind: str = "uint16", length: int = LENGTH, rows: int = ROWS):
        fs, path = filesystem(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.length, self.rows, self.dtype = length, rows, np.dtype(kind)
        self.schema = pa.schema(
            [("ids", pa.list_(pa.field("item", pa.from_numpy_dtype(self.dtype), False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))],
            metadata={"length": str(length), "rows": str(rows)},
        )
        self.sink = fs.open_output_stream(path)
        self.out = pa.ipc.new_stream(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.total = 0

    def append(self, ids: np.ndarray) -> int:
        """Add a document's ids; returns where it starts in this file."""
        begin = self.total
        if len(ids) and int(ids.max()) > np.iinfo(self.dtype).max:
            raise ValueError(f"an id does not fit {self.dtype}")
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        self.total += len(ids)
        size = self.length * self.rows
        if self.n_held >= size:
            flat = np.concatenate(self.held)
            whole = len(flat) // size * size
            for i in range(0, whole, size):
                self._write(flat[i : i + size], size)
            self.held, self.n_held = [flat[whole:]], len(flat) - whole
        return begin

    def _write(self, ids: np.ndarray, used: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:used] = True
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=self.schema.field(i).type) for i, x in enumerate((ids, mask))]
        self.out.write_batch(pa.record_batch(cols, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            pad = -len(flat) % self.length
            self._write(np.concatenate([flat, np.zeros(pad, self.dtype)]), len(flat))
        self.out.close()
        self.sink.close()


class SequenceReader:
    """Random access to the sequences and to any range of ids of one file."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        self.schema = pa.ipc.read_schema(self.file)
        self.length, self.rows = (int(self.schema.metadata[k]) for k in (b"length", b"rows"))
        self.head, self.step, self.at, self.batch = self.file.tell(), 0, -1, None

    def _batch(self, i: int) -> pa.RecordBatch:
        if i != self.at:
            if not self.step:
                self.file.seek(self.head)
                pa.ipc.read_message(self.file)
                self.step = self.file.tell() - self.head
            self.file.seek(self.head + i * self.step)
            self.batch, self.at = pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema), i
        return self.batch

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i; the ids are a view of the file."""
        b, k = self._batch(i // self.rows), i % self.rows
        at = slice(k * self.length, (k + 1) * self.length)
        return b.column(0).values.to_numpy()[at], b.column(1).values.to_numpy(zero_copy_only=False)[at]

    def ids(self, start: int, n: int) -> np.ndarray:
        size, out = self.length * self.rows, []
        while n > 0:
            flat = self._batch(start // size).column(0).values.to_numpy()
            part = flat[start % size : start % size + n]
            if not len(part):
                raise ValueError("the file ends before the document does")
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


INDEX = "shard int, path string, doc_id long, local long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


ENCODED = "shard int, doc_id long, ids binary"
#: Stands for a null id when ranges are made.
LEAST = -(1 << 63)


def _bounds(ids: DataFrame, shards: int) -> np.ndarray:
    """The last id of each shard but the last one; an id of many rows ends several shards. Reads the ids only."""
    if shards < 2:
        return np.zeros(0, np.int64)
    at = [i / shards for i in range(1, shards)]
    found = ids.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(LEAST)), at, max(10_000, 100 * shards)).alias("at")).first()["at"]
    return np.sort(np.array(found or [], np.int64))


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, kind: str = "uint16", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every document's ids, in ascending id order over all shards; returns the index (one row a document).

    Texts are encoded where they are read, and only their ids are dealt, by ranges of the document id, so shard order
    is id order; the rows of an id that fills several ranges are spread over these by a checksum of their ids. A null
    text is empty (only the end id); null ids come first, beside the least long; repeated ids keep one entry a row, in an order
    that only their ids set; other columns are ignored.
    Each attempt of a task writes a file of its own, and the index names those of the attempts that counted.
    """
    spark, dtype = docs.sparkSession, np.dtype(kind)
    tune(spark)
    folder = scratch(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shards = partitions(spark)
    bounds = _bounds(rows.select("doc_id"), shards)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last = encoder(tokenizer), np.array([end_id], np.uint32)
        for b in batches:
            whole = [np.concatenate([np.frombuffer(raw, np.uint32), last]) for raw in enc.encode(b.column(1).to_pylist())]
            if any(int(ids.max()) > np.iinfo(dtype).max for ids in whole):
                raise ValueError(f"an id does not fit {dtype}")
            packed = [ids.astype(dtype).tobytes() for ids in whole]
            own = b.column(0).cast(pa.int64()).fill_null(LEAST).to_numpy()
            low, high = np.searchsorted(bounds, own, "left"), np.searchsorted(bounds, own, "right")
            mark = np.fromiter(map(zlib.crc32, packed), np.int64, len(packed))
            shard = low + (mark * (high - low + 1) >> 32)
            yield pa.record_batch({"shard": pa.array(shard, pa.int32()), "doc_id": b.column(0).cast(pa.int64()), "ids": pa.array(packed, pa.binary())})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, out = TaskContext.get().partitionId(), None
        uri = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.arrows"
        for b in batches:
            out = out or SequenceWriter(uri, kind)
            whole = [np.frombuffer(raw, dtype) for raw in b.column(1).to_pylist()]
            local, n = [out.append(ids) for ids in whole], list(map(len, whole))
            yield pa.record_batch({"shard": pa.array([shard] * len(n), pa.int32()), "path": pa.array([uri] * len(n)), "doc_id": b.column(0), "local": pa.array(local, pa.int64()), "n_tokens": pa.array(n, pa.int64())})
        if out:
            out.close()

    dealt = rows.mapInArrow(encode, ENCODED).repartitionById(shards, "shard").sortWithinPartitions("doc_id", "ids")
    return materialize(dealt.select("doc_id", "ids").mapInArrow(write, INDEX), "token-index")


def read_tokens(index: DataFrame) -> DataFrame:
    """Read the documents of write_tokens() back from their files: id, first position over all shards, ids and crc."""
    spark = index.sparkSession
    base, rows = 0, []
    # one row a shard: as many as tasks wrote, whatever the number of documents
    for r in sorted(index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()):
        rows.append((r.shard, base))
        base += r.n
    bases = dict(rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file = None, None
        for b in batches:
            start, crc = [], []
            for shard, path, local, n in zip(*(b.column(c).to_pylist() for c in ("shard", "path", "local", "n_tokens"))):
                if path != at:
                    at, file = path, SequenceReader(path)
                crc.append(zlib.crc32(file.ids(local, n).astype("<u4").tobytes()))
                start.append(bases[shard] + local)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "start": pa.array(start, pa.int64()), "n_tokens": b.column("n_tokens"), "ids_crc32": pa.array(crc, pa.int64())})

    tune(spark)
    return index.mapInArrow(read, READ)
