"""N-gram Jaccard join by parity sketches.

A shingle flips one bit of a sketch, so the Hamming distance of two sketches is at most the size of the sets'
symmetric difference, and that is at most (100 - t) (a + b) / (100 + t) for linked sets of sizes a and b. Sets
meet in bands of similar size. Within a band the sketch is cut into blocks, more than may differ. Blocks are
ordered, those that many texts share last (shared passages fill them) and else those of many elements first, as they say
most; a set emits one more than may differ, so linked sets
share one (pigeonhole, as in prefix filtering). Sets that share a block are compared by the Hamming distance of a
short whole sketch, and where blocks hold several components by that of a longer one, in which fewer differences
cancel; what passes is verified on the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, batched, materialize, release
from .components import components

#: Words of a shingle, and the least similarity of linked sets in hundredths.
N, THRESHOLD = 5, 80
#: Bits of a sketch block; a block's key is the exclusive or of a mix of its set bits.
BLOCK_BITS = 4096
#: Parts of a stored sketch, four bits an allowed difference each; their exclusive or is the short sketch.
PARTS = 4
#: A band holds sizes up to this many times its least.
RATIO = 1.5
#: Sets of a block that one task holds; a larger block is cut into parts, and parts are compared in pairs.
PART = 512
#: Rows, of 24 bytes each, up to which the sets in question are sent to every executor (10 MB); more of them are joined by a
#: shuffle of the texts.
BROADCAST_ROWS = 400_000
#: Texts in which common blocks are counted, how many of them make a block common, and the most common blocks that are told
#: apart. They settle the order in which sets emit their blocks, never what is found.
SAMPLE, COMMON, COMMONS = 4096, 6, 100_000

_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of the whole sequence if it is shorter."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h + w[i : len(w) - k + 1 + i] * _C[i % 8])
    return np.unique(h)


class Bands:
    """Size bands, and the numbers of blocks and sketch bits that follow from the threshold."""

    def __init__(self, threshold: int = THRESHOLD, ratio: float = RATIO):
        self.t, self.starts = threshold, [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * ratio)))

    def bound(self, a, b):
        """The largest symmetric difference of linked sets of sizes a and b."""
        return (100 - self.t) * (a + b) // (100 + self.t)

    def of(self, size: int) -> list[tuple[int, int]]:
        """The bands in which a set meets others, and how many elements may differ there."""
        k = int(np.searchsorted(self.starts, size, side="right")) - 1
        most = size * 100 // self.t  # the largest partner
        out = [(k, self.bound(size, min(most, self.starts[k + 1] - 1)))]
        if most >= self.starts[k + 1]:
            out.append((k + 1, self.bound(size, most)))
        return out

    def blocks(self, k: int) -> int:
        d = self.bound(self.starts[k + 1] - 1, self.starts[k + 1] - 1)
        return d + 1 + (d + 1) // 4

    def words(self, k: int) -> int:
        """64-bit words of the short sketch: about four bits an allowed difference."""
        d = self.bound(self.starts[k + 1] - 1, self.starts[k + 1] - 1)
        return max(1, -(-4 * (d + 1) // 64))


def sketch(h: np.ndarray, words: int) -> np.ndarray:
    """The parity sketch of 64 * words bits."""
    bit = mix(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(64 * words)
    odd = np.bincount(bit.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def all_blocks(h: np.ndarray, bands: Bands) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(keys, elements, emitted) of the blocks of a set in each of its bands; empty blocks count as equal.

    A key names the block, what it holds (up to pairs of elements that share a bit) and how many elements that is; its
    low seven bits are the band.
    """
    out = []
    g = mix(h + _C[4])
    bit = (g >> np.uint64(40)) % np.uint64(BLOCK_BITS)
    for k, differ in bands.of(len(h)):
        blocks = bands.blocks(k)
        block = (g % np.uint64(blocks)).astype(np.int64)
        key = np.zeros(blocks, np.uint64)
        np.bitwise_xor.at(key, block, mix((bit + np.uint64(1)) * _C[0] + block.astype(np.uint64) * _C[1]))
        held = np.bincount(block, minlength=blocks)
        key = mix(key + np.arange(blocks, dtype=np.uint64) * _C[2] + held.astype(np.uint64) * _C[5])
        out.append((key & ~np.uint64(127) | np.uint64(k), held, differ + 1))
    return out


def block_keys(h: np.ndarray, bands: Bands, common: np.ndarray = np.zeros(0, np.uint64)) -> np.ndarray:
    """Keys of the blocks that a set emits, over all its bands; `common` (sorted) holds keys that come last."""
    out = []
    for key, held, n in all_blocks(h, bands):
        late = np.zeros(len(key), bool)
        if len(common):
            late = common[np.minimum(np.searchsorted(common, key), len(common) - 1)] == key
        out.append(key[np.lexsort((key, -held, late))[:n]])
    return np.concatenate(out)


def common_blocks(rows: DataFrame, bands: Bands, n: int) -> np.ndarray:
    """Keys of blocks that many of SAMPLE texts share, sorted; texts are chosen by hash, and copies count once."""
    total = rows.count()
    some = rows.filter(F.pmod(F.xxhash64("th"), F.lit(max(1, total // SAMPLE))) == 0).dropDuplicates(["th"]).select("text")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(np.concatenate([k[held > 0] for k, held, _ in all_blocks(h, bands)])) for h in (shingles(t, n) for t in b.column(0).to_pylist()) if len(h)]
            yield pa.record_batch({"key": pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))})

    with arrow_batches(rows.sparkSession):
        top = some.mapInArrow(keys, "key long").groupBy("key").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "key").limit(COMMONS).select("key").toPandas()
    return np.sort(top["key"].to_numpy(np.int64).view(np.uint64))


def verified(a: np.ndarray, b: np.ndarray, t: int = THRESHOLD) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= t * (len(a) + len(b) - both)


def lists(parts: list[np.ndarray], kind: np.dtype) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([*parts, np.zeros(0, kind)]).astype(kind, copy=False))


def sets(docs: DataFrame, bands: Bands, n: int = N, common: np.ndarray = np.zeros(0, np.uint64)) -> DataFrame:
    """doc_id, th, n_shingles, fp (hash of the set, null if empty); block keys and sketches where a task meets fp first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        seen: set[int] = set()
        none = np.zeros(0, np.int64)
        for b in batches:
            sizes, fps, keys, band, bits, sketches = [], [], [], [], [], [0]
            for text in b.column(1).to_pylist():
                h = shingles(text, n)
                fp = xxh3_64_intdigest(h.tobytes()) >> 1 if len(h) else None
                sizes.append(len(h))
                fps.append(fp)
                if fp is None or fp in seen:
                    keys.append(none)
                else:
                    seen.add(fp)
                    keys.append(block_keys(h, bands, common).view(np.int64))
                    for k, _ in bands.of(len(h)):
                        band.append(k)
                        bits.append(sketch(h, PARTS * bands.words(k)))
                sketches.append(len(band))
            sk = pa.ListArray.from_arrays(pa.array(sketches, pa.int32()), pa.StructArray.from_arrays([pa.array(band, pa.int32()), lists(bits, np.int64)], ["band", "bits"]))
            yield pa.record_batch([b.column(0), b.column(2), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), lists(keys, np.int64), sk], names=["doc_id", "th", "n_shingles", "fp", "keys", "sk"])

    return docs.mapInArrow(run, "doc_id long, th long, n_shingles long, fp long, keys array<long>, sk array<struct<band: int, bits: array<long>>>")


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys that more than one set has, with the set's rank there; the input is sorted by key and set."""
    held_key, held_fp, rank, open_ = None, None, 0, False
    for b in batches:
        key, fp = b.column("key").to_numpy(), b.column("fp").to_numpy()
        if not len(key):
            continue
        if held_key is not None:
            key, fp = np.concatenate([[held_key], key]), np.concatenate([[held_fp], fp])
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
        k, f = key[new], fp[new]
        begin = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        r = np.arange(len(k)) - np.repeat(begin, np.diff(np.append(begin, len(k))))
        r[: begin[1] if len(begin) > 1 else len(k)] += rank
        out = (r > 0) | np.append(k[1:] == k[:-1], False)  # or the next row has the same key
        out[-1] = False
        held_key, held_fp, rank, open_ = k[-1], f[-1], int(r[-1]), r[-1] > 0
        if out.any():
            yield pa.record_batch([pa.array(k[out]), pa.array(f[out]), pa.array(r[out])], names=["key", "fp", "rank"])
    if open_:
        yield pa.record_batch([pa.array([held_key], pa.int64()), pa.array([held_fp], pa.int64()), pa.array([rank], pa.int64())], names=["key", "fp", "rank"])


class Block:
    """Rows of one or more parts of blocks as arrays; the bits of row i are bits[at[i] : at[i + 1]]."""

    def __init__(self, table: pa.Table):
        t = table.combine_chunks()
        self.key, self.s, self.t, self.part, self.fp, self.n, self.comp = (t.column(c).to_numpy() for c in ("key", "s", "t", "part", "fp", "n", "comp"))
        bits = t.column("bits").combine_chunks()
        self.bits, self.at = bits.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(bits.value_lengths().to_numpy()))
        self.whole = t

    def starts(self) -> np.ndarray:
        return np.flatnonzero(np.append(True, (self.key[1:] != self.key[:-1]) | (self.s[1:] != self.s[:-1]) | (self.t[1:] != self.t[:-1])))

    def near(self, i: np.ndarray, j: np.ndarray, threshold: int) -> np.ndarray:
        """Which pairs of rows, of one block each, may be linked by size and Hamming distance."""
        long = self.at[i + 1] - self.at[i]
        first = np.append(0, np.cumsum(long))
        step = np.arange(first[-1])
        x = step + np.repeat(self.at[i] - first[:-1], long)
        y = step + np.repeat(self.at[j] - first[:-1], long)
        apart = np.add.reduceat(np.bitwise_count(self.bits[x] ^ self.bits[y]).astype(np.int64), first[:-1]) if len(i) else np.zeros(0, np.int64)
        a, b = self.n[i], self.n[j]
        return (np.minimum(a, b) * 100 >= np.maximum(a, b) * threshold) & (apart * (100 + threshold) <= (100 - threshold) * (a + b))


def stars(b: Block, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each set of a part with the first one that is near: one pair a set at most."""
    begin = b.starts()
    end = np.append(begin[1:], len(b.key))
    lead = np.repeat(begin, end - begin)
    row = np.arange(len(b.key))
    near = b.near(lead, row, threshold)
    yield lead[near & (lead != row)], row[near & (lead != row)]
    left = np.flatnonzero(~near)
    for some in np.split(left, np.flatnonzero(np.diff(lead[left])) + 1):
        while len(some) > 1:
            near = b.near(np.full(len(some) - 1, some[0]), some[1:], threshold)
            yield np.full(near.sum(), some[0]), some[1:][near]
            some = some[1:][~near]


def crossing(b: Block, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All near pairs of different components: within a part, or between two."""
    begin = b.starts()
    for lo, hi in zip(begin, np.append(begin[1:], len(b.key))):
        row = np.arange(lo, hi)
        both = b.s[lo] != b.t[lo]
        for i in row[b.part[row] == b.s[lo]]:
            other = row[b.part[row] == b.t[lo]] if both else np.arange(i + 1, hi)
            other = other[b.comp[other] != b.comp[i]]
            if len(other):
                near = b.near(np.full(len(other), i), other, threshold)
                yield np.full(near.sum(), i), other[near]


def compared(rows: DataFrame, how, threshold: int) -> DataFrame:
    """Pairs a < b that `how` finds within each (key, s, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            b = Block(table)
            for i, j in how(b, threshold):
                if len(i):
                    x, y = b.fp[i], b.fp[j]
                    yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            last = tuple(b.column(c)[b.num_rows - 1].as_py() for c in ("key", "s", "t"))
            same = np.logical_and.reduce([b.column(c).to_numpy() == v for c, v in zip(("key", "s", "t"), last)])
            cut = int(np.argmax(same))
            if cut or held and tuple(held[0].column(c)[0].as_py() for c in ("key", "s", "t")) != last:
                yield from pairs(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    rows = rows.select("key", "s", "t", "part", "rank", "fp", "n", "comp", "bits")
    return rows.repartition("key", "s", "t").sortWithinPartitions("key", "s", "t", "part", "rank").mapInArrow(run, "a long, b long").distinct()


def has_words(text: Column) -> Column:
    return F.coalesce(text.rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))


def grouped(docs: DataFrame, n: int = N, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, comp (names the row's group, null without words) and component_id.

    Documents with equal sets are one node. The sets of a block are first compared with the earliest one that is
    near, which joins a group of near copies by as many pairs as it has sets; then, where a block still holds more
    than one component, all near pairs between different components are verified. Blocks of more than PART sets
    are cut into parts.
    """
    bands = Bands(threshold)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
    found = materialize(sets(rows, bands, n, common_blocks(rows, bands, n)), "shingle-sets")
    node = found.filter("fp is not null").groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("x")).select("fp", F.col("x.doc_id").alias("doc"), "x.th")
    node = materialize(node, "distinct-sets")
    keyed = found.filter("keys is not null").select("fp", F.explode("keys").alias("key"))
    met = materialize(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(shared, "key long, fp long, rank long"), "shared-blocks")
    info = found.filter("size(sk) > 0").select("fp", F.col("n_shingles").alias("n"), F.explode("sk").alias("s")).select("fp", "n", "s.*").dropDuplicates(["fp", "band"])
    words = (F.size("bits") / PARTS).cast("int")
    folded = F.slice("bits", F.lit(1), words)
    for i in range(1, PARTS):
        folded = F.zip_with(folded, F.slice("bits", words * i + 1, words), lambda x, y: x.bitwiseXOR(y))
    sized = met.groupBy("key").agg((F.max("rank") + 1).alias("size"))
    keyed = met
    met = met.withColumn("band", F.col("key").bitwiseAND(127).cast("int")).join(sized, "key").join(info.withColumn("bits", folded), ["fp", "band"])
    met = materialize(met.withColumn("part", F.floor(F.col("rank") / PART)), "blocks")
    release(keyed)
    part = F.col("part").alias("s"), F.col("part").alias("t")
    rest = met.withColumn("comp", F.col("fp")).select("*", *part)
    # the earliest set of a block is compared with every part
    parts = F.explode(F.sequence(F.lit(1).cast("long"), F.floor((F.col("size") - 1) / PART)))
    heads = rest.filter(f"rank = 0 and size > {PART}").drop("s").withColumn("s", parts).withColumn("t", F.col("s")).withColumn("part", F.col("s"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole sets."""
        from xxhash import xxh3_64_intdigest

        for b in batches:
            out = []
            for fp, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = shingles(text, n).tobytes()
                if h and xxh3_64_intdigest(h) >> 1 == fp:
                    out.append((fp, h))
            yield batched(out, pa.schema([("fp", pa.int64()), ("h", pa.binary())]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("ha"), b.column("hb")
            good = [verified(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64), threshold) for i in range(b.num_rows)]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def linked(close: DataFrame, name: str) -> DataFrame:
        """The pairs that are links; whole sets are made anew for the sets in question only."""
        wanted = materialize(close.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(node, "fp").select("fp", "doc", F.col("th").alias("of")), "wanted")
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        texts = rows.join(wanted, (rows.th == wanted.of) & rows.doc_id.eqNullSafe(wanted.doc)).select("fp", "text")
        # repeated rows may give a set twice
        whole = materialize(texts.mapInArrow(hashes, "fp long, h binary").dropDuplicates(["fp"]), "candidate-sets")
        both = close.join(whole.select(F.col("fp").alias("b"), F.col("h").alias("hb")), "b").join(whole.select(F.col("fp").alias("a"), F.col("h").alias("ha")), "a")
        out = materialize(both.select("a", "b", "ha", "hb").mapInArrow(verify, "a long, b long"), name)
        release(whole)
        return out

    close = materialize(compared(rest.unionByName(heads), stars, threshold), "star-pairs")
    links = linked(close, "star-links")
    # rows that repeat an id are one document
    twice = found.filter("fp is not null and doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).filter("b < most").select("doc_id", "b")
    links = links.unionByName(found.filter("fp is not null").join(twice, "doc_id").select(F.col("fp").alias("a"), "b"))
    label = components(links).withColumnRenamed("node", "fp")
    # blocks of two were settled; others only where they hold different components
    open_ = met.filter("size > 2").join(label, "fp", "left").withColumn("comp", F.coalesce("component", "fp")).drop("component")
    mixed = open_.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    open_ = open_.join(mixed.select("key"), "key").drop("bits")
    open_ = open_.join(info.select("fp", "band", "bits"), ["fp", "band"])
    pair = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / PART)))
    open_ = open_.withColumn("other", pair).withColumn("s", F.least("part", "other")).withColumn("t", F.greatest("part", "other"))
    more = materialize(compared(open_, crossing, threshold).join(close, ["a", "b"], "left_anti"), "crossing-pairs")
    release(met, close)
    if more.limit(1).count():
        also = linked(more, "crossing-links")
        if also.limit(1).count():
            label = components(links.unionByName(also)).withColumnRenamed("node", "fp")
    release(more)
    group = node.join(label, "fp", "left").select("fp", "doc", F.coalesce("component", "fp").alias("comp"))
    least = group.groupBy("comp").agg(F.min("doc").alias("component_id"))
    group = group.join(least, "comp").select("fp", "comp", "component_id")
    out = found.select("doc_id", "th", "n_shingles", "fp").join(group, "fp", "left")
    return out.select("doc_id", "th", "n_shingles", "comp", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def join(docs: DataFrame, n: int = N, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: components of the links with 100 * intersection >= threshold * union.

    Null and empty texts have no shingles and are linked with nothing. Rows that repeat an id are one document, so texts
    near to any of them are reachable from all. A null id links like any other, but lends no id: component_id is the
    smallest id that is not null, and null in a component without one. Other columns are ignored; an empty table gives no rows.
    """
    return grouped(docs, n, threshold, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, n: int = N, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of join(), with the columns it came with, and every row without words.

    It is the row with the smallest id (null ids come last, equal ids by a hash of the text); of rows that repeat that
    id and text one stays.
    """
    # columns of the documents may have any name, so they stay together while others are beside them
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(F.col(text_col)).alias("own_th"), has_words(F.col(text_col)).alias("words"))
    rows = grouped(docs, n, threshold, id_col, text_col).filter("comp is not null")
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("x")).select("x.doc_id", "x.th")
    times = rows.groupBy("doc_id", "th").agg(F.count("*").alias("times")).withColumnsRenamed({"doc_id": "id_", "th": "th_"})
    first = first.join(times, first.doc_id.eqNullSafe(times.id_) & (first.th == times.th_)).select("doc_id", "th", "times")
    first = materialize(first, "representatives")
    kept = whole.filter("words").join(first, F.col("own_id").eqNullSafe(first.doc_id) & (F.col("own_th") == first.th))
    once = kept.filter("times = 1").select("doc").unionByName(kept.filter("times > 1").dropDuplicates(["own_id", "own_th"]).select("doc"))
    return once.unionByName(whole.filter("not words").select("doc")).select("doc.*")
