"""WARC archives: a writer, and a reader that salvages what it can of damaged files."""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, materialize, release, scratch, tune

CHUNK = 1 << 16
#: Decompressed bytes of a member that are held; bytes from which a writer begins another archive.
WINDOW, ARCHIVE = 1 << 24, 1 << 27
MAGIC, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/\d\.\d\r?\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One response record, or a revisit of the record of `refers_to` without the payload."""
    name, http = digest(payload), b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\r\n]", " ", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {record_id(page)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{name}", f"WARC-Block-Digest: sha1:{digest(block)}", f"X-Page-ID: {'' if page is None else page}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member of its own."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


@dataclass
class Found:
    """A record, or, with a reason, a gap of bytes that were set aside."""

    begin: int
    end: int
    head: dict[str, str] | None = None
    block: bytes = b""
    reason: str = ""


class Source:
    """Bytes of a file by position, read in chunks; only what was asked for last is kept."""

    def __init__(self, file):
        self.file, self.size, self.at, self.held = file, file.size(), 0, b""

    def read(self, begin: int, n: int) -> bytes:
        if not (self.at <= begin and begin + n <= self.at + len(self.held)):
            self.file.seek(begin)
            self.at, self.held = begin, self.file.read(max(n, 4 * CHUNK))
        return self.held[begin - self.at : begin - self.at + n]


class Bytes:
    """The same for bytes in memory."""

    def __init__(self, data: bytes):
        self.data, self.size, self.keep = data, len(data), 0

    def read(self, begin: int, n: int) -> bytes:
        return self.data[begin : begin + n]


class Member:
    """The decompressed bytes of a gzip member up to `end` as a source. What lies before `keep` is forgotten; to come back to it
    the member is decompressed again from its start."""

    def __init__(self, src: Source, begin: int, end: int, size: int):
        self.src, self.begin, self.end, self.size, self.keep = src, begin, end, size, 0
        self._start()

    def _start(self) -> None:
        self.z, self.next, self.at, self.held = zlib.decompressobj(31), self.begin, 0, bytearray()

    def read(self, begin: int, n: int) -> bytes:
        if begin < self.at:
            self._start()
        while self.at + len(self.held) < begin + n and not self.z.eof:
            raw = self.z.unconsumed_tail
            if not raw:
                raw = self.src.read(self.next, min(CHUNK, self.end - self.next))
                if not raw:
                    break
                self.next += len(raw)
            self.held += self.z.decompress(raw, WINDOW)
            behind = min(self.keep, begin) - self.at
            if behind > WINDOW:
                behind = min(behind, len(self.held))
                del self.held[:behind]
                self.at += behind
        return bytes(self.held[begin - self.at : begin - self.at + n])


def _record_at(src: Source | Bytes, begin: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and end of the record at a position; ValueError or EOFError with the failed check.

    The end mark is looked up where the content length puts it before the block is read, so a false length costs a
    few bytes, and no more than the record itself is held. Within a compressed member, where looking ahead is reading, that
    is done for blocks of more than a few windows only.
    """
    if not VERSION.match(src.read(begin, 16)):
        raise ValueError("no version line")
    n = 4 * CHUNK
    while (cut := (data := src.read(begin, n)).find(b"\r\n\r\n")) < 0:
        if begin + n >= src.size:
            raise ValueError("header without end")
        n *= 4
    head = {}
    for line in data[VERSION.match(data).end() : cut].split(b"\r\n"):
        k, sep, v = line.partition(b":")
        if not sep:
            raise ValueError("header line without colon")
        head[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
    if not re.fullmatch(r"\d{1,18}", head.get("content-length", "")):
        raise ValueError("no content length")
    first, n = begin + cut + 4, int(head["content-length"])
    if first + n > src.size:
        raise EOFError("record ends early")
    if (not isinstance(src, Member) or n > 4 * WINDOW) and src.read(first + n, 4) != b"\r\n\r\n":
        raise ValueError("record without end mark")
    block = src.read(first, n + 4)
    if block[n:] != b"\r\n\r\n":
        raise ValueError("record without end mark")
    block = block[:n]
    want = head.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:].upper() != digest(block):
        raise ValueError("block digest differs")
    return head, block, first + n + 4


def _accepted(z, raw: bytes):
    """The decompressor after the bytes before the first bad one, what they gave, and how many they are."""
    out, used = [], 0
    for step in (4096, 64, 1):
        while used < len(raw):
            part, probe = raw[used : used + step], z.copy()
            try:
                out.append(probe.decompress(part))
            except zlib.error:
                break
            z, used = probe, used + len(part)
    return z, out, used


def _member_at(src: Source, begin: int) -> tuple[Bytes | Member, int, str]:
    """The gzip member at a position as a source of its decompressed bytes, where it ends, and why it ends there: an empty text if
    its checksum holds; else it ends at the first byte that does not decompress, or with the file.

    Members of up to WINDOW bytes are held; of larger ones, as of archives compressed as a whole, a window.
    """
    z, held, n, at, why = zlib.decompressobj(31), [], 0, begin, ""

    def take(more: bytes) -> None:
        nonlocal n
        n += len(more)
        if n <= WINDOW:
            held.append(more)
        if held and sum(map(len, held[:2])) >= 5 and not b"".join(held[:2]).startswith(b"WARC/"):
            raise ValueError("member holds no record")

    while not z.eof and not why:
        raw = src.read(at, CHUNK)
        if not raw:
            why = "member ends early"
            break
        before = z.copy()
        try:
            parts, rest = [], raw
            while rest and not z.eof:
                parts.append(z.decompress(rest, WINDOW))
                rest = z.unconsumed_tail
            at += len(raw)
        except zlib.error as e:
            z, parts, used = _accepted(before, raw)
            at, why = at + used, str(e)
        for more in parts:
            take(more)
    end = at - len(z.unused_data)
    return (Bytes(b"".join(held)) if n <= WINDOW else Member(src, begin, end, n)), end, why


def _inside(data: Bytes | Member, begin: int, end: int) -> Iterator[Found]:
    """Records of a member's bytes, and what lies between them as gaps; the first failed check if no record is valid."""
    at, gap, first, any_ = 0, None, None, False
    while at < data.size:
        data.keep = at
        try:
            head, block, after = _record_at(data, at)
        except (ValueError, EOFError) as e:
            if gap is None:
                gap, first = (at, str(e)), first or e
            at = _find(data, at + 1, None)
            continue
        if gap is not None:
            yield Found(begin, end, reason=f"{gap[1]} (bytes {gap[0]} to {at} of the member)")
            gap = None
        any_ = True
        yield Found(begin, end, head, block)
        at = after
    if not any_:
        raise first or EOFError("member is empty")
    if gap is not None:
        yield Found(begin, end, reason=f"{gap[1]} (bytes {gap[0]} to {data.size} of the member)")


def _find(src: Source | Bytes | Member, begin: int, magic: bytes | None) -> int:
    """The next position at which a version line, or with magic a gzip member, may begin; the end if there is none."""
    at = begin
    while at < src.size:
        src.keep = at
        raw = src.read(at, CHUNK)
        hits = [i for i in (raw.find(magic) if magic else -1,) if i >= 0]
        hits += [m.start() for m in [VERSION.search(raw)] if m]
        if hits:
            return at + min(hits)
        if at + len(raw) >= src.size:
            break
        at += max(1, len(raw) - 16)
    return src.size


def _overrun(src: Source, begin: int, end: int) -> int | None:
    """Where the first whole member begins that a cut one has read on into, if there is one. (A whole member within a payload
    that is stored without compression in a damaged member would be taken for one.)"""
    at = begin + 1
    while at < end:
        raw = src.read(at, min(CHUNK, end - at + 2))
        hit = raw.find(MAGIC)
        if hit < 0:
            at += max(1, len(raw) - 2)
            continue
        at += hit
        if at >= end:
            break
        try:
            data, _, cut = _member_at(src, at)
            if not cut and data.read(0, 5) == b"WARC/":
                return at
        except (zlib.error, ValueError, EOFError):
            pass
        at += 1
    return None


def salvage(file) -> Iterator[Found]:
    """Records of an archive, compressed by member or not; after a failed check, those from the next valid start.

    A candidate start counts as valid only if the whole record there passes all checks (version line, header, length, end mark,
    block digest); what lies before it becomes one gap with the reason of the first failure. A gzip member may
    hold any number of records: all have its position, and so have gaps within it, whose reasons name the damaged bytes. Of a
    member that is cut or whose stream or checksum is damaged, the records count that decompress before the first bad byte
    and pass all checks; from that byte on a gap lasts to the next valid start.
    """
    src = Source(file)
    at, gap, why = 0, None, ""
    while at < src.size:
        cut = ""
        try:
            if src.read(at, 3) == MAGIC:
                data, end, cut = _member_at(src, at)
                found = _inside(data, at, end)
            else:
                head, block, end = _record_at(src, at)
                found = iter([Found(at, end, head, block)])
            one = next(found)
            while cut and one.reason:  # a damaged member counts from its first valid record on
                one = next(found)
        except (zlib.error, ValueError, EOFError) as e:
            if gap is None:
                gap, why = at, cut or str(e)
            at = _find(src, at + 1, MAGIC)
            continue
        if gap is not None:
            yield Found(gap, at, reason=why)
            gap = None
        yield one
        yield from found
        if not cut:
            at = end
            continue
        at = _overrun(src, at, end)
        if at is None:
            gap, why = end, cut
            at = _find(src, end, MAGIC)
        if at <= end or end == src.size:  # nothing lies between
            yield Found(one.begin, at, reason=cut)
            gap = None
    if gap is not None:
        yield Found(gap, src.size, reason=why)


def write(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", size: int = ARCHIVE) -> DataFrame:
    """Write every row as a record; returns (path, records) of the archives that counted, one row an archive.

    A task writes an archive after another, each of about `size` bytes; a lost task's archives do not count. Of rows with
    payloads of the same SHA-1 digest and at least `least` bytes the one with the largest id is the response and the others
    revisit it; the maxima are taken before the shuffle, and adaptive execution splits a payload that very many rows have.
    A null payload is empty. Rows without an id revisit a response like others; where no row of a payload has an id, all are
    responses, as are rows that repeat the largest id. Line ends in urls become spaces. Other columns are ignored. An
    empty table gives no archive. `discard` deletes the archives.
    """
    spark = pages.sparkSession
    tune(spark)
    folder = scratch(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    same = rows.filter(F.octet_length("html") >= least).groupBy("sha").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first")
    same = materialize(same, "equal-payloads")
    rows = rows.join(same, "sha", "left").select("id", "url", "html", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("to"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, sink, n = "", None, 0
        for b in batches:
            for page, url, html, to in zip(*(b.column(i).to_pylist() for i in range(4))):
                if sink is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    fs, at = filesystem(path)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    sink, n = fs.open_output_stream(at, compression=None), 0
                sink.write(member(record(page, url, html.encode(), to)))
                n += 1
                if sink.tell() >= size:
                    sink.close()
                    sink = None
                    yield pa.record_batch([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])
        if sink:
            sink.close()
            yield pa.record_batch([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    out = materialize(rows.mapInArrow(put, "path string, records long"), "archives")
    release(same)
    out.archives_at = folder
    return out


def discard(archives: DataFrame) -> None:
    """Delete the archives that write() made, once what was read from them is kept elsewhere."""
    spark = archives.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(archives.archives_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    release(archives)


ROWS = "path string, begin long, end long, reason string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps (reason not null) of the archives in column `path`.

    Archives are dealt by ranges of their paths, about one to a task; a task reads each front to back and holds one record at a
    time, or a compressed member of up to 16 MB. Fields that an archive lacks are null; no archive gives no rows. An archive
    that is missing is an error.
    """
    tune(archives.sparkSession)
    n = max(1, archives.count())  # one row an archive

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda v: int(v) if v and re.fullmatch(r"-?\d+", v) else None
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [c.split()[0] for c in ROWS.split(", ")]
        pack = lambda out: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = filesystem(path)
                out, held = [], 0
                with fs.open_input_file(at) as file:
                    for f in salvage(file):
                        h = f.head
                        if h is None:
                            out.append((path, f.begin, f.end, f.reason) + (None,) * 7)
                        else:
                            payload = f.block.partition(b"\r\n\r\n")[2]
                            size, name = len(payload), digest(payload)
                            if h.get("warc-type") == "revisit":
                                size, name = number(h.get("x-payload-length")), h.get("warc-payload-digest", "").removeprefix("sha1:")
                            out.append((path, f.begin, f.end, None, number(h.get("x-page-id")), h.get("warc-target-uri"), size, name, h.get("warc-type"), number(h.get("x-refers-to-page-id")), payload if payloads else None))
                            held += len(payload)
                        if len(out) >= 1024 or held > 1 << 24:
                            yield pack(out)
                            out, held = [], 0
                if out:
                    yield pack(out)

    return archives.select("path").repartitionByRange(n, "path").mapInArrow(get, ROWS)


def quarantine(found: DataFrame) -> DataFrame:
    """The gaps of read(): archive, first and end byte, and the failed check; the driver's log names some of them."""
    gaps = found.filter("reason is not null").select("path", "begin", "end", "reason")
    if total := gaps.count():
        log = logging.getLogger(__name__)
        log.warning("%d byte gaps were set aside", total)
        for r in gaps.limit(20).collect():
            log.warning("%s bytes %d to %d: %s", r.path, r.begin, r.end, r.reason)
    return gaps
