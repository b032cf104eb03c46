"""The archive writer and reader on odd rows and damaged files."""

import io
import logging

import numpy as np
import pytest

from weftspark.llm import warc

PAGES = "page_id long, url string, html string, sha string, id int, first long"


class File(io.BytesIO):
    most = 0

    def __init__(self, data):
        super().__init__(data)
        self.n = len(data)

    def size(self):
        return self.n

    def read(self, n=-1):
        File.most = max(File.most, n)
        return super().read(n)


def ids(data):
    # a header without a compressed member's checksum may be damaged and still be one
    return [int(f.head["x-page-id"]) for f in warc.salvage(File(data)) if f.head and f.head.get("x-page-id", "").isdigit()]


def test_odd_rows(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (2, None, "a"), (None, "v", "a"), (None, None, None), (None, "w", ""), (3, "x\r\ny", "b"), (4, "z", "é" * 300_000), (5, "q" * 100_000, "c"), (None, "k", "only")]
    a = warc.write(spark.createDataFrame([(*r, "s", 1, 2) for r in rows], PAGES), size=1000)
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to, (r.url or "")[:5]) for r in warc.read(a).collect())
    want = [("1", 1, "revisit", 2, "u"), ("1", 1, "revisit", 2, "u"), ("2", 1, "response", None, ""), ("None", 1, "revisit", 2, "v"), ("None", 0, "response", None, ""), ("None", 0, "response", None, "w"), ("3", 1, "response", None, "x  y"), ("4", 600_000, "response", None, "z"), ("5", 1, "response", None, "qqqqq"), ("None", 4, "response", None, "k")]
    assert got == sorted(want)
    assert a.count() >= 3  # an archive ends at about 1000 bytes
    warc.discard(a)
    none = warc.write(spark.createDataFrame([], PAGES))
    assert warc.read(none).count() == 0 == warc.quarantine(warc.read(none)).count()


def test_payloads_below_the_least_size_are_responses(spark):
    a = warc.write(spark.createDataFrame([(i, "u", h, "", 0, 0) for i, h in enumerate(["ab", "ab", "abcd", "abcd"])], PAGES), least=3)
    assert sorted((r.page_id, r.refers_to) for r in warc.read(a).collect()) == [(0, None), (1, None), (2, 3), (3, None)]


@pytest.mark.parametrize("pack", [warc.member, bytes])
def test_any_damage_leaves_the_other_records(pack):
    rng = np.random.default_rng(4)
    records = [pack(warc.record(i, f"http://x/{i}", rng.integers(0, 256, 500).astype(np.uint8).tobytes() + b"WARC/1.1\r\n\x1f\x8b\x08 text " * 20)) for i in range(4)]
    whole = b"".join(records)
    ends = np.cumsum([0, *map(len, records)])
    for _ in range(150):
        at, n = int(rng.integers(0, len(whole))), int(rng.integers(1, 40))
        for bad in (whole[:at] + bytes(rng.integers(0, 256, n).astype(np.uint8)) + whole[at + n :], whole[:at] + whole[at + n :]):
            hit = {k for k in range(4) if ends[k] < at + n and at < ends[k + 1]}
            got = ids(bad)
            assert set(range(4)) - hit <= set(got)
            found = list(warc.salvage(File(bad)))
            gaps = [f for f in found if f.reason]
            assert all(f.begin < f.end for f in found) and (gaps or len([f for f in found if f.head]) == 4)


def test_a_false_length_is_not_read(monkeypatch):
    data = warc.record(0, "u", b"x" * 100).replace(b"Content-Length: 100", b"Content-Length: 100") + warc.record(1, "u", b"y" * 100)
    at = data.rindex(b"Content-Length", 0, data.index(b"\r\n\r\n"))
    long = data[:at] + b"Content-Length: 90000000\r\n" + data[data.index(b"\r\n", at) + 2 :] + b"z" * 100_000_000
    File.most = 0
    found = list(warc.salvage(File(long)))
    assert [f.head["x-page-id"] for f in found if f.head] == ["1"] and File.most <= 1 << 20


def test_members_larger_than_the_window(monkeypatch):
    monkeypatch.setattr(warc, "WINDOW", 5000)
    records = [warc.record(i, f"http://x/{i}", bytes([65 + i % 26]) * (i * 911 % 30_000)) for i in range(40)]
    broken = {3, 17, 39}
    parts = [bytearray(r) for r in records]
    for i in broken:
        parts[i][len(parts[i]) - 30] ^= 255
    data = warc.member(b"".join(records)) + warc.member(b"".join(map(bytes, parts))) + warc.member(records[5])
    found = list(warc.salvage(File(data)))
    assert [int(f.head["x-page-id"]) for f in found if f.head] == [*range(40), *(i for i in range(40) if i not in broken), 5]
    assert sum(bool(f.reason) for f in found) == 3


@pytest.mark.parametrize("window", [warc.WINDOW, 4000])
@pytest.mark.parametrize("level", [0, 1, 6])
def test_records_before_the_damage_of_a_member_come_back(monkeypatch, window, level):
    monkeypatch.setattr(warc, "WINDOW", window)
    rng = np.random.default_rng(9)
    records = [warc.record(i, f"http://x/{i}", rng.integers(97, 123, 900).astype(np.uint8).tobytes()) for i in range(20)]
    whole, more = warc.member(b"".join(records), level), warc.member(warc.record(99, "u", b"after"))
    at = len(whole) * 9 // 10
    for name, bad, least in (("a bad byte", whole[:at] + bytes([whole[at] ^ 0xFF]) + whole[at + 1 :], 17), ("a cut", whole[:-40], 18), ("a checksum", whole[:-6] + b"\0\0" + whole[-4:], 20), ("a gap", whole[:at] + whole[at + 300 :], 17)):
        for data, after in ((bad + more, [99]), (bad, [])):
            found = list(warc.salvage(File(data)))
            got = [int(f.head["x-page-id"]) for f in found if f.head]
            own = [i for i in got if i != 99]
            assert got[len(own) :] == after and len(own) >= least and own[:least] == list(range(least)) and len(set(got)) == len(got), (name, got)
            assert all(f.block == records[int(f.head["x-page-id"])].split(b"\r\n\r\n", 1)[1][:-4] for f in found if f.head and f.head["x-page-id"] != "99")
            assert [f for f in found if f.reason] and all(f.begin < f.end <= len(data) for f in found), name


def test_gaps_are_logged(spark, tmp_path, caplog):
    good = warc.member(warc.record(7, "u", b"p"))
    (tmp_path / "a.warc.gz").write_bytes(good[:-9] + b"garbage" + good)
    found = warc.read(spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "path string"))
    with caplog.at_level(logging.WARNING):
        gaps = warc.quarantine(found).collect()
    # the cut member's record is whole
    assert [r.page_id for r in found.filter("reason is null").collect()] == [7, 7]
    assert gaps and all(0 <= g.begin < g.end <= 2 * len(good) - 2 for g in gaps) and f"{len(gaps)} byte gaps" in caplog.text
