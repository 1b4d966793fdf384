import gzip
import hashlib
import zlib

import pytest

from lithoscope.llm import warc

PAGES = "page_id long, url string, html string, key string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", "d") for r in rows], PAGES).repartition(3)


def brute(rows):
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        first = min(j for j, _, g in rows if (g or "") == (h or ""))
        again = len(body) >= 100 and first != i
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None, True))
    return sorted(out)


def test_round_trip(spark):
    rows = [(i, f"http://a/{i}", f"<p>{i % 7}</p>" * 40) for i in range(60)]
    rows += [(100, None, None), (101, "u\r\nX: y", ""), (102, "é", "WARC/1.1\r\n\r\n" * 20), (103, "s", "x" * 99), (104, "s", "x" * 99), (105, "big", "é" * 200_000), (106, "big", "é" * 200_000)]
    got = sorted(tuple(r) for r in warc.archive_round_trip(pages(spark, rows)).collect())
    assert got == brute(rows)


def test_repeated_and_missing_ids_and_no_rows(spark):
    body = "y" * 70_000
    got = warc.archive_round_trip(pages(spark, [(1, "a", body), (1, "a", body), (None, "b", body), (None, None, None)])).collect()
    assert sorted(r.record_type for r in got) == ["response", "response", "revisit", "revisit"]
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {1} and all(r.complete for r in got)
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


def test_framing():
    for n in (0, 1, 8_192, 8_193, 50_000):
        assert warc.dechunked(warc.chunked(b"z" * n)) == b"z" * n
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_segments_are_verified(spark):
    records = list(warc.page_records(7, "u", b"q" * 1000, None, segment=300))
    parsed = [p for r in records for p in warc.parse(r + b"\r\n\r\n")]
    assert all(whole for _, _, whole in parsed)
    rows = [("o", int(h["warc-segment-number"]), int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, h["warc-type"], None, b) for h, b, _ in parsed]
    schema = "origin string, segment int, total long, record_type string, stated_digest string, block binary"
    whole = warc.reassemble(spark.createDataFrame(rows[::-1], schema)).first()
    assert (whole.payload_bytes, whole.complete) == (1000, True)
    for broken in (rows[:-1], [rows[0], *rows[2:]]):
        assert not warc.reassemble(spark.createDataFrame(broken, schema)).first().complete


def test_files_of_one_member_per_record(spark, tmp_path):
    records = [next(warc.page_records(k, "u", b"p%d" % k, None)) + b"\r\n\r\n" for k in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "c.warc").write_bytes(b"".join(records))
    for name in ("a.warc.gz", "b.warc.gz", "c.warc"):
        got = warc.read_records(spark, f"file://{tmp_path}/{name}").collect()
        assert [(r.origin, r.payload_digest, r.complete) for r in got] == [(f"{warc.URN}{k}", hashlib.sha256(b"p%d" % k).hexdigest(), True) for k in range(5)], name


def test_archives_have_one_member_per_record(spark, tmp_path):
    rows = [(k, "u" * (70_000 if k == 3 else 9), "x" * k * 20_000, None) for k in range(6)]
    path = f"file://{tmp_path}/warc"
    warc.write_warc(spark.createDataFrame(rows, "key long, url string, html string, refers_to long"), path)
    records = []
    for file in sorted((tmp_path / "warc").glob("part-*")):
        data = file.read_bytes()
        records += warc.parse(gzip.decompress(data))
        while data:  # each member alone is a record, but for the one that has 64 KiB of headers
            unpacker = zlib.decompressobj(31)
            member = unpacker.decompress(data)
            assert b"u" * 100 in member or (member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n"))
            data = unpacker.unused_data
    assert sorted(h["warc-record-id"] for h, _, whole in records if "warc-segment-origin-id" not in h and whole) == [f"<{warc.URN}{k}>" for k in range(6)]
    got = {r.origin: r.payload_bytes for r in warc.read_records(spark, path).where("segment is null").collect()}
    assert got == {f"{warc.URN}{k}": k * 20_000 for k in (0, 1)}


def test_bad_records_do_not_end_the_reading(spark, tmp_path):
    a, b, c = (next(warc.page_records(k, "u", b"p%d" % k, None)) + b"\r\n\r\n" for k in range(3))
    foreign = b"GET / HTTP/1.1\r\nHost: x\r\n\r\n"
    odd = a.replace(b"WARC-Date", b"X-\xff\xfe: \xff\r\nWARC-Date")
    too_long, no_length, no_type = (a.replace(b"Content-Length: ", x) for x in (b"Content-Length: 9", b"Length: ", b"Content-Length:x"))
    numbered = a.replace(b"WARC-Date", b"WARC-Segment-Number: one\r\nWARC-Date")
    cases = {
        "cut": (a + b[:-30], [True, False]),
        "cut in the middle": (a + b[:-30] + b"\r\n\r\n" + c, [True, False, True]),
        "foreign": (foreign + a + foreign + b, [False, True, False, True]),
        "headers that are no text": (odd + b, [True, True]),
        "wrong length": (too_long + b + no_length + no_type + c, [False, True, False, False, True]),
        "a number that is none": (numbered + b, [True, True]),
        "zeros": (b"\0" * 100, [False]),
        "nothing": (b"", []),
    }
    for name, (data, want) in cases.items():
        (tmp_path / "x.warc").write_bytes(data)
        got = warc.read_records(spark, f"file://{tmp_path}/x.warc").collect()
        assert [r.complete for r in got] == want, name
        assert all(r.payload_digest is None for r in got if not r.complete)
    packed = [gzip.compress(r) for r in (a, b, c)]
    broken = packed[1][:40] + bytes(x ^ 0x55 for x in packed[1][40:60]) + packed[1][60:]
    (tmp_path / "y.warc.gz").write_bytes(packed[0] + broken + packed[2])
    got = {r.origin: r.complete for r in warc.read_records(spark, f"file://{tmp_path}/y.warc.gz").collect()}
    assert got[f"{warc.URN}0"] and got[f"{warc.URN}2"] and not got.get(f"{warc.URN}1")
    (tmp_path / "z.warc.gz").write_bytes(packed[0] + packed[1][:-20])
    assert [r.complete for r in warc.read_records(spark, f"file://{tmp_path}/z.warc.gz").collect()][0]


def test_resources_and_other_records(spark, tmp_path):
    rows = [warc.record([("WARC-Type", kind), ("WARC-Record-ID", f"<{kind}>")], b"abc") + b"\r\n\r\n" for kind in ("resource", "warcinfo", "request")]
    (tmp_path / "r.warc").write_bytes(b"".join(rows))
    got = {r.origin: (r.payload_bytes, r.complete) for r in warc.read_records(spark, f"file://{tmp_path}/r.warc").collect()}
    assert got == {"resource": (3, True), "warcinfo": (None, True), "request": (None, True)}
