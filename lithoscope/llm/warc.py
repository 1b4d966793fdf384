"""WARC archives of pages: writing with segmented records and revisits, reading with segment reassembly.

Writing: each page is a response record whose block is an HTTP message in chunked transfer framing; of
equal payloads all but the first are revisit records without payload.  A block longer than SEGMENT_BYTES is
cut into a first segment and continuation records, the last of which states the total length.  Every record is
a gzip member of its own.  Members go through Spark's text writer, so task retries are covered: its line end is
the two zero bytes that end a member of less than 64 KiB (the upper half of its length).

Reading: files are parsed record by record; segments are grouped by the identifier of their origin, ordered
by number, checked to be complete and of the stated total length, joined, and their chunks decoded.
Revisits take the payload's length from the record that they refer to.

Defined results: a null page counts as empty; pages that repeat an identifier or have none are told apart
by their place in the input; incomplete, overlong or foreign records have complete = false and no payload, and
reading goes on at the next record, as it does after a member that cannot be inflated.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of a record's block beyond which it is segmented, and of a chunk of the transfer framing.
SEGMENT_BYTES, CHUNK_BYTES = 32_768, 8_192
#: Least bytes of a payload that revisits may share.
REVISIT_BYTES = 100
#: Records of a file; as blocks are bounded, so are files.
RECORDS_PER_FILE = 1_000
#: Bytes of a gzip member, whose length then ends in two zero bytes; how a member begins.
MEMBER_BYTES, MEMBER_END, GZIP = 65_535, b"\0\0", b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
URN = "urn:lithoscope:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its length says")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The decoded body of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line breaks that close it."""
    lines = [f"{k}: {v}".replace("\r", "%0D").replace("\n", "%0A").encode() for k, v in headers if v is not None]
    return b"\r\n".join([VERSION, *lines, b"Content-Length: %d" % len(block), b"", b""]) + block


def page_records(key: int, url: str | None, payload: bytes, refers_to: int | None, segment: int = SEGMENT_BYTES):
    """The records of one page."""
    name = f"<{URN}{key}>"
    common_headers = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()), ("Content-Type", "application/http;msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        yield record([("WARC-Type", "revisit"), *common_headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{refers_to}>")], head + b"\r\n")
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield record([("WARC-Type", "response"), *common_headers], block)
        return
    yield record([("WARC-Type", "response"), *common_headers, ("WARC-Segment-Number", 1)], block[:segment])
    for number, at in enumerate(range(segment, len(block), segment), 2):
        total = len(block) if at + segment >= len(block) else None
        yield record(
            [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{URN}{key}:{number}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total)],
            block[at : at + segment],
        )


def members(data: bytes) -> list[bytes]:
    """A record as gzip members, one unless it has 64 KiB or more."""
    out = []
    for at in range(0, len(data), MEMBER_BYTES):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(packer.compress(data[at : at + MEMBER_BYTES]) + packer.flush())
    return out


def inflated(data: bytes) -> list[bytes]:
    """What the members of a gzip file hold, in parts: of one that is damaged what came before, and then what follows it."""
    view, at, parts, held = memoryview(data), 0, [], []
    while at < len(data):
        unpacker = zlib.decompressobj(31)
        begin = at
        try:
            while at < len(data) and not unpacker.eof:
                held.append(unpacker.decompress(view[at : at + MEMBER_BYTES]))
                at = min(at + MEMBER_BYTES, len(data)) - len(unpacker.unused_data)
        except zlib.error:
            at = data.find(GZIP, begin + 1)
            while at >= 0 and not _begins_member(data[at : at + 256]):
                at = data.find(GZIP, at + 1)
            at = at if at >= 0 else len(data)
        if not unpacker.eof:
            parts, held = [*parts, b"".join(held)], []
        while at < len(data) and not data[at]:  # zeros may fill up a file
            at += 1
    return [*parts, b"".join(held)] if held else parts


def _begins_member(data: bytes) -> bool:
    try:
        zlib.decompressobj(31).decompress(data)
    except zlib.error:
        return False
    return True


def parse(data: bytes):
    """(headers with lower-case names, block, whole) of each record of a file; the block of a broken one is empty.

    After bytes that are no record, or a record that does not end where its length says, the next version line
    after line breaks begins a record; what is passed over without headers counts as one broken record.
    """
    at, n = 0, len(data)
    while at < n:
        end = data.find(b"\r\n\r\n", at)
        headers, size = {}, -1
        if data.startswith(b"WARC/", at) and end >= 0:
            for line in data[at:end].split(b"\r\n")[1:]:
                k, _, v = line.partition(b":")
                headers[k.strip().lower().decode(errors="replace")] = v.strip().decode(errors="replace")
            size = _whole_number(headers.get("content-length"))
        stop = end + 4 + size
        if size >= 0 and stop <= n and data[stop : stop + 4] in (b"\r\n\r\n", b"\r\n", b""):
            yield headers, data[end + 4 : stop], True
            at = stop
        else:
            yield headers, b"", False
            at = data.find(b"\r\n\r\nWARC/", at + 1)
            if at < 0:
                return
        while data[at : at + 2] == b"\r\n":
            at += 2


def _whole_number(text: str | None) -> int:
    """The number that digits state, -1 without one."""
    return int(text) if text and text.isascii() and text.isdigit() else -1


def write_warc(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write rows of key, url, html and refers_to (a key or null) as WARC files."""
    import pyarrow as pa

    def run(batches):
        common.claim("warc")
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = zip(*(part.column(i).to_pylist() for i in range(4)), strict=True)
                packed = [m.removesuffix(MEMBER_END) for k, u, h, f in rows for r in page_records(k, u, (h or "").encode(), f, segment) for m in members(r + b"\r\n\r\n")]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["member"])

    packed = pages.select("key", "url", "html", "refers_to").mapInArrow(run, "member binary")
    lines = packed.select(F.col("member").cast("string").alias("value"))
    lines.write.option("lineSep", MEMBER_END.decode()).option("compression", "none").option("maxRecordsPerFile", records_per_file).text(path)


RECORD = "origin string, record_type string, segment int, total bigint, refers_to string, stated_digest string, payload_bytes bigint, payload_digest string, complete boolean"


def _taken(block: bytes | None) -> tuple:
    """Length, digest and completeness of a block's payload."""
    try:
        payload = http_payload(block)
    except (TypeError, ValueError):
        return None, None, False
    return len(payload), hashlib.sha256(payload).hexdigest(), True


def _row(h: dict[str, str], block: bytes, whole: bool) -> tuple:
    """The row of a record: segments keep their block, others are decoded."""
    kind, number, total = h.get("warc-type"), _whole_number(h.get("warc-segment-number")), _whole_number(h.get("warc-segment-total-length"))
    origin = h.get("warc-segment-origin-id", h.get("warc-record-id", "")).strip("<>") or None
    own = (origin, kind, number if number >= 0 else None, total if total >= 0 else None, h.get("warc-refers-to", "").strip("<>") or None, h.get("warc-payload-digest", "").removeprefix("sha256:") or None)
    if not whole or origin is None or kind is None:
        return (origin, kind, None, *own[3:], None, None, False, None)
    if number >= 0:
        return (*own, None, None, None, block)
    if kind == "response":
        return (*own, *_taken(block), None)
    return (*own, *((len(block), hashlib.sha256(block).hexdigest(), True) if kind in ("resource", "conversion") else (None, None, True)), None)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the files under path; block holds the bytes of segments only, others are decoded at once."""
    import pyarrow as pa

    types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary())
    names = ["origin", "record_type", "segment", "total", "refers_to", "stated_digest", "payload_bytes", "payload_digest", "complete", "block"]

    def run(batches):
        common.claim("warc")
        for batch in batches:
            for file in batch.column(0):
                data = file.as_py()
                out = [_row(*found) for part in (inflated(data) if data.startswith(GZIP) else [data]) for found in parse(part)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD + ", block binary")


def reassemble(segments: DataFrame) -> DataFrame:
    """One row like those of whole records for each origin of the segments."""
    import pyarrow as pa

    def run(batches):
        common.claim("warc")
        for batch in batches:
            out = []
            for parts in batch.column(1):
                parts = [p for p in parts.as_py()]
                numbers = [p["segment"] for p in parts]
                block = b"".join(p["block"] for p in parts)
                whole = numbers == list(range(1, len(parts) + 1)) and parts[-1]["total"] == len(block)
                first = parts[0]
                out.append((first["record_type"], None, parts[-1]["total"], None, first["stated_digest"], *(_taken(block) if whole else (None, None, False))))
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            types = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["origin", "record_type", "segment", "total", "refers_to", "stated_digest", "payload_bytes", "payload_digest", "complete"])

    # The segments of one page: bounded by the page, which was one cell.
    parts = segments.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("segment", "total", "record_type", "stated_digest", "block"))).alias("parts"))
    return parts.mapInArrow(run, RECORD)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", path: str | None = None) -> DataFrame:
    """Write pages as WARC files under path and read them back.

    page_id, payload_bytes, payload_digest, record_type, refers_to and complete for every row of pages.
    """
    spark = pages.sparkSession
    path = path or common.shared_dir(spark)
    pages = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[payload_col].alias("html"))
    digests = lambda p: p.select("key", "page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    narrow = common.stored(digests(pages.withColumn("key", F.col("page_id"))), f"{path}/digests")
    rows, ids = narrow.agg(F.count(F.lit(1)), F.count_distinct("page_id")).first()
    unique = rows == ids
    if unique:
        keyed = pages.withColumn("key", F.col("page_id"))
    else:
        keyed = common.stored(pages.withColumn("key", F.monotonically_increasing_id()), f"{path}/numbered")
        narrow = common.stored(digests(keyed), f"{path}/digests-numbered")
    order = F.struct(F.col("page_id").isNull().alias("unnamed"), F.col("page_id").alias("page_id"), F.col("key").alias("key"))
    shared = narrow.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min(order)["key"].alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    shared = common.stored(shared, f"{path}/shared")
    revisits = common.join_hot(narrow.select("key", "digest"), shared, ["digest"], "copies", rows).where("key != first").select("key", F.col("first").alias("refers_to"))
    revisits = common.stored(revisits, f"{path}/revisits")
    write_warc(keyed.join(common.small_or_shuffled(revisits, revisits.count()), "key", "left"), f"{path}/warc")

    records = common.stored(read_records(spark, f"{path}/warc"), f"{path}/records")
    whole = records.where("segment is null").drop("block").unionByName(reassemble(records.where("segment is not null")))
    whole = common.stored(whole, f"{path}/whole")
    responses = whole.where("record_type = 'response'")
    seen = whole.where("record_type = 'revisit'")
    times = seen.groupBy(F.col("refers_to").alias("origin")).agg(F.count(F.lit(1)).alias("times"))
    targets = responses.join(times, "origin").select(F.col("origin").alias("refers_to"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("of"), "times")
    resolved = common.join_hot(seen, targets, ["refers_to"], "times", rows)
    resolved = resolved.select("origin", "record_type", "refers_to", F.col("bytes").alias("payload_bytes"), F.col("stated_digest").alias("payload_digest"), (F.col("of") == F.col("stated_digest")).alias("complete"))
    out = responses.select(*resolved.columns).unionByName(resolved)
    number = lambda c: F.substring(c, len(URN) + 1, 20).cast("long")
    out = out.select(number("origin").alias("key"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_key"), "complete")
    if unique:
        return out.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_key").alias("refers_to"), "complete")
    names = keyed.select("key", "page_id")
    out = out.join(names, "key").join(names.select(F.col("key").alias("refers_key"), F.col("page_id").alias("refers_to")), "refers_key", "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")
