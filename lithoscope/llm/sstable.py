"""Token ids in sorted-string-table shards: prefix-compressed blocks, a sparse block index, a Bloom filter, a footer.

Layout of a shard file, in this order:

    blocks    zstd frames of entries; an entry is varint shared key bytes, varint own key bytes, varint
              value bytes, the own key bytes, the value; the first entry of a block shares nothing
    index     for each block: varint length of its last key, that key, varint offset, varint length
    filter    the bits of a Bloom filter over all keys
    footer    FOOTER: offsets and lengths of index and filter, number of hashes, bytes per id, entries, ids, the
              shard's place in the ascending order of all shards
    MAGIC     the last byte is the line end that Spark's text writer adds

A key is one tag byte (0, or 1 for a null identifier, which thus sorts last) and the identifier as eight
big-endian bytes with the sign bit flipped, so byte order is numeric order.  A value is the document's ids
as little-endian unsigned integers.  Shards are written in ascending order of identifiers by Spark's own
writer, so task retries and any file system that Spark can reach are covered.

Defined results: null and empty texts have the end id alone; rows that repeat an identifier or have none are
each stored, in the order of their place in the input; an empty table gives no shards and an empty result.
"""

from __future__ import annotations

import bisect
import struct
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokenizing import packed_ids

MAGIC = b"LITHSST\n"
FOOTER = struct.Struct("<QQQQBBQQQ")
#: Bytes of entries after which a block is closed, and of a shard's blocks after which the shard is.
BLOCK_BYTES, SHARD_BYTES = 1 << 15, 8 << 20
#: Bits of the Bloom filter per key and hashes of a key: about 1 % false positives.
FILTER_BITS, FILTER_HASHES = 10, 7

_NULL = b"\x01" + bytes(8)


def key_of(doc_id: int | None) -> bytes:
    return _NULL if doc_id is None else b"\x00" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] else int.from_bytes(key[1:], "big") - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def filter_bits(keys: list[bytes], bits: int, hashes: int) -> np.ndarray:
    """Positions of each key in the filter, one row per key: double hashing of 64-bit codes."""
    import xxhash

    h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + np.arange(hashes, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(bits)


class ShardWriter:
    """Takes documents in ascending key order and gives the bytes of a shard."""

    def __init__(self, width: int, place: int = 0):
        import zstandard

        self.place, self.width, self.pack = place, width, zstandard.ZstdCompressor(level=1).compress
        self.blocks, self.index, self.keys, self.size, self.n_ids = [], [], [], 0, 0
        self.block, self.last = bytearray(), b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:]
        self.block += value
        self.last = key
        self.keys.append(key)
        self.n_ids += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self.close_block()

    def close_block(self) -> None:
        if self.block:
            packed = self.pack(bytes(self.block))
            self.blocks.append(packed)
            self.index.append(varint(len(self.last)) + self.last + varint(self.size) + varint(len(packed)))
            self.size += len(packed)
            self.block = bytearray()

    def finish(self) -> bytes:
        """The file without the line end that closes MAGIC."""
        self.close_block()
        index = b"".join(self.index)
        bits = max(64, FILTER_BITS * len(self.keys) + 7 & ~7)
        field = np.zeros(bits, np.uint8)
        field[filter_bits(self.keys, bits, FILTER_HASHES).ravel()] = 1
        packed = np.packbits(field, bitorder="little").tobytes()
        foot = FOOTER.pack(self.size, len(index), self.size + len(index), len(packed), FILTER_HASHES, self.width, len(self.keys), self.n_ids, self.place)
        return b"".join([*self.blocks, index, packed, foot, MAGIC[:-1]])


class Shard:
    """Reads a shard's bytes."""

    def __init__(self, data: bytes):
        import zstandard

        if data[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a shard: the magic at its end is missing")
        self.data, self.unpack = data, zstandard.ZstdDecompressor().decompress
        at = len(data) - len(MAGIC) - FOOTER.size
        index, index_len, self.filter_at, self.filter_len, self.hashes, self.width, self.entries, self.n_ids, self.place = FOOTER.unpack_from(data, at)
        self.last_keys, self.places = [], []
        at = index
        while at < index + index_len:
            n, at = read_varint(data, at)
            self.last_keys.append(data[at : at + n])
            offset, at = read_varint(data, at + n)
            length, at = read_varint(data, at)
            self.places.append((offset, length))

    def block(self, i: int):
        """(key, value) of one block."""
        offset, length = self.places[i]
        data = self.unpack(self.data[offset : offset + length])
        at, key = 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            own, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + size]
            at += size

    def __iter__(self):
        for i in range(len(self.places)):
            yield from self.block(i)

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}")

    def may_hold(self, key: bytes) -> bool:
        bits = self.filter_len * 8
        return all(self.data[self.filter_at + (b >> 3)] >> (b & 7) & 1 for b in map(int, filter_bits([key], bits, self.hashes)[0]))

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of that identifier: the filter, a binary search of the index, then blocks."""
        key, found = key_of(doc_id), []
        if self.may_hold(key):
            i = bisect.bisect_left(self.last_keys, key)
            while i < len(self.places):
                found += [self.ids(v) for k, v in self.block(i) if k == key]
                if self.last_keys[i] > key:
                    break
                i += 1
        return found


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, vocab_size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", special: str = "<|endoftext|>") -> None:
    """Encode every document, append end_id, and write shards in ascending order of identifiers."""
    import pyarrow as pa

    width = 2 if max(vocab_size, end_id + 1) <= 1 << 16 else 4

    def run(batches):
        codec = packed_ids(tokenizer_path, width, special)
        common.claim("sstable", codec.clear)
        place = TaskContext.get().partitionId() << 32  # ranges ascend with the partitions
        shard, end = ShardWriter(width, place), end_id.to_bytes(width, "little")
        for batch in batches:
            for a, b in common.slices_by_bytes(batch.column(1), 1 << 20):
                packed = codec.encode_column(batch.column(1).slice(a, b - a))
                for doc_id, ids in zip(batch.column(0).slice(a, b - a).to_pylist(), packed, strict=True):
                    shard.add(key_of(doc_id), ids + end)
                    if shard.size + len(shard.block) >= SHARD_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([shard.finish()], pa.binary())], names=["shard"])
                        shard = ShardWriter(width, shard.place + 1)
        if shard.keys:
            yield pa.RecordBatch.from_arrays([pa.array([shard.finish()], pa.binary())], names=["shard"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    # Rows of one identifier, or of none, may be many: they are dealt out by their place in the input too.
    order = [F.col("doc_id").asc_nulls_last(), F.col("place")]
    placed = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    shards = placed.select("doc_id", "text").mapInArrow(run, "shard binary").select(F.col("shard").cast("string").alias("value"))
    shards.write.option("maxRecordsPerFile", 1).text(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """shard (its place), doc_id, first (ids of the shard before it), n_tokens, ids_crc32 and ids of every document."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                shard, out, before = Shard(data.as_py()), [], 0
                for key, value in shard:
                    ids = shard.ids(value)
                    out.append((shard.place, id_of(key), before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    before += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["shard", "doc_id", "first", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "shard bigint, doc_id bigint, first bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the given documents, by binary search in every shard whose filter may hold them."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                shard = Shard(data.as_py())
                found = [(d, ids.tolist()) for d in doc_ids for ids in shard.lookup(d)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "doc_id bigint, ids array<bigint>")


def token_shards(docs: DataFrame, tokenizer_path: str, vocab_size: int, end_id: int, path: str | None = None, **columns) -> DataFrame:
    """Write the shards and read them back: doc_id, start, n_tokens, ids_crc32 for every row of docs."""
    spark = docs.sparkSession
    path = path or common.shared_dir(spark)
    write_shards(docs, f"{path}/shards", tokenizer_path, vocab_size, end_id, **columns)
    rows = common.stored(read_shards(spark, f"{path}/shards"), f"{path}/entries")
    # Shards are numbered within the task that wrote them: only one row for each such task is added up in one place.
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("part", F.shiftright("shard", 32))
    before = lambda by: F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sums.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("part_base"))
    bases = sums.withColumn("base", before(Window.partitionBy("part").orderBy("shard"))).join(parts, "part")
    bases = common.stored(bases.select("shard", (F.col("base") + F.col("part_base")).alias("base")), f"{path}/bases")
    joined = rows.join(common.small_or_shuffled(bases, bases.count()), "shard")
    return joined.select("doc_id", (F.col("base") + F.col("first")).cast("long").alias("start"), "n_tokens", "ids_crc32")
