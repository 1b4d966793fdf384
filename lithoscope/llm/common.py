"""Shared pieces of the training-data operators: shared storage, size-checked joins, vectorised text passes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (id, small columns) up to which one side of a join is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: A key is hot if it holds at least one HOT_PARTS-th of all rows, so at most HOT_PARTS keys are hot.
HOT_PARTS = 1000
#: ... and at least so many rows.
HOT_ROWS = 64
#: Shuffle partitions whose rows go to one file of a narrow table, where Spark does not combine small partitions.
PARTITIONS_PER_FILE = 16
#: Bytes of texts that go to a Python worker at a time, besides the row that passes them.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; it goes when the driver's JVM ends.

    Where the session names none (local tests), one is made in the local temporary folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "lithoscope-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/lithoscope-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target)
    files.deleteOnExit(target)  # results may be read until then
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of shared storage."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write df to shared storage and read it back: lineage ends there, and lost executors lose nothing."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_parts(df: DataFrame) -> DataFrame:
    """df, whose rows are narrow, in few partitions to be written as few files; left alone where Spark combines small partitions itself.

    Else a table of some rows takes a file per shuffle partition, and on a local disk Hadoop starts about three processes
    for each (chmod of the file, its checksums and its folder), which share the executor's memory while they start.
    What computes df keeps its tasks; only the finished rows are dealt anew, in turn, so a frequent key does not matter.
    A task that is run again must give the same rows, in any order.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.adaptive.enabled") == "true" and conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true":
        return df
    partitions = int(conf.get("spark.sql.shuffle.partitions"))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-partitions // PARTITIONS_PER_FILE))
    return df.repartition(parts) if parts < partitions else df


def stored_narrow(df: DataFrame, path: str) -> DataFrame:
    """stored() of narrow rows in any order."""
    return stored(few_parts(df), path)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold at most BATCH_BYTES, or less where it says so; rows stay whole.

    Spark's 10,000 rows of a text each, and the buffers that double to hold them, lie outside of the executor's heap.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < most <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of a table, dealt over all cores where its files cannot be split into as many tasks; larger tables are read as they lie."""
    tasks = df._jdf.queryExecution().toRdd().getNumPartitions()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if tasks >= cores else df.repartition(cores)


def small_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within BROADCAST_ROWS; otherwise unchanged, and the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def join_hot(rows: DataFrame, index: DataFrame, key: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with index, which has one row per key and in column ``size`` the key's rows.

    Hot keys (at most HOT_PARTS, by definition) are broadcast, so their rows never meet in one task;
    the other keys are joined by a shuffle, in which no key holds more than 1/HOT_PARTS of the rows.
    """
    hot = F.col(size) >= F.lit(max(HOT_ROWS, -(-total // HOT_PARTS)))
    few = index.where(hot)
    first = rows.join(F.broadcast(few), key)
    rest = rows.join(F.broadcast(few.select(*key)), key, "left_anti").join(index.where(~hot), key)
    return first.unionByName(rest)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# ---- caches of Python workers ------------------------------------------------------------------------

_caches: dict[str, Callable[[], None]] = {}


def claim(operator: str, release: Callable[[], None] | None = None) -> None:
    """Called where an operator starts in a worker: what other operators keep between tasks is released.

    Workers are used again for later tasks and stages, so caches would otherwise add up over a pipeline.
    """
    others = [k for k in _caches if k != operator]
    for k in others:
        _caches.pop(k)()
    if others:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)
    if release:
        _caches[operator] = release


# ---- vectorised passes over UTF-8 bytes -------------------------------------------------------------

_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_S27, _S31, _S30 = np.uint64(27), np.uint64(31), np.uint64(30)
BYTE_CODES = np.random.default_rng(20_240_229).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (in place)."""
    h ^= h >> _S30
    h *= _MIX_A
    h ^= h >> _S27
    h *= _MIX_B
    h ^= h >> _S31
    return h


def lower_ascii() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_ascii()


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A table of 256 booleans, true within the inclusive ranges."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


def powers(n: int) -> np.ndarray:
    """1, s, s^2, ... of the odd step, modulo 2^64."""
    out = np.full(n, _STEP, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def words_of(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased bytes: starts, ends and 64-bit codes of the maximal runs of word bytes."""
    inside = is_word[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    at = np.flatnonzero(inside)
    length = ends - starts
    offset = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    values = BYTE_CODES[data[at]]
    values *= powers(int(length.max()))[offset]
    sums = np.add.reduceat(values, np.cumsum(length) - length)
    return starts, ends, mix(sums + length.astype(np.uint64))


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column (nulls empty) and the n+1 offsets of its rows."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices_by_bytes(column, most: int):
    """(from, to) row ranges of a string column of about ``most`` bytes each; a longer row stands alone."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def words_in_blocks(data: np.ndarray, is_word: np.ndarray, most: int = 1 << 20):
    """words_of over blocks of about ``most`` bytes, cut where no word is: arrays of starts, ends and codes of the whole."""
    parts, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + most)
        while end < n and is_word[data[end - 1]]:  # move on to the next byte outside of words
            gap = np.flatnonzero(~is_word[data[end : end + most]])
            end = end + int(gap[0]) + 1 if len(gap) else min(n, end + most)
        starts, ends, codes = words_of(LOWER[data[at:end]], is_word)
        parts.append((starts + at, ends + at, codes))
        at = end
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
