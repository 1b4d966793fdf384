"""Passages of more than fifty words that documents share, by bucket refinement of word suffixes.

The method is that of ``suffix_dedup`` with words as symbols: a suffix's bucket at depth d has an identifier made
from those at smaller depths and later offsets (1, 3, 6, 12, 24, 48, 51).  Passages of natural text that are worth
knowing are often shorter than the strings which that operator removes, so they are counted here, and stay.

1. Every string of WORDS words has one anchor, the place of the least bucket at depth Q in its middle; strings of
   one anchor are a run.  Buckets of the words around an anchor that only one document has drop out.
2. Within a bucket, runs whose strings are all equal are one class; a class of several documents is shared throughout.
3. Only where a bucket holds several classes are single strings compared, one run standing for its class.

All groups are counted by aggregation before they are joined, so a passage that a third of all documents hold meets
in no task.

Words are the maximal runs without white space, A-Z lower-cased.  Defined results: null and empty texts and those
of fewer words share nothing; a passage that repeats in one document only does not count.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .buckets import least_in_reach, refine

#: Words of the strings that are compared, of the first buckets, and on each side of an anchor within a string.
WORDS, Q, MARGIN = 51, 3, 6
#: Places of a string where its anchor can be.
REACH = WORDS - 2 * MARGIN - Q + 1
#: Bytes of text that are taken together.
SLICE = 1 << 19
IS_WORD = ~common.byte_class([(0x20, 0x20), (0x09, 0x0D)])
_K = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA5CB3B1F2E0F9A6D, 0xC2B2AE3D27D4EB4F], np.uint64)


def _words(column) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all words of a string column, and the first word of each row (n+1 numbers)."""
    data, offsets = common.string_bytes(column)
    n = len(offsets) - 1
    apart = np.full(len(data) + n, 0x20, np.uint8)  # a separator after every text
    if len(data):
        apart[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
    starts, _, codes = common.words_in_blocks(apart, IS_WORD)
    return codes, np.searchsorted(starts, offsets + np.arange(n + 1))


def _identifiers(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every suffix: its buckets at depths Q, 2 x MARGIN and WORDS."""
    first = refine(codes, 1, Q)
    middle = refine(refine(first, Q, 2), 2 * Q, 2)
    deep = refine(refine(middle, 4 * Q, 2), 8 * Q, 2)  # 48 words; the last three are added below
    n = max(0, len(codes) - WORDS + 1)
    return first, middle, common.mix(deep[:n] * _K[0] + first[WORDS - Q : WORDS - Q + n])


def _windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the first word of every string that lies in one row."""
    count = np.maximum(0, np.diff(first) - WORDS + 1)
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) + np.repeat(first[:-1] - (np.cumsum(count) - count), count)


def _runs(docs: DataFrame) -> DataFrame:
    """bucket, class, doc_id, x (first word) and n (strings) of every run."""
    import pyarrow as pa

    def run(batches):
        common.claim("passages")
        for batch in batches:
            for a, b in common.slices_by_bytes(batch.column(1), SLICE):
                ids = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
                codes, first = _words(batch.column(1).slice(a, b - a))
                row, x = _windows_of(first)
                if not len(x):
                    continue
                q, middle, deep = _identifiers(codes)
                p = least_in_reach(q, REACH)[x + MARGIN]
                head = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (row[1:] != row[:-1])])
                n = np.diff(np.r_[head, len(x)])
                row, x, p = row[head], x[head], p[head]
                kind = common.mix(deep[x] * _K[0] + deep[x + n - 1] * _K[1] + (p - x).astype(np.uint64) * _K[2] + n.astype(np.uint64) * _K[3])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(middle[p - MARGIN].view(np.int64)), pa.array(kind.view(np.int64)), pa.array(ids[row], pa.int64()), pa.array(x - first[row], pa.int64()), pa.array(n, pa.int32())],
                    names=["bucket", "class", "doc_id", "x", "n"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "bucket bigint, class bigint, doc_id bigint, x bigint, n int")


def _strings(docs: DataFrame, asked: DataFrame, path: str) -> DataFrame:
    """string (its bucket at depth WORDS), doc_id, x (of its run), step and cross, for every string of the runs asked for."""
    import pyarrow as pa

    def run(batches):
        common.claim("passages")
        for batch in batches:
            for a, b in common.slices_by_bytes(batch.column(1), SLICE):
                ids = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
                codes, first = _words(batch.column(1).slice(a, b - a))
                lists = batch.column(2).slice(a, b - a)
                wanted = lists.flatten()
                x, n, cross = (wanted.field(c).to_numpy(zero_copy_only=False) for c in ("x", "n", "cross"))
                owner = np.repeat(np.arange(b - a), np.diff(lists.offsets.to_numpy()))
                _, _, deep = _identifiers(codes)
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                string = deep[np.repeat(x + first[owner], n) + step]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(string.view(np.int64)), pa.array(np.repeat(ids[owner], n), pa.int64()), pa.array(np.repeat(x, n), pa.int64()), pa.array(step, pa.int32()), pa.array(np.repeat(cross, n).astype(bool))],
                    names=["string", "doc_id", "x", "step", "cross"],
                )

    lists = asked.groupBy("doc_id").agg(F.collect_list(F.struct("x", "n", "cross")).alias("asked"))
    ids = common.stored(asked.select("doc_id").distinct(), f"{path}/word-documents")
    few = docs.join(common.small_or_shuffled(ids, ids.count()), "doc_id", "left_semi")
    found = few.join(lists, "doc_id").select("doc_id", "text", "asked")
    return found.mapInArrow(run, "string bigint, doc_id bigint, x bigint, step int, cross boolean")


def shared_passages(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_passages and n_passage_words of documents (doc_id, text) that hold a string of WORDS words that another holds too.

    doc_id has no nulls and does not repeat.  A passage is a maximal run of words that such strings cover.
    """
    spark = docs.sparkSession
    runs = common.stored(_runs(docs), f"{path}/word-runs")
    across = lambda d: F.min(d) != F.max(d)
    shared = runs.groupBy("bucket").agg(across("doc_id").alias("across"), F.count(F.lit(1)).alias("size")).where("across")
    shared = common.stored(shared.select("bucket", "size"), f"{path}/word-buckets")
    runs = common.stored(common.join_hot(runs, shared, ["bucket"], "size", runs.count()).drop("size"), f"{path}/word-candidates")

    stand = F.min(F.struct("doc_id", "x", "n")).alias("one")
    classes = runs.groupBy("bucket", "class").agg(across("doc_id").alias("cross"), F.count(F.lit(1)).alias("size"), stand)
    classes = common.stored(classes, f"{path}/word-classes")
    several = classes.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    asked = common.join_hot(classes, several, ["bucket"], "kinds", classes.count()).select("one.doc_id", "one.x", "one.n", "cross")
    strings = common.stored(_strings(docs, asked, path), f"{path}/word-strings")
    twice = strings.groupBy("string").agg((F.max("cross") | across("doc_id")).alias("across"), F.count(F.lit(1)).alias("size")).where("across").select("string", "size")
    twice = common.stored(twice, f"{path}/word-repeats")
    hits = common.join_hot(strings.where("not cross"), twice, ["string"], "size", strings.count())
    bounds = hits.groupBy("doc_id", "x").agg(F.min("step").alias("low"), F.max("step").alias("high"))

    partly = classes.where("not cross").select("bucket", "class", "size", "one.doc_id", "one.x").join(bounds, ["doc_id", "x"]).drop("doc_id", "x")
    whole = classes.where("cross").select("bucket", "class", "size", F.lit(0).alias("low"), (F.col("one.n") - 1).alias("high"))
    bounds = common.stored(whole.unionByName(partly), f"{path}/word-bounds")
    spans = common.join_hot(runs, bounds, ["bucket", "class"], "size", runs.count())
    spans = spans.select("doc_id", (F.col("x") + F.col("low")).alias("from"), (F.col("x") + F.col("high") + WORDS).alias("to"))
    by_place = Window.partitionBy("doc_id").orderBy("from", "to")
    before = F.max("to").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    pieces = spans.withColumn("before", F.coalesce(before, F.lit(-1)))
    fresh = F.greatest(F.lit(0), F.col("to") - F.greatest("from", "before"))
    out = pieces.groupBy("doc_id").agg(F.count_if(F.col("before") < F.col("from")).alias("n_passages"), F.sum(fresh).alias("n_passage_words"))
    out = common.stored(out, f"{path}/passages")
    for name in ("runs", "buckets", "candidates", "classes", "documents", "strings", "repeats", "bounds"):
        common.remove(spark, f"{path}/word-{name}")
    return out


def brute_force(texts: list[str | None], words: int = WORDS) -> list[tuple[int, int]]:
    """n_passages and n_passage_words of each text, from a table of all strings; for tests."""
    import re

    lists = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    holders: dict[tuple, set[int]] = {}
    for i, w in enumerate(lists):
        for k in range(len(w) - words + 1):
            holders.setdefault(tuple(w[k : k + words]), set()).add(i)
    out = []
    for w in lists:
        hit = np.zeros(len(w) + 1, bool)
        for k in range(len(w) - words + 1):
            if len(holders[tuple(w[k : k + words])]) > 1:
                hit[k : k + words] = True
        out.append((int((np.diff(np.r_[False, hit].astype(np.int8)) == 1).sum()), int(hit.sum())))
    return out
