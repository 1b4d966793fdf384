"""Repeated-substring removal by bucket-pointer refinement of text suffixes.

A byte is removed if a string of LENGTH bytes that covers it starts anywhere else too.  All suffixes of all
texts are compared to that depth by refining buckets.  A suffix's bucket at depth d has an identifier that
its first d bytes alone determine; sorting by the pair of identifiers at its own and a later offset refines
the bucket to twice the depth, and each refined identifier is used again for the next: Q, 2Q, ... LENGTH.
As identifiers are 64-bit codes of content rather than ranks, every task computes them for its own texts
without exchange, and equal strings carry equal identifiers everywhere.

Sorting all suffixes would move many times the text, so buckets are emptied of what cannot repeat first:

1. Every window of LENGTH bytes has one anchor, the place of the least Q-gram bucket in its middle.  The
   windows of one anchor are consecutive, a run.  Anchors are sorted by their bucket at depth 2 x MARGIN
   around the anchor: an anchor alone there has no repeated window, and drops out.
2. Within a bucket, runs whose windows are all equal are one class (sorted by the buckets of their ends).
   Members of a class of two or more are repeated throughout.
3. Only where a bucket holds several classes are single windows sorted, by their bucket at depth LENGTH; a
   class is represented once.  Windows that share a bucket are repeated.

The windows of an anchor all contain it, so the first and last repeated one bound what they remove.

Defined results: null and empty texts, and those shorter than LENGTH, keep all bytes; rows that repeat a
text are copies of each other, and texts of at least LENGTH bytes go altogether; rows that repeat an id
or have none are told apart by their place in the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .buckets import least_in_reach, refine
from .passages import shared_passages

#: Bytes of the strings that are compared, of the first buckets, and on each side of an anchor within a window.
LENGTH, Q, MARGIN = 400, 25, 100
#: Places of a window where its anchor can be.
REACH = LENGTH - 2 * MARGIN - Q + 1
#: Bytes of text that are refined together; a longer text is taken in blocks that overlap.
BLOCK = 1 << 19
_K = np.array([0xD6E8FEB86659FD93, 0xA5CB3B1F2E0F9A6D, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def buckets(data: np.ndarray, depths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Bucket identifiers of every suffix at the depths asked for, by repeated refinement."""
    ids = refine(refine(common.BYTE_CODES[data], 1, 5), 5, 5)
    depth, kept = Q, {}
    while True:
        if depth in depths:
            kept[depth] = ids
        if depth >= max(depths):
            return kept
        ids, depth = refine(ids, depth, 2), 2 * depth


def pieces(data: np.ndarray, offsets: np.ndarray):
    """(row, offset in its text, from, to) of texts of at least LENGTH bytes; long ones in overlapping blocks."""
    for row in np.flatnonzero(np.diff(offsets) >= LENGTH).tolist():
        a, b = int(offsets[row]), int(offsets[row + 1])
        for at in range(a, b - LENGTH + 1, BLOCK):
            yield row, at - a, at, min(b, at + BLOCK + LENGTH - 1)


def groups_of_pieces(data: np.ndarray, offsets: np.ndarray):
    """Pieces gathered to about BLOCK bytes: their bytes joined, and arrays of row, offset, from and length."""
    held, size = [], 0
    for p in pieces(data, offsets):
        if held and size + p[3] - p[2] > BLOCK + LENGTH:
            yield _joined(data, held)
            held, size = [], 0
        held.append(p)
        size += p[3] - p[2]
    if held:
        yield _joined(data, held)


def _joined(data: np.ndarray, held: list[tuple]):
    rows, offs, froms, tos = (np.array(x, np.int64) for x in zip(*held, strict=True))
    lengths = tos - froms
    return np.concatenate([data[a:b] for a, b in zip(froms, tos, strict=True)]), rows, offs, np.cumsum(lengths) - lengths, lengths


def runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """Of joined pieces: each run's piece, first window, number of windows, anchor, bucket and class."""
    ids = buckets(data, (Q, 2 * MARGIN, LENGTH))
    anchor = least_in_reach(ids[Q], REACH)
    count = lengths - LENGTH + 1
    piece = np.repeat(np.arange(len(starts)), count)
    x = np.arange(len(piece)) + np.repeat(starts - (np.cumsum(count) - count), count)
    p = anchor[x + MARGIN]
    new = np.r_[True, (p[1:] != p[:-1]) | (piece[1:] != piece[:-1])]
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(x)])
    x0, p, piece = x[first], p[first], piece[first]
    deep = ids[LENGTH]
    lead = (p - x0).astype(np.uint64)
    kind = common.mix(deep[x0] * _K[0] + deep[x0 + n - 1] * _K[1] + lead * _K[2] + n.astype(np.uint64) * _K[3])
    return piece, x0, n, p, ids[2 * MARGIN][p - MARGIN], kind


#: States of a run: its class is to be compared; it is known to have other members and this run stands for them; this is one of those.
OPEN, STANDS, SETTLED = 0, 1, 2


def settle(bucket: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The state of each run of a task's slice: members of a class that is there twice need not travel to be compared."""
    order = np.lexsort((kind, bucket))
    b, k = bucket[order], kind[order]
    same = (b[1:] == b[:-1]) & (k[1:] == k[:-1])
    state = np.zeros(len(order), np.int8)
    state[order[1:][same]] = SETTLED
    stands = np.r_[same, False] & ~np.r_[False, same]
    state[order[stands]] = STANDS
    return state


def _anchors(docs: DataFrame) -> DataFrame:
    """bucket, class, doc_id, first window, shape (lead to the anchor, number of windows) and state of every run."""
    import pyarrow as pa

    def run(batches):
        common.claim("suffix_dedup")
        for batch in batches:
            for a, b in common.slices_by_bytes(batch.column(1), BLOCK):
                ids = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
                data, offsets = common.string_bytes(batch.column(1).slice(a, b - a))
                for joined, rows, offs, starts, lengths in groups_of_pieces(data, offsets):
                    piece, x0, n, p, bucket, kind = runs(joined, starts, lengths)
                    at = x0 - starts[piece] + offs[piece]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(bucket.view(np.int64)),
                            pa.array(kind.view(np.int64)),
                            pa.array(ids[rows[piece]], pa.int64()),
                            pa.array(at, pa.int64()),
                            pa.array((p - x0) * 1024 + n, pa.int32()),
                            pa.array(settle(bucket, kind)),
                        ],
                        names=["bucket", "class", "doc_id", "x", "shape", "state"],
                    )

    return docs.select("doc_id", "text").mapInArrow(run, "bucket bigint, class bigint, doc_id bigint, x bigint, shape int, state tinyint")


def _classes(anchors: DataFrame) -> DataFrame:
    """doc_id, x, shape, repeated and asked of the runs whose bucket holds others.

    repeated: its class has other members; asked: the bucket has other classes, and this run stands for its own.
    Rows of a bucket may be many: the pass over them keeps two rows in hand, whatever the bucket's size.
    """
    import pyarrow as pa

    names = ["bucket", "class", "doc_id", "x", "shape", "state"]

    def give(cols, repeated, asked):
        some = repeated | asked
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[2][some]), pa.array(cols[3][some]), pa.array(cols[4][some], pa.int32()), pa.array(repeated[some]), pa.array(asked[some])], names=["doc_id", "x", "shape", "repeated", "asked"]
        )

    def run(batches):
        common.claim("suffix_dedup")
        before = None  # bucket and class of the row before those in hand
        held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int32, np.int8)]
        leader = None  # the open bucket's first run, while it is of the bucket's only class: its columns and whether repeated
        for cols in _and_end(batches, names):
            last = cols is None
            if not last:
                settled = cols[5] == SETTLED
                if settled.any():
                    yield give(cols, settled, np.zeros(len(settled), bool))
                    cols = [x[~settled] for x in cols]
            rows = held if last else [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            if not len(rows[0]):
                continue
            b, c = rows[0], rows[1]
            new_b = np.r_[before is None or before[0] != b[0], b[1:] != b[:-1]]
            new_c = new_b | np.r_[before is None or before[1] != c[0], c[1:] != c[:-1]]
            n = len(b) if last else len(b) - 1  # the last row waits for its follower
            if not n:
                held = rows
                continue
            repeated = ~new_c[:n] | np.r_[~new_c[1:], False][:n] | (rows[5][:n] == STANDS)
            second = new_c[:n] & ~new_b[:n]  # a further class of its bucket
            asked = second.copy()
            heads = np.flatnonzero(new_b[:n])
            further = np.flatnonzero(second)
            until = heads[0] if len(heads) else n
            if leader is not None and len(further) and further[0] < until:
                yield give(leader, np.zeros(1, bool), np.ones(1, bool))
                leader = None
            elif leader is not None and len(heads):
                leader = None
            # The first run of each bucket is asked if a further class follows before the next bucket.
            ends = np.r_[heads[1:], n]
            at = np.searchsorted(further, heads)
            follows = (at < len(further)) & (further[np.minimum(at, len(further) - 1)] < ends) if len(further) else np.zeros(len(heads), bool)
            asked[heads[follows]] = True
            if len(heads) and not follows[-1]:
                leader = [x[heads[-1] : heads[-1] + 1] for x in rows]
            yield give([x[:n] for x in rows], repeated, asked)
            before = b[n - 1], c[n - 1]
            held = [x[n:] for x in rows]

    deal = F.when(F.col("state") == SETTLED, F.xxhash64("doc_id", "x")).otherwise(F.col("bucket"))
    placed = anchors.withColumn("deal", deal).repartition("deal").drop("deal").sortWithinPartitions("bucket", "class")
    return placed.mapInArrow(run, "doc_id bigint, x bigint, shape int, repeated boolean, asked boolean")


def _and_end(batches, names):
    for batch in batches:
        yield [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
    yield None


def _windows(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """bucket, deep (at depth LENGTH), doc_id, x (of its run) and step, for every window of the runs asked for."""
    import pyarrow as pa

    def run(batches):
        common.claim("suffix_dedup")
        for batch in batches:
            for a, b in common.slices_by_bytes(batch.column(1), BLOCK):
                ids = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
                data, offsets = common.string_bytes(batch.column(1).slice(a, b - a))
                lists = batch.column(2).slice(a, b - a)
                wanted = lists.flatten()
                xs = wanted.field("x").to_numpy(zero_copy_only=False)
                shapes = wanted.field("shape").to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(b - a), np.diff(lists.offsets.to_numpy()))
                order = np.lexsort((xs, owner))
                xs, shapes, owner = xs[order], shapes[order], owner[order]
                for joined, rows, offs, starts, lengths in groups_of_pieces(data, offsets):
                    ends = offs + lengths - LENGTH  # the last window of each piece
                    first = np.searchsorted(owner * (1 << 40) + xs, rows * (1 << 40) + offs)
                    after = np.searchsorted(owner * (1 << 40) + xs, rows * (1 << 40) + ends, side="right")
                    size = after - first
                    if not size.sum():
                        continue
                    mine = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    piece = np.repeat(np.arange(len(rows)), size)
                    deep = buckets(joined, (2 * MARGIN, LENGTH))
                    x0, lead, n = xs[mine] - offs[piece] + starts[piece], shapes[mine] // 1024, shapes[mine] % 1024
                    bucket = deep[2 * MARGIN][x0 + lead - MARGIN]
                    run_of = np.repeat(np.arange(len(n)), n)
                    step = np.arange(len(run_of)) - np.repeat(np.cumsum(n) - n, n)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(bucket[run_of].view(np.int64)),
                            pa.array(deep[LENGTH][x0[run_of] + step].view(np.int64)),
                            pa.array(ids[rows[piece[run_of]]], pa.int64()),
                            pa.array(xs[mine][run_of], pa.int64()),
                            pa.array(step, pa.int32()),
                        ],
                        names=["bucket", "deep", "doc_id", "x", "step"],
                    )

    lists = asked.groupBy("doc_id").agg(F.collect_list(F.struct("x", "shape")).alias("asked"))
    found = docs.join(_ids(asked), "doc_id", "left_semi").join(lists, "doc_id").select("doc_id", "text", "asked")
    return found.mapInArrow(run, "bucket bigint, deep bigint, doc_id bigint, x bigint, step int")


def _ids(rows: DataFrame) -> DataFrame:
    """The distinct doc_ids of rows, to be broadcast if they are few."""
    ids = rows.select("doc_id").distinct()
    return common.small_or_shuffled(ids, ids.count())


def _repeated_windows(windows: DataFrame) -> DataFrame:
    """doc_id, x and step of the windows that share a bucket at depth LENGTH with another.

    They are dealt out by their identifier at that depth: only equal windows meet, whatever the bucket's size.
    """
    import pyarrow as pa

    names = ["bucket", "deep", "doc_id", "x", "step"]

    def run(batches):
        common.claim("suffix_dedup")
        before, held = None, [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int32)]
        for cols in _and_end(batches, names):
            last = cols is None
            rows = held if last else [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            n = len(rows[0]) if last else len(rows[0]) - 1
            if n <= 0:
                held = rows
                continue
            b, d = rows[0], rows[1]
            same = np.r_[before is not None and before == (b[0], d[0]), (b[1:] == b[:-1]) & (d[1:] == d[:-1])]
            twice = same[:n] | np.r_[same[1:], False][:n]
            yield pa.RecordBatch.from_arrays([pa.array(x[:n][twice]) for x in rows[2:]], names=names[2:])
            before, held = (b[n - 1], d[n - 1]), [x[n:] for x in rows]

    placed = windows.repartition("deep").sortWithinPartitions("deep", "bucket")
    return placed.mapInArrow(run, "doc_id bigint, x bigint, step int")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_removed, n_spans, kept_sha256 and the merged spans of the documents that have any."""
    import pyarrow as pa

    pair = pa.struct([("from", pa.int64()), ("to", pa.int64())])

    def run(batches):
        common.claim("suffix_dedup")
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data, at, kept, removed = text.as_py().encode(), 0, hashlib.sha256(), 0
                own = merged([(s["from"], s["to"]) for s in found.as_py()])
                for a, b in own:
                    kept.update(data[at:a])
                    removed += b - a
                    at = b
                kept.update(data[at:])
                out.append((removed, len(own), kept.hexdigest(), [{"from": a, "to": b} for a, b in own]))
            n_removed, n_spans, digest, spans = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, pa.list_(pair))], names=["doc_id", "n_removed", "n_spans", "kept_sha256", "spans"])

    lists = spans.groupBy("doc_id").agg(F.collect_list(F.struct("from", "to")).alias("found"))
    joined = docs.join(_ids(spans), "doc_id", "left_semi").join(lists, "doc_id").select("doc_id", "text", "found")
    return joined.mapInArrow(run, "doc_id bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<from:bigint,to:bigint>>")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (UTF-8 bytes removed) for every row of docs.

    n_passages and n_passage_words count the passages of more than fifty words that another row holds too, whether
    they are long enough to be removed or not (see ``passages``).
    """
    spark = docs.sparkSession
    path = common.shared_dir(spark)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    narrow = lambda d: d.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    whole = common.stored(narrow(docs), f"{path}/whole")
    rows, ids = whole.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if rows != ids:  # ids that repeat or are null: rows are numbered, and the numbers stay with stored rows
        numbered = common.stored(docs.withColumn("row", F.monotonically_increasing_id()), f"{path}/numbered")
        docs = numbered.select(F.col("row").alias("doc_id"), "text")
        whole = common.stored(narrow(docs), f"{path}/whole-numbered")
        out = _suffix_dedup(docs, whole, rows, path).withColumnRenamed("doc_id", "row")
        return numbered.select("row", "doc_id").join(out, "row").drop("row")
    return _suffix_dedup(docs, whole, rows, path)


def _suffix_dedup(docs: DataFrame, whole: DataFrame, rows: int, path: str) -> DataFrame:
    # Copies of whole texts are removed altogether; of the largest groups one copy stands for all below.
    groups = whole.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = common.stored(groups, f"{path}/copies")
    copies = common.join_hot(whole.select("doc_id", "sha"), groups, ["sha"], "size", rows).select("doc_id", F.lit(True).alias("copy"))
    copies = common.stored(copies, f"{path}/copied")
    hot = F.broadcast(groups.where(F.col("size") >= max(common.HOT_ROWS, -(-rows // common.HOT_PARTS))).select("sha", "first"))
    others = docs.withColumn("sha", F.sha2("text", 256)).join(hot, "sha", "left").where("first is null or first = doc_id").select("doc_id", "text")

    classes = common.stored(_classes(_anchors(others)), f"{path}/classes")
    windows = _repeated_windows(_windows(docs, classes.where("asked")))
    single = windows.groupBy("doc_id", "x").agg(F.min("step").alias("low"), F.max("step").alias("high"))
    spans = classes.where("repeated").select("doc_id", F.col("x").alias("from"), (F.col("x") + F.col("shape") % 1024 - 1 + LENGTH).alias("to"))
    spans = spans.unionByName(single.select("doc_id", (F.col("x") + F.col("low")).alias("from"), (F.col("x") + F.col("high") + LENGTH).alias("to")))
    few = common.small_or_shuffled(copies, copies.count())
    spans = common.stored(spans.join(few, "doc_id", "left_anti"), f"{path}/spans")
    cut = common.stored(_cut(docs, spans), f"{path}/cut")
    for name in ("classes", "spans"):
        common.remove(docs.sparkSession, f"{path}/{name}")
    passages = shared_passages(docs, path)

    out = whole.join(few.distinct(), "doc_id", "left").join(cut, "doc_id", "left")  # its lists of spans have no bound to broadcast by
    out = out.join(passages, "doc_id", "left")
    gone = F.col("copy").isNotNull()
    full = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n_bytes").alias("to")))
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone, full).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.coalesce("n_passages", F.lit(0).cast("long")).alias("n_passages"),
        F.coalesce("n_passage_words", F.lit(0).cast("long")).alias("n_passage_words"),
    )


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans and kept_sha256 of each text, from a table of all strings; for tests."""
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - length + 1):
            key = hashlib.blake2b(d[i : i + length], digest_size=16).digest()
            seen[key] = seen.get(key, 0) + 1
    out = []
    for d in data:
        spans = merged([(i, i + length) for i in range(len(d) - length + 1) if seen[hashlib.blake2b(d[i : i + length], digest_size=16).digest()] > 1])
        keep = np.ones(len(d), bool)
        for a, b in spans:
            keep[a:b] = False
        kept = np.frombuffer(d, np.uint8)[keep].tobytes()
        out.append((len(d), len(d) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out
