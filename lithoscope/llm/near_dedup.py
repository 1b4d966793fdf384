"""Near-duplicate classes: MinHash bands propose pairs, odd sketches sift them, full shingle sets confirm them.

1. One pass over the texts gives each document its shingle set's size and digest, the keys of BANDS bands of
   ROWS MinHash values, and an odd sketch: every (position, value) sample flips one of SKETCH_BITS parity
   bits, so the population count of two sketches' XOR estimates how many samples differ, precisely so at
   high similarities.
2. Documents with equal sets are one node, named by the smallest id.
3. Nodes are dealt by band key and sorted; within a bucket each is proposed with the bucket's smallest only,
   never all pairs.  Each node keeps the partner that it meets in most buckets; sketches and full sets confirm it.
   These links point to smaller ids, so following them gives components.
4. Buckets that still hold several components are joined to groups; in each, or in each of its buckets where that is
   less work, all nodes outside of the largest component are compared with all nodes of others, block against block
   inside the tasks; sketches sift and full sets confirm these too, and a link joins its components at once.  So every pair that shares a band and is similar enough ends in one
   component, and no step gives out the pairs of a group.

A pair at the similarity of 0.8 shares no band with probability (1 - 0.8^ROWS)^BANDS < 3e-6, and is sifted
out by its sketches only if they are more than about five standard deviations off.

Defined results: null and empty texts, and texts of separators only, have no shingles and are linked with
nothing; shorter texts than a shingle have one, their whole sequence; rows that repeat an id are one node;
rows with a null id are linked with nothing, their component is null and they are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bands and MinHash values of each.
BANDS, ROWS = 42, 6
#: Bits of an odd sketch (eight longs), and the most that two may differ in to be compared in full.
SKETCH_BITS, MOST_BITS = 512, 136
SEPARATORS = [(0x20, 0x20), (0x09, 0x0D)]
#: Pairs with one node that are confirmed in one task, and shingles of a block of nodes that are compared at once.
PAIRS_PER_TASK, BLOCK_SHINGLES = 512, 1 << 18
#: A group is dealt to so many blocks even where it is smaller, if each has so many shingles.
LEAST_BLOCKS, LEAST_SHINGLES = 16, 1 << 14

IS_WORD = ~common.byte_class(SEPARATORS)
_RNG = np.random.default_rng(1_234_577)
_SAMPLES = BANDS * ROWS
_FACTOR = _RNG.integers(0, 1 << 32, _SAMPLES, dtype=np.uint32) | np.uint32(1)
_SHIFT = _RNG.integers(0, 1 << 32, _SAMPLES, dtype=np.uint32)
_BAND_FACTOR = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_BAND_SHIFT = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_SAMPLE_SHIFT = _RNG.integers(0, 1 << 63, _SAMPLES, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """The sorted distinct 64-bit shingle codes of each text in a slice of rows."""
    n, lengths = len(offsets) - 1, np.diff(offsets)
    apart = np.full(len(data) + n, 0x20, np.uint8)  # a separator after every text
    if len(data):
        apart[np.arange(len(data)) + np.repeat(np.arange(n), lengths)] = data
    starts, _, codes = common.words_in_blocks(apart, IS_WORD)
    first = np.searchsorted(starts, offsets + np.arange(n + 1))
    spread = np.zeros(max(0, len(codes) - size + 1), np.uint64)
    for k in range(size):
        spread *= np.uint64(0x9E3779B97F4A7C15)
        spread += codes[k : k + len(spread)]
    spread = common.mix(spread)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            yield np.unique(spread[a : b - size + 1])
        elif b > a:
            whole = np.uint64(b - a)
            for c in codes[a:b]:
                whole = np.uint64((int(whole) * 0x9E3779B97F4A7C15 + int(c)) & (2**64 - 1))
            yield common.mix(np.array([whole ^ np.uint64(0x5851F42D4C957F2D)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def minhash(codes: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set."""
    least = np.full(_SAMPLES, 0xFFFFFFFF, np.uint32)
    halves = (codes >> np.uint64(32)).astype(np.uint32), codes.astype(np.uint32)
    middle = _SAMPLES // 2
    for at in range(0, len(codes), 1024):
        for half, own in zip(halves, (slice(0, middle), slice(middle, None)), strict=True):
            values = _FACTOR[own, None] * half[at : at + 1024]
            values += _SHIFT[own, None]
            np.minimum(least[own], values.min(1), out=least[own])
    return least


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per document and band."""
    blocks = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    return common.mix((blocks * _BAND_FACTOR).sum(2, dtype=np.uint64) + _BAND_SHIFT).view(np.int64)


def odd_sketches(signatures: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, as SKETCH_BITS / 64 longs per document."""
    place = common.mix(signatures.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _SAMPLE_SHIFT) % np.uint64(SKETCH_BITS)
    n = len(signatures)
    flips = np.bincount((place.astype(np.int64) + np.arange(n)[:, None] * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS)
    return np.packbits((flips & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1, bitorder="little").view(np.int64)


def estimated_similarity(differing_bits: float) -> float:
    """Of two sets whose sketches differ in so many bits."""
    flips = -SKETCH_BITS / 2 * np.log(1 - 2 * min(differing_bits, SKETCH_BITS / 2 - 0.5) / SKETCH_BITS)
    return 1 - flips / (2 * _SAMPLES)


def _signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        common.claim("near_dedup")
        for batch in batches:
            for a, b in common.slices_by_bytes(batch.column(1), 1 << 20):
                data, offsets = common.string_bytes(batch.column(1).slice(a, b - a))
                sets = list(shingle_sets(data, offsets, size))
                signed = np.stack([minhash(s) for s in sets])
                keys, sketches = band_keys(signed), odd_sketches(signed)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        lists(sketches),
                        lists(keys),
                    ],
                    names=["doc_id", "n_shingles", "digest", "sketch", "bands"],
                )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, sketch array<bigint>, bands array<bigint>")


def _bucket_members(rows: DataFrame) -> DataFrame:
    """key, doc_id and the smallest doc_id of each bucket of two or more, from rows of (key, doc_id)."""
    import pyarrow as pa

    def run(batches):
        common.claim("near_dedup")
        key = least = None  # of the bucket that the last batch ended in
        alone = False  # its only row so far is not given out yet
        for batch in batches:
            k, d = (batch.column(i).to_numpy() for i in range(2))
            if not len(k):
                continue
            new = np.r_[True, k[1:] != k[:-1]]
            if k[0] == key:
                new[0] = False
            at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            lead = np.where(at >= 0, d[np.maximum(at, 0)], least if least is not None else 0)
            with_next = np.r_[~new[1:], False]
            shared = ~new | with_next
            ks, ds, ls = k[shared], d[shared], lead[shared]
            if alone and not new[0]:
                ks, ds, ls = np.r_[key, ks], np.r_[least, ds], np.r_[least, ls]
            key, least, alone = k[-1], lead[-1], bool(new[-1])
            if len(ks):
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(ds, pa.int64()), pa.array(ls, pa.int64())], names=["key", "doc_id", "least"])

    return rows.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(run, "key bigint, doc_id bigint, least bigint")


def _sifted(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches differ in at most MOST_BITS, with that number."""
    left = pairs.join(sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sketch_a")), "a")
    both = left.join(sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    bits = sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return both.select("a", "b", bits.cast("int").alias("bits")).where(F.col("bits") <= MOST_BITS)


class _Confirm:
    """Compares full shingle sets of pairs."""

    def __init__(self, docs: DataFrame, size: int, percent: int, path: str):
        self.docs = docs
        self.size, self.percent, self.path = size, percent, path

    def sets(self, ids: DataFrame) -> DataFrame:
        """doc_id and the packed set of each of the ids."""
        import pyarrow as pa

        size = self.size

        def run(batches):
            common.claim("near_dedup")
            for batch in batches:
                for a, b in common.slices_by_bytes(batch.column(1), 1 << 20):
                    data, offsets = common.string_bytes(batch.column(1).slice(a, b - a))
                    sets = [s.tobytes() for s in shingle_sets(data, offsets, size)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], names=["doc_id", "codes"])

        found = self.docs.join(common.small_or_shuffled(ids, ids.count()), "doc_id", "left_semi")
        return found.mapInArrow(run, "doc_id bigint, codes binary")

    def pairs(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that are similar enough, stored.  A node of very many pairs is dealt to several tasks."""
        import pyarrow as pa

        percent = self.percent

        def run(batches):
            common.claim("near_dedup")
            for batch in batches:
                a, b, first, second = (batch.column(i) for i in range(4))
                good = []
                for x, y in zip(first, second, strict=True):
                    x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                    common_size = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                    good.append(100 * common_size >= percent * (len(x) + len(y) - common_size))
                good = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([a.filter(good), b.filter(good)], names=["a", "b"])

        pairs = common.stored_narrow(pairs.select("a", "b"), f"{self.path}/{name}-proposed")
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        sets = common.stored(self.sets(ids), f"{self.path}/{name}-sets")
        # No more than HOT_PARTS nodes can hold one HOT_PARTS-th of the pairs: these are dealt by a salt too.
        total = pairs.count()
        hot = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(common.HOT_ROWS, -(-total // common.HOT_PARTS)))
        hot = F.broadcast(hot.select("b", F.ceil(F.col("n") / PAIRS_PER_TASK).cast("int").alias("salts")))
        salts = F.coalesce("salts", F.lit(1))
        left = pairs.join(hot, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), salts).cast("int").alias("salt"))
        left = left.join(sets.select(F.col("doc_id").alias("a"), F.col("codes").alias("first")), "a")
        right = sets.select(F.col("doc_id").alias("b"), F.col("codes").alias("second")).join(hot, "b", "left")
        right = right.select("b", "second", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        joined = left.join(right, ["b", "salt"]).select("a", "b", "first", "second")
        return common.stored_narrow(joined.mapInArrow(run, "a bigint, b bigint"), f"{self.path}/{name}-confirmed")


def roots(parents: DataFrame, path: str) -> DataFrame:
    """doc_id and root, from doc_id and a smaller parent each, by pointer jumping."""
    step, current = 0, common.stored_narrow(parents.select("doc_id", F.col("parent").alias("root")), f"{path}/roots-0")
    while True:
        up = current.select(F.col("doc_id").alias("root"), F.col("root").alias("above"))
        step += 1
        following = common.stored_narrow(current.join(up, "root", "left").select("doc_id", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), f"{path}/roots-{step}")
        moved = not following.where("moved").isEmpty()
        current = following.select("doc_id", "root")
        if not moved:
            return current


def components(edges: DataFrame, path: str) -> DataFrame:
    """doc_id and root (smallest id reachable) of every node of the undirected edges (a, b), a != b.

    Each round, every node joins its smallest neighbour if that is smaller; edges are then contracted to the roots
    of the trees, and those within a tree go.  So a round reads only the edges that the rounds before left open.
    """
    ordered = lambda d: d.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    links, labels, step = common.stored_narrow(ordered(edges), f"{path}/links-0"), None, 0
    while labels is None or not links.isEmpty():
        step += 1
        least = links.groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("parent"))
        tree = roots(least, f"{path}/trees-{step}")
        if labels is None:
            labels = tree
        else:
            above = tree.select(F.col("doc_id").alias("root"), F.col("root").alias("above"))
            risen = labels.join(above, "root", "left").select("doc_id", F.coalesce("above", "root").alias("root"))
            labels = common.stored_narrow(risen.unionByName(tree.join(labels, "doc_id", "left_anti")), f"{path}/labels-{step}")
        of = lambda c: tree.select(F.col("doc_id").alias(c), F.col("root").alias(f"root_{c}"))  # noqa: B023, E731
        open_links = links.join(of("a"), "a").select("b", F.col("root_a").alias("a")).where("a != b")
        open_links = open_links.join(of("b"), "b", "left").select("a", F.coalesce("root_b", "b").alias("b"))
        links = common.stored_narrow(ordered(open_links), f"{path}/links-{step}")
    tops = labels.select("root").distinct()
    return labels.unionByName(tops.select(F.col("root").alias("doc_id"), "root"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs; linked from ``percent`` hundredths of similarity on."""
    path = common.shared_dir(docs.sparkSession)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    signed = common.stored(_signatures(docs, "doc_id", "text", shingle), f"{path}/signatures")
    rows, ids = signed.where("doc_id is not null").agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if rows == ids:
        return _near_dedup(docs, signed, shingle, percent, path)
    # Ids that repeat: rows are numbered and linked by their texts, then rows of one id are joined.
    row = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    numbered = common.stored(docs.withColumn("row", row), f"{path}/numbered")
    by_row = numbered.select(F.col("row").alias("doc_id"), "text")
    out = _near_dedup(by_row, common.stored(_signatures(by_row, "doc_id", "text", shingle), f"{path}/signatures-by-row"), shingle, percent, f"{path}/by-row")
    out = common.stored_narrow(out.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("part")), f"{path}/parts")
    own = numbered.select("row", "doc_id").where("row is not null").join(out, "row")
    least = own.groupBy("doc_id").agg(F.min("part").alias("b"))
    over = components(own.join(least, "doc_id").select(F.col("part").alias("a"), "b").distinct(), f"{path}/same-id")
    joined = own.join(over.select(F.col("doc_id").alias("part"), "root"), "part", "left").withColumn("top", F.coalesce("root", "part"))
    names = joined.groupBy("top").agg(F.min("doc_id").alias("component_id"))
    named = joined.join(names, "top").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    nameless = out.where("row is null").select(F.col("row").alias("doc_id"), "n_shingles", F.col("row").alias("component_id"), F.lit(True).alias("kept"))
    return named.unionByName(nameless)


def _near_dedup(docs: DataFrame, signed: DataFrame, shingle: int, percent: int, path: str) -> DataFrame:
    sets = signed.where("doc_id is not null and n_shingles > 0")
    classes = common.stored_narrow(sets.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("size")), f"{path}/classes")
    total = sets.count()
    of_class = common.join_hot(sets.select("doc_id", "digest"), classes, ["digest"], "size", total).select("doc_id", "node")
    confirm = _Confirm(docs, shingle, percent, path)

    # One row per set: the document that names it.
    named = sets.join(common.small_or_shuffled(classes.where("size > 1").select("digest", "node"), classes.where("size > 1").count()), "digest", "left")
    named = named.where(F.col("node").isNull() | (F.col("node") == F.col("doc_id"))).select("doc_id", "sketch", "bands")
    sketches = named.select("doc_id", "sketch")
    members = common.stored_narrow(_bucket_members(named.select(F.explode("bands").alias("key"), "doc_id")), f"{path}/members")

    # Of the smallest members that a node meets, the one met in most buckets is likeliest similar; the rest is left to step 4.
    stars = members.where("doc_id != least").groupBy(F.col("doc_id").alias("a"), F.col("least").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    best = stars.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("less"))).alias("best")).select("a", (-F.col("best.less")).alias("b"))
    best = _sifted(best, sketches).select("a", "b")
    first = confirm.pairs(best, "first")
    linked = roots(first.select(F.col("a").alias("doc_id"), F.col("b").alias("parent")), f"{path}/first")

    across = _across(members, linked, sketches, confirm, path)
    top = linked.withColumnRenamed("doc_id", "node")
    if across is not None and not across.isEmpty():
        of = lambda c: linked.select(F.col("doc_id").alias(c), F.col("root").alias(f"root_{c}"))
        between = across.join(of("a"), "a", "left").join(of("b"), "b", "left")
        between = between.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).distinct()
        over = components(between, f"{path}/second").withColumnRenamed("root", "over")
        nodes = linked.select("doc_id", "root").join(over.select(F.col("doc_id").alias("root"), "over"), "root", "left").select("doc_id", F.coalesce("over", "root").alias("root"))
        rest = over.select("doc_id", F.col("over").alias("root")).join(linked, "doc_id", "left_anti")
        top = common.stored_narrow(nodes.unionByName(rest), f"{path}/top").withColumnRenamed("doc_id", "node")
    # Most documents are alone: only classes of several sets or copies are joined by shuffles of narrow rows.
    labels = of_class.join(top, "node", "left").select("doc_id", F.coalesce("root", "node").alias("component"))
    labels = common.stored_narrow(labels.where("component != doc_id"), f"{path}/labels")
    out = signed.select("doc_id", "n_shingles").join(common.small_or_shuffled(labels, labels.count()), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _across(members: DataFrame, linked: DataFrame, sketches: DataFrame, confirm: _Confirm, path: str) -> DataFrame | None:
    """Links (a, b) between components that share a bucket, stored; None if no bucket holds two components.

    Buckets that still hold several components are joined to groups.  A group is compared as a whole, so that nodes
    which share many buckets meet once, or, if that makes fewer comparisons, bucket by bucket.  Every node outside of
    the largest component there is compared with every node of another one, inside tasks, block against block,
    each block bounded by the shingles in it; what comes out are the links that joined components in a task, not pairs.
    """
    rows = members.select("key", "doc_id").join(linked, "doc_id", "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    mixed = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("doc_id").alias("least")).where("low != high")
    rows = common.stored_narrow(rows.join(mixed.select("key", "least"), "key").select("key", "doc_id", "root", "least"), f"{path}/mixed")
    if rows.isEmpty():
        return None
    homes = components(rows.select(F.col("doc_id").alias("a"), F.col("least").alias("b")), f"{path}/homes").withColumnRenamed("root", "home")
    sets = common.stored(confirm.sets(rows.select("doc_id").distinct()), f"{path}/across-sets")
    about = homes.join(sets.select("doc_id", (F.octet_length("codes") / 8).alias("size")), "doc_id")
    rows = common.stored_narrow(rows.join(about, "doc_id").select("home", F.col("key").alias("bucket"), "doc_id", "root", "size"), f"{path}/placed")
    together = rows.withColumn("bucket", F.lit(0).cast("long")).distinct()

    def units(rows: DataFrame) -> DataFrame:
        parts = rows.groupBy("home", "bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
        found = parts.groupBy("home", "bucket").agg(F.max(F.struct("n", "root", "shingles")).alias("most"), F.sum("shingles").alias("all"))
        return found.select("home", "bucket", F.col("most.root").alias("largest"), "all", (F.col("all") - F.col("most.shingles")).alias("minor"))

    whole, single = units(together), units(rows).where("minor > 0")
    apart = single.groupBy("home").agg(F.sum(F.col("all") * F.col("minor")).alias("work"))
    apart = whole.where(F.col("all") > BLOCK_SHINGLES).join(apart, "home").where("work < all * minor").select("home")
    apart = common.stored_narrow(apart, f"{path}/apart")
    apart = common.small_or_shuffled(apart, apart.count())
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK_SHINGLES), F.least(F.lit(LEAST_BLOCKS), F.ceil(F.col(c) / LEAST_SHINGLES)), F.lit(1)).cast("int")
    groups = whole.join(apart, "home", "left_anti").unionByName(single.join(apart, "home", "left_semi"))
    groups = common.stored_narrow(groups.select("home", "bucket", "largest", blocks("all").alias("blocks"), blocks("minor").alias("minor_blocks")), f"{path}/groups")
    nodes = together.join(apart, "home", "left_anti").unionByName(rows.join(apart, "home", "left_semi"))
    placed = nodes.join(common.small_or_shuffled(groups, groups.count()), ["home", "bucket"]).drop("size")
    placed = placed.join(sketches, "doc_id").join(sets, "doc_id")
    columns = ["home", "bucket", "m", "b", "role", "doc_id", "root", "sketch", "codes"]
    own = lambda n, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col(n)).cast("int")
    minors = placed.where("root != largest").withColumn("m", own("minor_blocks", 1)).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    others = placed.withColumn("b", own("blocks", 2)).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("minor_blocks") - 1)))
    both = minors.withColumn("role", F.lit(0)).select(*columns).unionByName(others.withColumn("role", F.lit(1)).select(*columns))
    units_of = both.repartition("home", "bucket", "m", "b").sortWithinPartitions("home", "bucket", "m", "b", "role")
    found = units_of.mapInArrow(_compare_blocks(confirm.percent), "a bigint, b bigint")
    return common.stored(found, f"{path}/across")  # which links stand for a group depends on the order of rows, so a task's links are written by itself


class _Block:
    """Nodes outside of the largest component, held to be compared with others that pass by."""

    def __init__(self, rows: list[tuple], percent: int):
        self.percent = percent
        self.ids, self.roots, sketches, codes = (list(x) for x in zip(*rows, strict=True))
        self.roots = np.array(self.roots, np.int64)
        self.sketches = np.array(sketches, np.int64).view(np.uint64)
        self.sizes = np.array([len(c) // 8 for c in codes], np.int64)
        flat = np.frombuffer(b"".join(codes), np.uint64)
        order = np.argsort(flat, kind="stable")
        self.codes, self.owners = flat[order], np.repeat(np.arange(len(codes)), self.sizes)[order]
        self.joined: dict[int, int] = {}

    def links(self, doc_id: int, root: int, sketch: np.ndarray, codes: np.ndarray):
        """(held node, doc_id) for similar nodes of two components, which are one from then on."""
        while root in self.joined:
            root = self.joined[root]
        near = (self.roots != root) & (np.bitwise_count(self.sketches ^ sketch).sum(1, dtype=np.int64) <= MOST_BITS)
        if not near.any():
            return
        low, high = np.searchsorted(self.codes, codes), np.searchsorted(self.codes, codes, side="right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.bincount(self.owners[at], minlength=len(self.ids))
        for k in np.flatnonzero(near & (100 * both >= self.percent * (self.sizes + len(codes) - both))).tolist():
            other = int(self.roots[k])
            if other != root:
                self.joined[other] = root
                self.roots[self.roots == other] = root
                yield self.ids[k], doc_id


def _compare_blocks(percent: int):
    """A function over batches of units, in each the held nodes (role 0) first."""
    import pyarrow as pa

    def run(batches):
        common.claim("near_dedup")
        unit, held, block = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
            ids, roots = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            sketches, out = batch.column(7), []
            for i, (*key, role) in enumerate(keys):
                if key != unit:
                    unit, held, block = key, [], None
                sketch, codes = sketches[i].values.to_numpy(), batch.column(8)[i].as_py()
                if role == 0:
                    held.append((ids[i], roots[i], sketch, codes))
                elif held:
                    block = block or _Block(held, percent)
                    out += block.links(ids[i], roots[i], sketch.view(np.uint64), np.frombuffer(codes, np.uint64))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return run
