"""Exact deduplication over a log-structured merge index of content digests, in DataFrame operations only.

1. Documents are digested where they lie; every MEMTABLE_ROWS rows of a task fill the next of MEMTABLES memtables.
2. A memtable is flushed as a run: one row per digest, sorted, with the row that stays so far and the number of
   rows.  Each run has a Bloom filter, a table of blocks of 64 bits; all filters of an index have as many blocks,
   so the filter of merged runs is the union of theirs.
3. Compaction merges FANOUT runs of a level to one of the next, until one run is left.  A digest that no filter of
   the other runs knows passes through as it is; only hits are shuffled, and keep the better row and both counts.
4. Documents whose digest more than one row has are verified byte for byte against the row that stays; texts that
   differ although their digests agree are grouped again by the texts themselves.

Defined results: a null text counts as empty; a null id sorts after all others; rows that repeat an id
and a text each count in group_size and share one decision; an empty table gives an empty result; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The characters that do not count, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: Members of a group of copies that are verified in one task against one copy of the text that stays.
VERIFY_ROWS = 2048
#: Rows of a task after which the next memtable is filled, memtables of a table, and runs that are merged to one.
MEMTABLE_ROWS, MEMTABLES, FANOUT = 4096, 8, 4
#: Digests for each block of 64 bits of a filter; a digest sets four bits.
KEYS_PER_BLOCK = 4
#: Blocks of filters up to which they are broadcast (about 5 MB).
FILTER_ROWS = 1 << 16


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _order(n_chars: Column, doc_id: Column) -> Column:
    """What sorts first stays: most characters, then the smallest id, missing ids last."""
    return F.struct((-n_chars).alias("less"), doc_id.isNull().alias("unnamed"), doc_id.alias("doc_id"))


class DigestIndex:
    """Entries of documents, runs of sorted digests with their filters, and the levels that compaction makes of them."""

    def __init__(self, spark: SparkSession, path: str, digest_bytes: int = 32):
        self.spark, self.path, self.digest_bytes, self.blocks = spark, path, digest_bytes, 0

    def load(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = MEMTABLE_ROWS) -> None:
        """Digest all documents and flush their memtables as the runs of level 0."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        place = F.monotonically_increasing_id()  # of a task's rows, the low 33 bits count them
        memtable = F.pmod(F.shiftright(place, 33) + F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / memtable_rows), F.lit(MEMTABLES))
        rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(text), 256)).alias("sha"), F.char_length(text).cast("long").alias("n_chars"), memtable.cast("int").alias("run"))
        self.entries = common.stored(rows.withColumn("digest", F.substring("sha", 1, self.digest_bytes)), f"{self.path}/entries")
        self.rows = self.entries.count()
        self.blocks = 1 << max(8, (self.rows // KEYS_PER_BLOCK).bit_length())
        runs = self.entries.groupBy("run", "digest").agg(F.min(_order(F.col("n_chars"), F.col("doc_id"))).alias("first"), F.count(F.lit(1)).alias("group_size"))
        self.level, self.runs = self._written(runs, 0), MEMTABLES
        self.filters = self._filters(self.level.select("run", *self._bits()), 0)

    def _bits(self) -> list[Column]:
        """Of a digest: its block, and the bits that are set there."""
        h = F.xxhash64("digest")
        bits = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(digest), {at}) & 63 as int))") for at in (40, 46, 52, 58)]
        return [h.bitwiseAND(F.lit(self.blocks - 1)).alias("block"), functools.reduce(Column.bitwiseOR, bits).alias("mask")]

    def _written(self, runs: DataFrame, level: int) -> DataFrame:
        return common.stored(common.few_parts(runs.select("run", "digest", "first", "group_size")).sortWithinPartitions("run", "digest"), f"{self.path}/level-{level}")

    def _filters(self, masks: DataFrame, level: int) -> DataFrame:
        return common.stored_narrow(masks.groupBy("run", "block").agg(F.bit_or("mask").alias("mask")), f"{self.path}/filters-{level}")

    def probed(self) -> DataFrame:
        """The level's rows with the run of the next level that they go to, and hit: whether a filter of another run that goes there knows them."""
        into, part = F.floor(F.col("run") / FANOUT).cast("int"), F.pmod(F.col("run"), F.lit(FANOUT))
        per_run = [F.bit_or(F.when(part == i, F.col("mask"))).alias(f"f{i}") for i in range(FANOUT)]
        filters = self.filters.groupBy(into.alias("into"), "block").agg(*per_run)
        if self.filters.count() <= FILTER_ROWS:
            filters = F.broadcast(filters)
        rows = self.level.select(into.alias("into"), part.alias("part"), "digest", "first", "group_size", *self._bits()).join(filters, ["into", "block"], "left")
        others = [(F.col("part") != i) & (F.coalesce(F.col(f"f{i}"), F.lit(0).cast("long")).bitwiseAND(F.col("mask")) == F.col("mask")) for i in range(FANOUT)]
        return rows.select(F.col("into").alias("run"), "digest", "first", "group_size", functools.reduce(Column.__or__, others).alias("hit"))

    def compact(self) -> DataFrame:
        """Merge runs level by level: digest, keep_id and group_size, one row per digest."""
        level = 0
        while self.runs > 1:
            level += 1
            probed = self.probed()
            merged = probed.where("hit").groupBy("run", "digest").agg(F.min("first").alias("first"), F.sum("group_size").alias("group_size"))
            passed = probed.where(~F.col("hit")).drop("hit")
            self.level, self.runs = self._written(passed.unionByName(merged), level), -(-self.runs // FANOUT)
            if self.runs > 1:
                self.filters = self._filters(self.filters.select(F.floor(F.col("run") / FANOUT).cast("int").alias("run"), "block", "mask"), level)
        return self.level.select("digest", F.col("first.doc_id").alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text) for every row of docs.

    digest_bytes: the length of the index's keys; shorter ones only make more texts meet in verification.
    """
    spark = docs.sparkSession
    index = DigestIndex(spark, common.shared_dir(spark), digest_bytes)
    index.load(docs, id_col, text_col)
    groups = common.stored_narrow(index.compact().where("group_size > 1"), f"{index.path}/groups")
    # Hot groups are broadcast, others as well if they are few; documents that are alone need no partner.
    hot = F.col("group_size") >= F.lit(max(common.HOT_ROWS, -(-index.rows // common.HOT_PARTS)))
    often = F.broadcast(groups.where(hot))
    seldom = common.small_or_shuffled(groups.where(~hot), groups.count())
    entries = index.entries.select("doc_id", "sha", "digest")
    rest = entries.join(often.select("digest"), "digest", "left_anti").join(seldom, "digest", "left")
    alone = F.col("group_size").isNull()
    rest = rest.select("digest", "doc_id", "sha", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    decided = entries.join(often, "digest").select(*rest.columns).unionByName(rest)
    members = common.stored_narrow(decided.where("group_size > 1").select("doc_id", "digest", "keep_id", "group_size").distinct(), f"{index.path}/members")
    collided = _collisions(docs, members, id_col, text_col, digest_bytes, index.path)
    if collided is not None:
        wrong, regrouped = collided
        decided = decided.join(wrong, "digest", "left_anti").select("doc_id", "sha", "keep_id", "group_size").unionByName(regrouped)
    return decided.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _collisions(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, digest_bytes: int, path: str):
    """None if all texts of a digest are equal; else the digests that are not and the right rows for their documents."""
    side = common.small_or_shuffled(members.withColumnRenamed("doc_id", "member_id"), members.count())
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(side, F.col("doc_id").eqNullSafe(F.col("member_id")))
    texts = texts.select("doc_id", normalised(F.col("text")).alias("norm"), F.char_length(F.coalesce("text", F.lit(""))).alias("n_chars"), "digest", "keep_id", "group_size")
    texts = common.stored(texts, f"{path}/texts")  # read twice below
    texts = texts.where(F.substring(F.unhex(F.sha2("norm", 256)), 1, digest_bytes) == F.col("digest"))
    salts = F.ceil(F.col("group_size") / F.lit(VERIFY_ROWS)).cast("int")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    kept = texts.where(stays).dropDuplicates(["digest"])
    kept = kept.select("digest", F.col("norm").alias("kept_norm"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    hits = texts.where(~stays).withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int"))
    wrong = hits.join(kept, ["digest", "salt"]).where(F.col("norm") != F.col("kept_norm")).select("digest").distinct()
    wrong = common.stored_narrow(wrong, f"{path}/collided")
    if wrong.isEmpty():
        common.remove(docs.sparkSession, f"{path}/texts")
        return None
    again = texts.join(wrong, "digest", "left_semi")
    groups = again.groupBy("digest", "norm").agg(F.min(_order(F.col("n_chars"), F.col("doc_id"))).alias("first"), F.count(F.lit(1)).alias("size"))
    right = again.select("doc_id", "digest", "norm").join(groups, ["digest", "norm"])
    return wrong, right.select("doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), F.col("first.doc_id").alias("keep_id"), F.col("size").alias("group_size"))
