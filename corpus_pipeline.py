"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps with their columns; the last
returns token ids.  ``run`` writes each stage's rows to shared storage as Parquet and reads them again for
the next, so a lost executor costs no earlier stage.

Stages whose texts go to Python bound the session's Arrow batches by bytes (common.bound_batches).

All stages take whole texts of any length and any number of rows, none included.  Columns besides doc_id and
text are carried along by all but the last, whatever their names; a null text counts as empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoscope.llm import common
from lithoscope.llm.bpe import bpe_round_trip
from lithoscope.llm.decontaminate import find_phrases, is_contaminated
from lithoscope.llm.exact_dedup import exact_dedup, normalised
from lithoscope.llm.near_dedup import near_dedup
from lithoscope.llm.quality import THRESHOLD, score_quality, train

#: Columns that the last stage returns beside token ids, where documents have them.
KEPT_WITH_IDS = ("lang", "source")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the classifier predicts to be good.

    Empty texts are scored like others, as texts without characters; rows that repeat an id or have none are each
    scored by their own text.  Without any positive label there is no classifier, and all documents stay.
    """
    common.bound_batches(spark)
    model = train(docs, common.table(spark, sf_dir, "labels"))
    if model is None:
        return docs
    score = _unused("score", docs)
    return score_quality(docs, model, keep=tuple(docs.columns), score_name=score).where(F.col(score) >= THRESHOLD).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of texts that are equal but for white space: the longest, then of the smallest id.

    Empty texts are equal.  Rows without an id go if a row with one is as long; of rows that repeat an id (or have
    none) and an equal text, one of the longest stays.
    """
    found = exact_dedup(docs)
    gone_id, gone_sha = _unused("gone_id", docs), _unused("gone_sha", docs)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha)).distinct()
    gone = common.stored_narrow(gone, f"{common.shared_dir(spark)}/gone")
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.sha2(normalised(F.col("text")), 256) == F.col(gone_sha))
    kept = docs.join(common.small_or_shuffled(gone, gone.count()), same, "left_anti").select(*docs.columns)
    rows, ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if rows == ids:
        return kept
    first = F.max_by(F.struct(*kept.columns), F.char_length(F.coalesce("text", F.lit("")))).alias("row")
    return kept.groupBy("doc_id", F.sha2(normalised(F.col("text")), 256)).agg(first).select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near duplicates, that of the smallest id.

    Texts without words are linked with nothing and stay, as do rows without an id; rows that repeat an id are one
    document, which is linked with all that any of its texts is, and stay or go together.
    """
    common.bound_batches(spark)
    gone = near_dedup(docs).where(~F.col("kept")).select("doc_id").distinct()
    gone = common.stored_narrow(gone, f"{common.shared_dir(spark)}/gone")
    return docs.join(common.small_or_shuffled(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no more of the benchmark's phrases than clean ones may.

    Texts without words stay; rows that repeat an id or have none are judged by their own text; an empty benchmark
    leaves all documents.
    """
    common.bound_batches(spark)
    renamed = {n: _unused(f"own_{n}", docs) for n in ("n_words", "spans", "items") if n in docs.columns}
    found = find_phrases(docs.withColumnsRenamed(renamed), common.table(spark, sf_dir, "benchmark"), keep=tuple(renamed.get(c, c) for c in docs.columns))
    return found.where(~is_contaminated()).select(*[F.col(renamed.get(c, c)).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the text that they decode to.

    An empty text has no ids; rows that repeat an id or have none each have theirs.
    """
    common.bound_batches(spark)
    keep = tuple(c for c in KEPT_WITH_IDS if c in docs.columns)
    return bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), keep=keep, outputs=("ids", "n_tokens", "ids_sha256", "decoded_sha256"))


def _unused(name: str, docs: DataFrame) -> str:
    """The name, with underscores before it until no column of docs has it."""
    while name in docs.columns:
        name = f"_{name}"
    return name


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("encode", encode)]

#: Neither the classifier nor the tokenizer can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    path = common.shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
