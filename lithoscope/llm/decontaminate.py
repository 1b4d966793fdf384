"""Benchmark decontamination: an FM-index per shard of training text, searched for the benchmark's phrases.

Words are the maximal runs of ASCII digits, letters (in either case) and non-ASCII characters.  A phrase is
13 consecutive words of an item, or the whole of a shorter one.  Each task collects its documents into
shards; words that no phrase has cannot be part of an occurrence, so runs of them become separators, and a
run of phrase words shorter than the shortest phrase is left out.  The rest is indexed (suffix array by
prefix doubling, BWT, wavelet matrix, sampled positions); all phrases are searched backwards at once, their
occurrences located, and the spans merged per document.

The benchmark is the stated query set: it is taken in blocks of at most BLOCK_BYTES, each broadcast alone; further
blocks read the documents again, and one block at a time is held by the driver.

Defined results: null and empty texts have no words and are clean; items without words have no phrase;
items with a null id mark words and count for contamination, but add no id; repeated rows and items
repeat their results; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .fm_index import FmIndex

#: Words of a phrase.
WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20
#: Text bytes of a shard, and of a block of benchmark items.
SHARD_BYTES, BLOCK_BYTES = 16 << 20, 8 << 20
#: Bytes that belong to words, after lower-casing A-Z: 0-9, a-z, and all of UTF-8's non-ASCII bytes.
IS_WORD = common.byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])

SPAN = "struct<word_from:bigint,word_to:bigint,byte_from:bigint,byte_to:bigint>"
RESULT = f"n_words bigint, spans array<{SPAN}>, items array<bigint>"


class Phrases:
    """The distinct phrases of benchmark items over a numbered vocabulary."""

    def __init__(self, items: list[tuple[int | None, str]], window: int = WINDOW):
        found: dict[tuple, set[int]] = {}
        for item_id, text in items:
            codes = common.words_in_blocks(np.frombuffer((text or "").encode(), np.uint8), IS_WORD)[2].tolist()
            size = min(window, len(codes))
            for i in range(len(codes) - size + 1 if size else 0):
                found.setdefault(tuple(codes[i : i + size]), set()).update(() if item_id is None else (item_id,))
        self.items = [sorted(x) for x in found.values()]
        self.vocabulary = np.unique(np.array([c for p in found for c in p], np.uint64))
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.shortest = int(self.lengths.min()) if found else 0
        self.patterns = np.zeros((len(found), window), np.int64)
        for k, p in enumerate(found):
            self.patterns[k, window - len(p) :] = np.searchsorted(self.vocabulary, np.array(p, np.uint64)) + 1
        # Top bits of a code lead to the few places where it can be.
        self.shift = np.uint64(64 - 16)
        self.table = np.searchsorted(self.vocabulary >> self.shift, np.arange((1 << 16) + 1, dtype=np.uint64))

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """1 + the place of each code in the vocabulary, 0 for other words."""
        top = (codes >> self.shift).astype(np.int64)
        at, end = self.table[top], self.table[top + 1]
        out = np.zeros(len(codes), np.int64)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            same = self.vocabulary[at[open_]] == codes[open_]
            out[open_[same]] = at[open_[same]] + 1
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out


class Shard:
    """Documents whose phrase words are gathered for one index."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.n_words, self.parts, self.size = phrases, [], [], 0

    def add(self, data: np.ndarray) -> None:
        doc = len(self.n_words)
        starts, ends, codes = common.words_in_blocks(data, IS_WORD)
        self.n_words.append(len(codes))
        self.size += len(data)
        if self.phrases.shortest and len(codes) >= self.phrases.shortest:
            symbols = self.phrases.symbols(codes)
            edge = np.flatnonzero(np.diff((symbols > 0).view(np.int8), prepend=0, append=0))
            first, last = edge[::2], edge[1::2]
            long = last - first >= self.phrases.shortest
            for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
                self.parts.append((doc, a, symbols[a:b], starts[a:b], ends[a:b]))

    def results(self) -> tuple[list[list[tuple]], list[list[int]]]:
        """Of each document: its merged spans, and the items that occur in it."""
        spans: list[list[tuple]] = [[] for _ in self.n_words]
        items: list[set[int]] = [set() for _ in self.n_words]
        if self.parts:
            gap = np.zeros(1, np.int64)
            text = np.concatenate([x for p in self.parts for x in (p[2], gap)])
            index = FmIndex(text, len(self.phrases.vocabulary) + 1)
            low, high = index.search(self.phrases.patterns, self.phrases.lengths)
            sizes = high - low
            pattern = np.repeat(np.arange(len(low)), sizes)
            rows = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            where = index.locate(rows)
            part_at = np.cumsum([0] + [len(p[2]) + 1 for p in self.parts])
            part = np.searchsorted(part_at, where, side="right") - 1
            doc_of = np.array([p[0] for p in self.parts])
            for d, k in set(zip(doc_of[part].tolist(), pattern.tolist(), strict=True)):
                items[d].update(self.phrases.items[k])
            cover = np.zeros(len(text) + 1, np.int64)
            np.add.at(cover, where, 1)
            np.add.at(cover, where + self.phrases.lengths[pattern], -1)
            edge = np.flatnonzero(np.diff((np.cumsum(cover) > 0).view(np.int8), prepend=0))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                k = int(np.searchsorted(part_at, a, side="right")) - 1
                doc, word, _, starts, ends = self.parts[k]
                i, j = a - part_at[k], b - part_at[k]
                spans[doc].append((int(word + i), int(word + j), int(starts[i]), int(ends[j - 1])))
        return spans, [sorted(x) for x in items]


def _search(docs: DataFrame, items: list[tuple[int, str]], names: list[str], text_col: str, window: int) -> tuple[DataFrame, Broadcast]:
    import pyarrow as pa

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(items)
    fields = [T.StructField(n, docs.schema[n].dataType) for n in names]
    schema = T.StructType(fields + T.StructType.fromDDL(RESULT).fields)
    span = pa.struct([(n, pa.int64()) for n in ("word_from", "word_to", "byte_from", "byte_to")])

    def flush(shard, held):
        spans, found = shard.results()
        at = 0
        for columns in held:
            n = len(columns[0]) if columns else 0
            own = slice(at, at + n)
            at += n
            made = [pa.array(shard.n_words[own], pa.int64()), pa.array([[dict(zip(span.names, s, strict=True)) for s in x] for x in spans[own]], pa.list_(span)), pa.array(found[own], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=schema.names)

    def run(batches):
        common.claim("decontaminate")
        phrases = Phrases(shared.value, window)
        shard, held = Shard(phrases), []
        for batch in batches:
            for a, b in common.slices_by_bytes(batch.column(len(names)), 1 << 20):
                data, offsets = common.string_bytes(batch.column(len(names)).slice(a, b - a))
                for i in range(b - a):
                    shard.add(data[offsets[i] : offsets[i + 1]])
                held.append([batch.column(i).slice(a, b - a) for i in range(len(names))])
                if shard.size >= SHARD_BYTES:
                    yield from flush(shard, held)
                    shard, held = Shard(phrases), []
        yield from flush(shard, held)

    return docs.select(*[docs[n] for n in names], docs[text_col].alias("__text")).mapInArrow(run, schema), shared


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str):
    """The items in blocks of at most BLOCK_BYTES of text (a longer item alone), read one after the other."""
    rows = benchmark.select(benchmark[item_col].cast("long"), benchmark[text_col])
    block, size = [], 0
    for item_id, text in rows.toLocalIterator():
        n = len((text or "").encode())
        if block and size + n > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += n
    yield block


def find_phrases(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, n_words, spans (of words and UTF-8 bytes) and items for every row of docs."""
    names = list(dict.fromkeys([id_col, *keep]))
    blocks = blocks_of(benchmark, item_col, item_text_col)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return _search(docs, block, names, text_col, window)[0]
    row = "__row"
    path = common.shared_dir(docs.sparkSession)
    # Stored, so that every block meets the same numbers whatever the rows' source does when it is read again.
    numbered = docs.select(*[docs[n] for n in dict.fromkeys([*names, text_col])]).withColumn(row, F.monotonically_increasing_id())
    numbered = common.stored(numbered, f"{path}/numbered")
    out, k = None, 0
    while block is not None:  # the driver and the broadcast hold one block at a time
        found, shared = _search(numbered, block, [row] if k else [*names, row], text_col, window)
        found = common.stored(found, f"{path}/found-{k}")
        shared.destroy()
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
        block, following, k = following, next(blocks, None) if following is not None else None, k + 1
    merged = out.groupBy(row).agg(
        *[F.first(n, ignorenulls=True).alias(n) for n in names],
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    # Sorted spans: each starts a new one unless it begins within what the last one covers.
    joined = F.aggregate(
        "spans",
        F.array().cast(f"array<{SPAN}>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["word_to"] >= x["word_from"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["word_from"].alias("word_from"),
                        F.greatest(F.element_at(done, -1)["word_to"], x["word_to"]).alias("word_to"),
                        F.element_at(done, -1)["byte_from"].alias("byte_from"),
                        F.greatest(F.element_at(done, -1)["byte_to"], x["byte_to"]).alias("byte_to"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return merged.select(*names, "n_words", joined.alias("spans"), "items")


def n_hit():
    """Words that the merged spans cover."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["word_to"] - s["word_from"])


def is_contaminated():
    return (n_hit() > 0) & (ONE_IN * n_hit() >= F.col("n_words"))


def items_digest():
    """SHA-256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256)


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given UTF-8 byte ranges, which are sorted and apart."""
    data, at, out = (text or "").encode(), 0, []
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]).decode()


def brute_force(docs: list[tuple[int, str]], items: list[tuple[int, str]], window: int = WINDOW) -> dict[int, tuple]:
    """doc_id: (n_words, n_hit, n_items, items_sha256, contaminated), by comparing word lists; for tests."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    phrases: dict[tuple, set] = {}
    for item_id, text in items:
        w = split(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            phrases.setdefault(tuple(w[i : i + n]), set()).update(() if item_id is None else (item_id,))
    out = {}
    for doc_id, text in docs:
        w, hit, seen = split(text), set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in phrases:
                    hit.update(range(i, i + n))
                    seen |= phrases[p]
        digest = hashlib.sha256(",".join(sorted(map(str, seen))).encode()).hexdigest()
        out[doc_id] = len(w), len(hit), len(seen), digest, bool(hit) and ONE_IN * len(hit) >= len(w)
    return out
