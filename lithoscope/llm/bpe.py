"""Byte-pair encoding by a priority queue over a doubly linked list of symbols, and decoding.

A word's symbols form a doubly linked list; a heap holds the merges that are possible, by rank and then
position.  Taking the least entry, one that no longer describes two adjacent symbols is skipped, otherwise
the two are joined and the merges with the new neighbours are pushed.  Decoding joins the vocabulary's
strings of the ids by blanks, as a tokenizer file without a decoder asks.

Defined results: null and empty texts have no ids and decode to the empty string; special tokens' strings
inside a text become their ids; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: Distinct pieces and words that a worker keeps; beyond it, it starts afresh.
CACHED = 200_000
#: Characters of a text from which its pieces, which may be as long, are not kept.
LONG = 1 << 20

OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def byte_letters() -> list[str]:
    """A visible letter for every byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + rest.index(b)) for b in range(256)]


class WordBpe:
    """A tokenizer file of lower-case words with word ends: NFC, lower case, white space dropped, then byte pairs."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.final = [self.vocab[c + self.end] for c in letters]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.blank = regex.compile(r"\p{White_Space}+")
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.word_ids: dict[str, list[int]] = {}
        self.piece_text: dict[str, str] = {}
        self.piece_ids = _Pieces(self)

    def encode_word(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        data = word.encode()
        last = len(data) - 1
        symbol = [self.inner[b] for b in data]
        symbol[last] = self.final[data[last]]
        after, before = list(range(1, last + 2)), list(range(-1, last))
        after[last] = -1
        merges = self.merges
        heap = []
        for i in range(last):
            found = merges.get((symbol[i], symbol[i + 1]))
            if found:
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        while heap:
            rank, i, joined = heapq.heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j < 0:
                continue
            found = merges.get((symbol[i], symbol[j]))
            if not found or found[0] != rank:
                continue  # stale: one of the two symbols has changed since
            symbol[i], symbol[j] = joined, -1
            nxt = after[i] = after[j]
            if nxt >= 0:
                before[nxt] = i
                found = merges.get((joined, symbol[nxt]))
                if found:
                    heapq.heappush(heap, (found[0], i, found[1]))
            prv = before[i]
            if prv >= 0:
                found = merges.get((symbol[prv], joined))
                if found:
                    heapq.heappush(heap, (found[0], prv, found[1]))
        return [s for s in symbol if s >= 0]

    def encode_plain(self, text: str) -> list[int]:
        """The ids of a text without special tokens."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        ids: list[int] = []
        for w in self.words(text.replace("Σ", "σ").lower()):  # letter by letter, so no final sigma
            found = self.word_ids.get(w)
            if found is None:
                found = self.encode_word(w)
                if len(w) < 64:
                    self.word_ids[w] = found
            ids += found
        return ids

    def runs(self, text: str):
        """Special ids, and the pieces between white space of the texts between them."""
        at = 0
        for m in self.specials.finditer(text) if self.specials and "<|" in text else ():
            yield from self.blank.split(text[at : m.start()])
            yield self.special[m[0]]
            at = m.end()
        yield from self.blank.split(text[at:])

    def strings_of(self, text: str) -> tuple[str, str]:
        """The decimal ids and the decoded text, each joined by blanks."""
        if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            ids, out = [], []
            for p in self.runs(text):
                if isinstance(p, int):
                    ids.append(str(p))
                    out.append(self.strings[p])
                elif p:
                    ids.append(self.piece_ids[p])
                    out.append(self.piece_text[p])
        else:
            pieces = text.split()
            ids = list(map(self.piece_ids.__getitem__, pieces))
            out = list(map(self.piece_text.__getitem__, pieces))
        result = " ".join(ids), " ".join(out)
        if len(self.piece_ids) > CACHED or len(text) > LONG:
            self.piece_ids.clear()
            self.piece_text.clear()
        if len(self.word_ids) > CACHED:
            self.word_ids.clear()
        return result

    def forget(self) -> None:
        """Empty all caches."""
        self.piece_ids.clear()
        self.piece_text.clear()
        self.word_ids.clear()

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.strings_of(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids)


class _Pieces(dict):
    """Decimal ids of pieces; a missing one is encoded, and its decoded text kept beside."""

    def __init__(self, codec: WordBpe):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> str:
        ids = self.codec.encode_plain(piece)
        self.codec.piece_text[piece] = " ".join(map(self.codec.strings.__getitem__, ids))
        self[piece] = out = " ".join(map(str, ids))
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> WordBpe:
    return WordBpe(path)


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded"), keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep`` and the chosen ``outputs`` (see OUTPUTS) for every row of docs."""
    import pyarrow as pa

    names = list(dict.fromkeys([id_col, *keep]))
    fields = [T.StructField(n, docs.schema[n].dataType) for n in names]
    schema = T.StructType(fields + [T.StructField(o, OUTPUTS[o]) for o in outputs])

    def run(batches):
        own = codec(path)
        common.claim("bpe", own.forget)
        for batch in batches:
            texts = batch.column(len(names))
            for start in range(0, batch.num_rows, 512):
                made: dict[str, list] = {o: [] for o in outputs}
                for text in texts.slice(start, 512).to_pylist():
                    ids, decoded = own.strings_of(text or "")
                    if "ids" in made:
                        made["ids"].append(np.fromstring(ids, np.int32, sep=" "))
                    if "decoded" in made:
                        made["decoded"].append(decoded)
                    if "n_tokens" in made:
                        made["n_tokens"].append(ids.count(" ") + 1 if ids else 0)
                    if "ids_sha256" in made:
                        made["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                    if "decoded_sha256" in made:
                        made["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if "ids" in made:
                    ends = np.cumsum([0, *map(len, made["ids"])])
                    made["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(made["ids"]), pa.int32()))
                types = {"n_tokens": pa.int64()}
                part = batch.slice(start, 512)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(names))]
                    + [made[o] if o == "ids" else pa.array(made[o], types.get(o, pa.string())) for o in outputs],
                    names=[f.name for f in schema],
                )

    return docs.select(*[docs[n] for n in names], docs[text_col].alias("__text")).mapInArrow(run, schema)
