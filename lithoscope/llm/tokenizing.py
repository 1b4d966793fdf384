"""Pieces of texts that a tokenizer treats alone, so each distinct one is encoded once per worker."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from . import common

#: A cut before white space that follows other characters: no pre-token spans it and no pattern looks back over it.
_PIECES = re.compile(r"\s*\S+|\s+")
#: Characters that Python counts as white space and Unicode's White_Space property does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def split_before_spaces(text: str) -> list[str]:
    """Pieces that joined give the text, each optional white space and then other characters."""
    return [text] if _SEPARATORS.search(text) else _PIECES.findall(text)


def split_at_spaces(text: str) -> list[str]:
    """The pieces between white space, for tokenizers that drop white space."""
    return [text] if _SEPARATORS.search(text) else text.split()


#: Characters of a piece beyond which it is cut again, between a letter and marks that no pre-token shares with letters.
LONG = 1 << 12
_WITHIN = re.compile(r"(?<=[^\W\d_])(?=[,;!?)。，！？；、])")


def split_long(pieces: list[str]) -> list[str]:
    """The pieces, long ones without white space in several; where no boundary is safe a piece stays whole."""
    if max(map(len, pieces), default=0) <= LONG:
        return pieces
    return [part for p in pieces for part in (_WITHIN.split(p) if len(p) > LONG and not _SEPARATORS.search(p) else [p])]


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer of a file, once per process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_pieces(path: str, pieces: list[str], most: int = 1 << 18):
    """The library's encodings of the pieces, in batches of about ``most`` bytes."""
    tok = tokenizer(path)
    batch, size = [], 0
    for p in pieces:
        n = len(p) if p.isascii() else len(p.encode())
        if batch and size + n > most:
            yield from tok.encode_batch_fast(batch, add_special_tokens=False)
            batch, size = [], 0
        batch.append(p)
        size += n
    if batch:
        yield from tok.encode_batch_fast(batch, add_special_tokens=False)


#: Other white space than ASCII's: texts that have any are encoded whole.
_ODD_SPACE = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_IS_SPACE = common.byte_class([(0x20, 0x20), (0x09, 0x0D)])


def byte_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 texts: starts, lengths and 64-bit codes of the pieces that split_before_spaces gives, one text after the other."""
    space = _IS_SPACE[data]
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    lengths = np.diff(np.r_[starts, len(data)])
    if not len(starts):
        return starts, lengths, np.zeros(0, np.uint64)
    values = common.BYTE_CODES[data]
    values *= common.powers(int(lengths.max()))[np.arange(len(data)) - np.repeat(starts, lengths)]
    return starts, lengths, common.mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64))


class PackedIds:
    """Ids of texts as packed little-endian integers; each distinct piece is encoded by the library once.

    Pieces are told apart by 64-bit codes of their bytes, which are looked up in a sorted table for a whole slice of
    texts at once.  Two pieces share a code with a chance of 2^-64; beside a full table that is one new piece in 1e13.
    New pieces are joined and encoded together: no pre-token spans two of them, and the lengths of the
    vocabulary's strings tell where each one's ids end.
    """

    #: Pieces of the table (about 40 bytes each), and bytes that are encoded together.
    CACHED, JOINED = 1_200_000, 1 << 16

    def __init__(self, path: str, width: int, special: str):
        self.tok, self.width, self.special = tokenizer(path), width, special
        size = self.tok.get_vocab_size()
        self.lengths = np.array([len(self.tok.id_to_token(i) or "") for i in range(size)], np.int64)  # a letter stands for a byte
        self.clear()

    def clear(self) -> None:
        """Forget all pieces."""
        self.codes, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, f"<u{self.width}")

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.ids.dtype).tobytes()

    def learned(self, data: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Packed ids of pieces of white space and then others, one after the other, and how many each piece has."""
        packed, counts, ends = [], [], np.cumsum(lengths)
        at = 0
        while at < len(starts):
            base = int(ends[at] - lengths[at])
            to = max(at + 1, int(np.searchsorted(ends, base + self.JOINED)))
            text = b"".join([data[a : a + n] for a, n in zip(starts[at:to].tolist(), lengths[at:to].tolist(), strict=True)]).decode()
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends[at:to] - base) + 1
            counts.append(np.diff(cuts, prepend=0))
            packed.append(ids.astype(self.ids.dtype).tobytes())
            at = to
        return b"".join(packed), np.concatenate(counts) if counts else np.zeros(0, np.int64)

    def add(self, codes: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Put pieces that the table does not have into it, under their codes."""
        raw = data.tobytes()
        # Only pieces of white space and then others can follow one another as they do in a text.
        alone = ~_IS_SPACE[data[starts]] | _IS_SPACE[data[starts + lengths - 1]]
        packed, n = self.learned(raw, starts[~alone], lengths[~alone])
        single = [self.whole(raw[a : a + k].decode()) for a, k in zip(starts[alone].tolist(), lengths[alone].tolist(), strict=True)]
        n = np.concatenate([n, np.array([len(x) // self.width for x in single], np.int64)])
        at = len(self.ids) + np.cumsum(n) - n
        self.ids = np.concatenate([self.ids, np.frombuffer(packed + b"".join(single), self.ids.dtype)])
        both = np.concatenate([self.codes, codes[~alone], codes[alone]])
        order = np.argsort(both, kind="stable")
        self.codes, self.at, self.n = both[order], np.concatenate([self.at, at])[order], np.concatenate([self.n, n])[order]

    def encode(self, texts: list[str]) -> list[bytes]:
        import pyarrow as pa

        return self.encode_column(pa.array(texts, pa.string()))

    def encode_column(self, column) -> list[bytes]:
        """The packed ids of every text of a string column (null: empty)."""
        import pyarrow.compute as pc

        if len(self.codes) > self.CACHED:
            self.clear()
        column = pc.fill_null(column, "")
        odd = pc.or_(pc.match_substring(column, self.special), pc.match_substring_regex(column, _ODD_SPACE)).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(column)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.whole(column[i].as_py())
        even = np.flatnonzero(~odd)
        data, offsets = common.string_bytes(column.take(even) if odd.any() else column)
        starts, lengths, codes = byte_pieces(data, offsets)
        if not len(codes):
            return out
        distinct, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
        where = np.searchsorted(self.codes, distinct)
        missing = np.flatnonzero(self.codes[np.minimum(where, len(self.codes) - 1)] != distinct) if len(self.codes) else np.arange(len(distinct))
        if len(missing):
            self.add(distinct[missing], data, starts[first[missing]], lengths[first[missing]])
            where = np.searchsorted(self.codes, distinct)
        where = where[inverse]
        n = self.n[where]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[where] - (ends - n), n) + np.arange(int(ends[-1]))].tobytes()
        until = np.r_[0, ends][np.searchsorted(starts, offsets)] * self.width  # where each text's ids begin
        for i, a, b in zip(even.tolist(), until[:-1].tolist(), until[1:].tolist(), strict=True):
            out[i] = ids[a:b]
        return out


@lru_cache(maxsize=2)
def packed_ids(path: str, width: int, special: str) -> PackedIds:
    return PackedIds(path, width, special)
