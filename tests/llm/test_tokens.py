import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lithoscope.llm import sstable
from lithoscope.llm.bpe import WordBpe, bpe_round_trip
from lithoscope.llm.token_counts import token_counts

WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
TEXTS = [None, "", "  ", "Hello, World!", "DON'T x'll 12345", "<|endoftext|>a b<|startoftext|> <|endoftext|>", "ΑΣ ΣΑΣ Σ. İstanbul", "a\x1cb \x85 c d", "é ﬁ ² ⅷ 日本語 é́́", "﻿x​ y\x00q"]
TEXTS += ["a" * 3000 + " " + "é" * 1000, "  \n x", "a\n\n", "\n\n\nA  b   c", "🙂🙃 <|endoftext|", "word,word; ###!!! (x)", " ".join(f"w{i}" for i in range(40_000)), "Hello, World!"]
ROWS = list(enumerate(TEXTS))


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


def test_bpe_equals_the_library(docs, word):
    got = {r.doc_id: r for r in bpe_round_trip(docs(ROWS), WORD, outputs=("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).collect()}
    for i, t in ROWS:
        ids = word.encode(t or "", add_special_tokens=False).ids
        decoded = word.decode(ids, skip_special_tokens=False)
        shown = " ".join(map(str, ids))
        assert (list(got[i].ids), got[i].decoded, got[i].n_tokens) == (ids, decoded, len(ids))
        assert got[i].ids_sha256 == hashlib.sha256(shown.encode()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe_round_trip(docs([]), WORD).count() == 0


def test_stale_merges_are_skipped(word):
    codec = WordBpe(WORD)
    for w in ("aaaaaaa", "banana", "thththth", "mississippi", "ininin"):
        assert codec.encode(w) == word.encode(w, add_special_tokens=False).ids
    assert codec.decode(codec.encode("the cat")) == word.decode(codec.encode("the cat"), skip_special_tokens=False)


@pytest.mark.parametrize("path, drops", [(WORD, True), (BYTE, False)])
def test_counts(docs, path, drops):
    tok = Tokenizer.from_file(path)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(docs(ROWS), path, drops_spaces=drops).collect()}
    assert got == {i: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS}
    assert token_counts(docs([]), path).count() == 0


def test_shards(spark, docs, tmp_path):
    tok, at = Tokenizer.from_file(BYTE), 0
    rows = [(7 * i - 50, t) for i, t in ROWS]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in sstable.token_shards(docs(rows), BYTE, 50_257, 2, f"file://{tmp_path}/s").collect()}
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    found = {r.doc_id: list(r.ids) for r in sstable.lookup(spark, f"file://{tmp_path}/s/shards", [-29, 13, 999]).collect()}
    assert found == {d: [*tok.encode(dict(rows)[d], add_special_tokens=False).ids, 2] for d in (-29, 13) if d in dict(rows)}


def test_shards_of_repeated_missing_and_no_ids(docs):
    rows = [(3, "b"), (3, "a"), (None, "c"), (-1, ""), (None, None)]
    got = sorted((r.start, r.doc_id is None, r.doc_id or 0) for r in sstable.token_shards(docs(rows), BYTE, 50_257, 2).collect())
    assert [(g[1], g[2]) for g in got] == [(False, -1), (False, 3), (False, 3), (True, 0), (True, 0)]
    assert sstable.token_shards(docs([]), BYTE, 50_257, 2).count() == 0


def test_blocks_and_filter():
    w = sstable.ShardWriter(4, 9)
    for i in range(0, 5000, 2):
        w.add(sstable.key_of(i - 1000), np.arange(i, i + 40, dtype="<u4").tobytes())
    shard = sstable.Shard(w.finish() + sstable.MAGIC[-1:])
    assert len(shard.places) > 1 and shard.place == 9 and shard.entries == 2500
    assert [x.tolist() for x in shard.lookup(500)] == [list(range(1500, 1540))] and shard.lookup(501) == []
    assert sum(shard.may_hold(sstable.key_of(i)) for i in range(-999, 4000, 2)) < 100
    assert [sstable.id_of(sstable.key_of(x)) for x in (-(2**63), -1, 0, 2**63 - 1, None)] == [-(2**63), -1, 0, 2**63 - 1, None]
    with pytest.raises(ValueError):
        sstable.Shard(b"something else")


def test_null_ids_repeated_rows_and_odd_columns(docs):
    """Every row gets its own result, whatever its identifier and whatever other columns are called."""
    rows = [(1, "Hello, World!"), (1, "Hello, World!"), (None, "a b"), (None, None), (None, "a b")]
    count = {t: len(Tokenizer.from_file(WORD).encode(t or "", add_special_tokens=False).ids) for _, t in rows}
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((i, count[t]) for i, t in rows), key=key)
    odd = docs(rows).selectExpr("*", "1.5 as n_tokens", "'x' as n_bytes", "'y' as ids_sha256")
    assert sorted(((r.doc_id, r.n_tokens) for r in bpe_round_trip(odd, WORD, outputs=("n_tokens", "ids_sha256")).collect()), key=key) == want
    assert sorted(((r.doc_id, r.n_tokens) for r in token_counts(odd, WORD).collect()), key=key) == want


def test_long_runs_without_white_space(docs, monkeypatch):
    from lithoscope.llm import tokenizing

    monkeypatch.setattr(tokenizing, "LONG", 40)
    runs = ["one,two;three!four?five)six" * 30, "日本語。中文，テスト！" * 40, "ΑΣ,ΣΑΣ;Σ.ΣΣ:Σ'S" * 20, "don't,can't!x2,y3" * 30, "é́,é;²,ⅷ!" * 30, "x,<|endoftext|>y,<|startoftext|>!" * 10, "a" * 500]
    for path, drops in ((WORD, True), (BYTE, False)):
        tok = Tokenizer.from_file(path)
        for run in runs:
            parts = tokenizing.split_long([run])
            assert "".join(parts) == run and (len(parts) > 5 or run == "a" * 500)
            assert sum(len(tok.encode(p, add_special_tokens=False).ids) for p in parts) == len(tok.encode(run, add_special_tokens=False).ids), run[:20]


def test_shards_without_any_id(docs):
    rows = [(None, f"text {i % 40}") for i in range(300)]
    got = sstable.token_shards(docs(rows), BYTE, 50_257, 2).collect()
    ends, at = sorted((r.start, r.start + r.n_tokens) for r in got), 0
    assert len(got) == 300 and all(r.doc_id is None for r in got)
    for a, b in ends:  # the documents lie one after the other
        assert a == at
        at = b
