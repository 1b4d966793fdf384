import random

import numpy as np
import pytest

from lithoscope.llm import decontaminate as dc
from lithoscope.llm.fm_index import FmIndex


def results(df):
    cols = ("n_words", dc.n_hit().alias("n_hit"), dc.F.size("items").alias("n_items"), dc.items_digest().alias("d"), dc.is_contaminated().alias("c"))
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *cols).collect()}


def corpus(words):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(words[:300]) for _ in range(n))
    items = [(i, text(rng.randint(14, 40))) for i in range(30)] + [(40, "Alpha, BETA"), (41, None), (42, " -- "), (43, "é2x"), (44, text(12)), (10, text(20)), (45, text(20))]
    items.append((46, items[-1][1]))
    docs = [(i, text(rng.randint(1, 200))) for i in range(60)] + [(100, None), (101, ""), (102, "..."), (103, "alpha beta gamma"), (104, "ALPHA;beta " * 30), (105, "É2X é2x"), (106, text(50_000) + " " + items[3][1])]
    docs += [(200 + k, f"{text(100)} {items[k][1].upper()} {text(20)}") for k in range(30)]
    docs += [(300 + k, " ".join(items[k][1].split()[:13])) for k in range(5)] + [(400, items[0][1].replace(" ", "\n--\n")), (401, " ".join(items[1][1].split()[:12]))]
    return docs, items


@pytest.mark.parametrize("block", [8 << 20, 700])
def test_against_brute_force(spark, docs, words, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    rows, items = corpus(words)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert results(dc.find_phrases(docs(rows), benchmark)) == dc.brute_force(rows, items)


def test_repeated_rows_spans_and_empty_tables(spark, docs, words):
    item = " ".join(words[:20])
    benchmark = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    rows = [(1, f"pré {item}, post"), (1, f"pré {item}, post"), (None, item)]
    got = dc.find_phrases(docs(rows), benchmark, keep=("doc_id", "text", "digest")).collect()
    assert len(got) == 3 and all(r.items == [1] for r in got)
    r = next(r for r in got if r.doc_id == 1)
    assert dc.remove_spans(r.text, [(s.byte_from, s.byte_to) for s in r.spans]) == "pré , post"
    assert dc.find_phrases(docs([]), benchmark).count() == 0
    clean = dc.find_phrases(docs(rows), benchmark.limit(0)).collect()
    assert all(r.spans == [] and r.items == [] for r in clean)


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 6, 4000)
    text[1000:1500] = text[:500]
    text[-1] = 0
    index = FmIndex(text, 6)
    for n in (1, 2, 5, 9):
        pattern = text[rng.integers(0, 3000) :][:n]
        if (pattern == 0).any():
            continue
        low, high = index.search(pattern[None, :].copy(), np.array([n]))
        got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert got == [i for i in range(len(text) - n + 1) if (text[i : i + n] == pattern).all()]


@pytest.mark.parametrize("block", [8 << 20, 100])
def test_items_without_an_id_mark_words(spark, docs, words, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    first, second = " ".join(words[:20]), " ".join(words[30:50])
    items = [(None, first), (1, second), (None, second), (None, None), (2, "short one")]
    rows = [(1, f"x {first} y"), (2, f"x {second} y"), (3, "x y"), (4, f"{first} short one {second}")]
    got = results(dc.find_phrases(docs(rows), spark.createDataFrame(items, "item_id long, text string")))
    assert got == dc.brute_force(rows, items)
    assert {i: (n_hit, n_items, hit) for i, (_, n_hit, n_items, _, hit) in got.items()} == {1: (20, 0, True), 2: (20, 1, True), 3: (0, 0, False), 4: (42, 2, True)}
