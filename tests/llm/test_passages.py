import random

import numpy as np

from lithoscope.llm import buckets, passages
from lithoscope.llm.suffix_dedup import suffix_dedup


def test_against_brute_force(docs, words):
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, other, short = text(60), text(51), text(50)
    texts = [text(30) + " " + passage + " " + text(40), passage, passage.upper() + "\n" + text(9), text(5) + " " + passage[:-1]]
    texts += [other, text(100) + "\t" + other, other + " " + text(3) + " " + passage, short, short + " x", text(200), None, "", " \n", "one"]
    texts += [f"{text(k)} {other} {text(70 - k)}" for k in range(0, 70, 7)] + [text(20) + " " + other] * 6
    line = text(55)
    texts += [f"{line} {line} {line}", "ab " * 200, "ab " * 80 + text(10), text(3000) + " " + other + " " + text(100_000)]
    base = text(300).split()
    texts += [" ".join(base[:k] + ["new"] + base[k + 1 :]) for k in range(0, 300, 40)]
    want = passages.brute_force(texts)
    got = {r.doc_id: (r.n_passages, r.n_passage_words) for r in suffix_dedup(docs(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert want[0] == (1, 60) and want[7] == (0, 0) and want[9] == (0, 0) and want[14 + 16][0] == 0


def test_repeated_ids_and_no_shared_passage(docs, words):
    text = " ".join(words[:60])
    out = suffix_dedup(docs([(1, text), (1, text + " end"), (None, "x"), (2, "y")])).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_passages, r.n_passage_words) for r in out if r.doc_id) == [(False, 1, 1, 60), (False, 1, 1, 60), (False, 2, 0, 0)]


def test_least_in_reach_by_blocks(monkeypatch):
    ids = np.random.default_rng(2).integers(0, 2**64, 5000, dtype=np.uint64)
    whole = buckets.least_in_reach(ids, 37)
    assert all(ids[p] >> np.uint64(24) == (ids[i : i + 37] >> np.uint64(24)).min() for i, p in enumerate(whole))
    monkeypatch.setattr(buckets, "_TOGETHER", 600)
    assert (buckets.least_in_reach(ids, 37) == whole).all()
