import itertools
import random
import re

import numpy as np
import pytest

from lithoscope.llm import near_dedup as nd


def sets_of(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, percent=80):
    sets = {i: sets_of(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def corpus(words, seed=3):
    rng = random.Random(seed)
    make = lambda n: [rng.choice(words) for _ in range(n)]
    rows, base = [], make(120)
    for k in range(40):  # a chain: each differs from the one before in a few words
        if k:
            base = [rng.choice(words) if rng.random() < 0.012 else w for w in base]
        rows.append((100 + k, " ".join(base)))
    star = make(150)
    rows += [(200 + k, " ".join(rng.choice(words) if rng.random() < 0.03 else w for w in star)) for k in range(40)]
    shared = make(40)
    rows += [(300 + k, " ".join(shared + make(45))) for k in range(30)]
    rows += [(400 + k, " ".join(make(rng.randint(1, 60)))) for k in range(40)]
    rows += [(1, "One two THREE"), (2, "one TWO three"), (3, None), (4, ""), (5, " \t\n"), (6, "one two three four"), (7, "x"), (8, "É a b c"), (9, "é a b c")]
    rows += [(500 + k, rows[0][1].upper() if k % 2 else rows[0][1]) for k in range(70)]
    rows.append((600, " ".join(make(60_000))))
    rows.append((601, rows[-1][1] + " tail"))
    return rows


@pytest.mark.parametrize("block", [1 << 18, 700])
def test_against_brute_force(docs, words, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", block)
    rows = corpus(words)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_dedup(docs(rows), shingle=4).collect()}
    assert got == brute(rows, 4)


def test_repeated_and_missing_ids_and_no_rows(docs, words):
    text = " ".join(words[:50])
    out = nd.near_dedup(docs([(3, text), (3, text), (2, text + " end"), (None, text), (9, "a b c"), (9, text)])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out if r.doc_id) == [(2, 2, True), (3, 2, False), (3, 2, False), (9, 2, False), (9, 2, False)]
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, True)]
    assert nd.near_dedup(docs([])).count() == 0
    one, two = " ".join(words[100:150]), " ".join(words[200:250])
    out = nd.near_dedup(docs([(5, one), (5, two), (7, one + " x"), (8, two + " y"), (9, "z")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(5, 5), (5, 5), (7, 5), (8, 5), (9, 9)]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.8, 0.9, 0.95):
        errors = []
        for _ in range(20):
            n = 600
            same = rng.integers(0, 2**63, int(2 * n * share / (1 + share)), dtype=np.uint64)
            own = [np.concatenate([same, rng.integers(0, 2**63, n - len(same), dtype=np.uint64)]) for _ in range(2)]
            a, b = nd.odd_sketches(np.stack([nd.minhash(x) for x in own])).view(np.uint64)
            bits = int(np.bitwise_count(a ^ b).sum())
            assert share < 0.8 or bits <= nd.MOST_BITS
            errors.append(nd.estimated_similarity(bits) - share)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.05


def test_components_of_a_long_path(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r.doc_id: r.root for r in nd.components(edges, f"file://{tmp_path}/c").collect()}
    assert {got[i] for i in range(201)} == {0} and got[1001] == 1000
    parents = spark.createDataFrame([(i + 1, i) for i in range(100)], "doc_id long, parent long")
    assert {r.root for r in nd.roots(parents, f"file://{tmp_path}/r").collect()} == {0}


def test_components_of_random_graphs(spark, tmp_path):
    rng = random.Random(4)
    edges = [(rng.randrange(600), rng.randrange(600)) for _ in range(450)] + [(7, 7)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = nd.components(spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}/g").collect()
    assert {r.doc_id: r.root for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)


def test_groups_are_compared_by_bucket_where_that_is_less_and_only_joining_links_come_out(docs, words, monkeypatch, tmp_path):
    rng = random.Random(8)
    group = [rng.choice(words) for _ in range(60)]
    rows = [(k, " ".join(rng.choice(words) if rng.random() < 0.05 else w for w in group)) for k in range(120)]
    want = brute(rows, 4)
    links = {}
    for least, block in ((1, 1 << 18), (1, 300), (16, 1 << 18)):
        monkeypatch.setattr(nd, "LEAST_BLOCKS", least)
        monkeypatch.setattr(nd, "BLOCK_SHINGLES", block)
        across = nd._across
        monkeypatch.setattr(nd, "_across", lambda *a, key=(least, block), f=across: links.setdefault(key, f(*a)))
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_dedup(docs(rows), shingle=4).collect()}
        monkeypatch.setattr(nd, "_across", across)
        assert got == want
    whole = links[(1, 1 << 18)]
    assert whole is None or whole.count() < len(rows)
