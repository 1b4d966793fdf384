import random

from lithoscope.llm import suffix_dedup as sd


def test_against_brute_force(docs, words):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage, line = text(200), text(90), text(8) + "\n"
    texts = [base, base, base[:700] + "X" + base[701:], text(30) + passage + text(40), passage, text(20) + passage[:401], text(5) + passage[50:451]]
    texts += [line * 40 + text(30), text(10) + line * 30, "a" * 3000, "b" * 900 + text(100), None, "", passage[:400], passage[1:401], base[:399], "é" * 500]
    texts += [base[:k] + " zz " + base[k:] for k in range(0, 1000, 37)]
    long = text(180_000)  # several blocks, with repeats across and within them
    texts += [long[:600_000] + base + long[600_000:1_150_000] + long[20_000:21_000], long[523_900:524_900] + text(20)]
    want = sd.brute_force(texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.suffix_dedup(docs(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_repeated_and_missing_ids_hot_groups_and_no_rows(docs, words):
    body, other = " ".join(words[:100]), " ".join(words[500:600])
    rows = [(1, body), (1, other), (1, "short"), (None, body), (None, None)]
    got = sorted((r.doc_id is None, r.n_bytes, r.n_removed) for r in sd.suffix_dedup(docs(rows)).collect())
    n = len(body)
    assert got == sorted([(False, n, n), (False, len(other), 0), (False, 5, 0), (True, n, n), (True, 0, 0)])
    rows = [(i, body) for i in range(200)] + [(500, "x " + body + " y"), (501, other)]
    got = {r.doc_id: r.n_removed for r in sd.suffix_dedup(docs(rows)).collect()}
    assert all(got[i] == n for i in range(200)) and got[500] == n and got[501] == 0
    assert sd.suffix_dedup(docs([])).count() == 0


def test_spans_lie_in_the_text(docs, words):
    body = " ".join(words[:100])
    r = next(r for r in sd.suffix_dedup(docs([(1, "begin " + body), (2, body + " end")])).collect() if r.doc_id == 1)
    assert [(s["from"], s["to"]) for s in r.spans] == [(6, 6 + len(body))]
