import hashlib
import random
import zlib

import numpy as np

from lithoscope.llm import quality as q


def corpus(words, n=900):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        body = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        text = " ".join(body) + "." if good else " ".join(f"{w}{rng.choice(['###', '$$$', '!!'])}" for w in body).upper()
        rows.append((i, text))
        if rng.random() < 0.5:
            labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark, docs, words):
    rows, labels = corpus(words)
    truth = {i: good for i, good, _ in labels}
    rows += [(5000, None), (5001, ""), (None, "no id"), (5002, "x" * 100_000), (7, rows[7][1])]
    out = q.classify_quality(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_held_out_labels_do_not_matter(spark, docs, words):
    rows, labels = corpus(words, 200)
    flipped = [(i, 1 - g if zlib.crc32(str(i).encode()) % 4 == 2 else g, t) for i, g, t in labels]
    scores = [{r.doc_id: r.score for r in q.classify_quality(docs(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, flipped)]
    assert all(abs(scores[0][i] - scores[1][i]) < 1e-9 for i in scores[0])


def test_no_labels_and_no_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in q.classify_quality(docs([(1, "a")]), none).collect()] == [0.5]
    assert q.classify_quality(docs([]), none).count() == 0


def test_risk_stays_bounded():
    """With the non-negative correction, clean positives and mixed unlabelled rows separate although no negative is known."""
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (2000, 5)), rng.normal(-1, 1, (2000, 5))
    model = q.fit(good[:800], np.concatenate([good[800:1600], bad[:400]]), prior=2 / 3)
    assert (model.margin(good[1600:]) > 0).mean() > 0.93 and (model.margin(bad[400:]) < 0).mean() > 0.85


def test_every_document_counts_as_unlabelled(spark, docs, words, monkeypatch):
    """Statistics and risk are over all documents that are not held out, however few labelled rows are sampled."""
    monkeypatch.setattr(q, "SAMPLE_ROWS", 150)
    monkeypatch.setattr(q, "SHARD_ROWS", 100, raising=False)
    rows, labels = corpus(words)
    truth = {i: good for i, good, _ in labels}
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = q.train(docs(rows), marked)
    kept = lambda i: zlib.crc32(str(i).encode()) % 4 != 2
    everything = np.stack([q.features(t) for i, t in rows if kept(i)]).astype(np.float32).astype(float)
    sample = {r.doc_id for r in q._chosen(marked.select("doc_id", q.F.col("quality").alias("label")).where(~q.is_held_out(q.F.col("doc_id"))), 150, "doc_id", "label").collect()}
    positive = np.stack([q.features(t) for i, t in rows if i in sample and truth[i]]).astype(np.float32).astype(float)
    both = np.concatenate([positive, everything])
    assert np.allclose(model.mean, both.mean(0), atol=1e-9) and np.allclose(model.spread[both.std(0) > 1e-3], both.std(0)[both.std(0) > 1e-3], atol=1e-9)
    held = [(i, t) for i, t in rows if not kept(i) and i in truth]
    scores = model.score(np.stack([q.features(t) for _, t in held]))
    assert np.mean([(s >= 0.7) == truth[i] for s, (i, _) in zip(scores, held, strict=True)]) > 0.95


def plain_model(rows, labels, shard_rows):
    """The model made in memory, one shard after another, of rows whose identifiers do not repeat."""
    kept = lambda i: zlib.crc32(str(i).encode()) % 4 != 2
    x = {i: q.features(t).astype(np.float32) for i, t in rows if kept(i)}
    key = {i: int.from_bytes(hashlib.blake2b(str(i).encode() + v.tobytes(), digest_size=8).digest(), "little", signed=True) for i, v in x.items()}
    label = {i: g for i, g, _ in labels if kept(i)}
    shards = -(-len(x) // shard_rows)
    pieces = []
    for s in range(shards):
        own = sorted((i for i in x if key[i] % shards == s), key=key.get)
        pieces += [((s, k // shard_rows), np.stack([x[i] for i in own[k : k + shard_rows]]).astype(float)) for k in range(0, len(own), shard_rows)]
    return x, key, label, pieces


def test_against_a_fit_in_memory(spark, docs, words, monkeypatch):
    """Rounds over shards in tasks give what the same rounds give in memory."""
    monkeypatch.setattr(q, "SHARD_ROWS", 150)
    rows, labels = corpus(words, 500)
    x, _, label, pieces = plain_model(rows, labels, 150)
    model = q.train(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    chosen = []
    calibrate = q.calibrate
    monkeypatch.setattr(q, "calibrate", lambda m, a, b: chosen.append((a, b)) or calibrate(m, a, b))
    q.train(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    features, marks = chosen[0]  # all labelled rows, in the order of their hashes
    assert sorted(map(tuple, features)) == sorted(tuple(x[i].astype(float)) for i in label) and marks.sum() == sum(label.values())
    pos = features[marks == 1]
    both = np.concatenate([pos, *(p for _, p in pieces)])
    mean, spread = both.mean(0), both.std(0)
    spread[spread < 1e-6] = 1.0
    prior, total = float(np.clip(marks.mean(), 0.05, 0.98)), sum(len(p) for _, p in pieces)
    state, step = q._start(q.N_FEATURES, q.SEED), 0.0
    for turn in range(q.ROUNDS):
        after = [(len(p), q._descend(state, step, (np.clip((pos - mean) / spread, -6, 6)), np.clip((p - mean) / spread, -6, 6), prior, np.random.default_rng([q.SEED, turn, *at]), q.EPOCHS // q.ROUNDS)) for at, p in pieces]
        state = tuple([sum(n * s[0][part][k] for n, s in after) / total for k in range(4)] for part in range(3))
        step = sum(n * s[1] for n, s in after) / total
    want = q.Model(mean, spread, state[0])
    q.calibrate(want, features, marks)
    every = np.stack([v.astype(float) for v in x.values()])
    assert np.allclose(model.score(every), want.score(every), atol=1e-6)


def test_same_rows_in_any_layout_give_the_same_model(spark, words, monkeypatch):
    monkeypatch.setattr(q, "SHARD_ROWS", 150)
    rows, labels = corpus(words, 700)
    rows += [(7, rows[7][1])] * 200  # an identifier that repeats beyond a shard
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    scores = []
    for parts, gathered in ((1, 256), (3, 256), (7, 256), (5, 2)):
        monkeypatch.setattr(q, "GATHERED", gathered)
        out = q.classify_quality(whole.repartition(parts), marked.repartition(parts)).collect()
        scores.append({r.doc_id: r.score for r in out})
    assert all(abs(s[i] - scores[0][i]) < 1e-9 for s in scores[1:3] for i in s)
    assert all(abs(scores[3][i] - scores[0][i]) < 1e-6 for i in scores[0])  # groups of sums are added in another order


def test_labelled_sample_is_bounded(spark, words, monkeypatch):
    monkeypatch.setattr(q, "SAMPLE_ROWS", 40)
    rows, labels = corpus(words, 200)
    rows += [(5, rows[5][1] + f" {k}") for k in range(300)]
    taken = []
    calibrate = q.calibrate
    monkeypatch.setattr(q, "calibrate", lambda model, x, y: taken.append(len(x)) or calibrate(model, x, y))
    q.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(5, 1, 0)], "doc_id long, quality int, toxic int"))
    assert taken == [40]
