"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled rows of good quality, unlabelled examples are web documents whatever their
quality.  With the class prior p estimated from the labelled rows, the risk that is minimised is

    p E_pos[loss(f, +1)] + max(0, E_unl[loss(f, -1)] - p E_pos[loss(f, -1)])

by a network of one hidden layer over features of the whole text (shares of character classes, repetition,
line and word shapes).  When a batch's negative part falls below zero, its gradient is taken to raise it
again, so the flexible model cannot drive the risk below zero by overfitting.  A last monotone step (one
scale and shift of the output) is fitted on the labelled training rows.

Fitting uses at most SAMPLE_ROWS labelled rows, chosen by a hash of the identifier, and every document that
is not held out as unlabelled: their features are stored in shards by a hash of identifier and features, tasks
descend on shards, and the states of the shards are averaged ROUNDS times.  All sums are taken in the order of
the shards, so the model depends on the rows alone and not on their layout.  Scoring covers every row and whole
texts.  Defined results: null and empty texts are scored as
texts without characters; without any positive label every score is the prior of 0.5; rows with a null
identifier are scored and never learnt from.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Most labelled rows that the model is fitted on.
SAMPLE_ROWS = 20_000
#: Unlabelled rows of a shard, how often the shards' states are averaged, and most sums that the driver adds up.
SHARD_ROWS, ROUNDS, GATHERED = 20_000, 12, 256
#: Rows whose crc32 of the identifier's text leaves HELD_OUT modulo FOLDS are never learnt from.
FOLDS, HELD_OUT = 4, 2
#: Least score that is predicted as good.
THRESHOLD = 0.7
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 60, 512, 4e-3, 1e-4, 7

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASSES = [range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), range(0x80, 0x100), b" ", b"\n", b"\t\r\x0b\x0c", range(0, 9), *([c] for c in _PUNCTUATION)]
CLASS_OF = np.zeros((256, len(_CLASSES)))
for _k, _members in enumerate(_CLASSES):
    CLASS_OF[list(_members), _k] = 1.0
N_FEATURES = len(_CLASSES) + 11


def features(text: str | None) -> np.ndarray:
    """The features of one whole text."""
    data = (text or "").encode()
    n = len(data)
    if not n:
        return np.zeros(N_FEATURES)
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ CLASS_OF / n
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    distinct = set(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    shapes = [
        1.0,
        np.log1p(n) / 10,
        np.log1p(n_words) / 10,
        len(distinct) / n_words,
        np.log1p(len(distinct)) / np.log1p(n_words),
        len(set(lines)) / n_lines,
        np.log1p(n / n_lines) / 10,
        float(lengths.mean()) / 10,
        float(lengths.std()) / 10,
        float(lengths.max()) / n,
        len(zlib.compress(data, 1)) / n,
    ]
    return np.concatenate([np.sqrt(shares), shapes])


class Model:
    """Standardised features, one hidden layer, and a monotone scale of the output."""

    def __init__(self, mean, spread, layers, scale=(1.0, 0.0)):
        self.mean, self.spread, self.layers, self.scale = mean, spread, layers, scale

    def margin(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.tanh(np.clip((x - self.mean) / self.spread, -6, 6) @ w + b) @ v + c

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale[0] * self.margin(x) + self.scale[1])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _start(width: int, seed: int) -> tuple[list[np.ndarray], ...]:
    """Fresh layers and Adam's two moments of them."""
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    return layers, [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]


def _descend(state: tuple, step: float, pos: np.ndarray, unl: np.ndarray, prior: float, rng, epochs: int) -> tuple[tuple, float]:
    """Minimise the non-negative risk by Adam on mini-batches of standardised rows, from a state; the state and step after."""
    layers, first, second = (list(part) for part in state)
    for _ in range(epochs):
        order = rng.permutation(len(unl))
        for at in range(0, len(unl), BATCH):
            p, u = pos[rng.integers(0, len(pos), BATCH)], unl[order[at : at + BATCH]]
            w, b, v, c = layers
            hp, hu = np.tanh(p @ w + b), np.tanh(u @ w + b)
            fp, fu = _sigmoid(hp @ v + c), _sigmoid(hu @ v + c)
            # Gradients of the mean logistic losses by the outputs: towards +1 and towards -1.
            up, down_p, down_u = (fp - 1) / len(p), fp / len(p), fu / len(u)
            negative = -np.log1p(-np.clip(fu, 0, 1 - 1e-9)).mean() + prior * np.log1p(-np.clip(fp, 0, 1 - 1e-9)).mean()
            if negative >= 0:
                gp, gu = prior * (up - down_p), down_u
            else:
                gp, gu = prior * down_p, -down_u
            dp, du = gp[:, None] * v * (1 - hp**2), gu[:, None] * v * (1 - hu**2)
            grads = [p.T @ dp + u.T @ du + DECAY * w, dp.sum(0) + du.sum(0), hp.T @ gp + hu.T @ gu + DECAY * v, gp.sum() + gu.sum()]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                layers[k] = layers[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return (layers, first, second), step


def _standardised(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / spread, -6, 6)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = SEED) -> Model:
    """Fit to rows in memory."""
    both = np.concatenate([positive, unlabelled])
    mean, spread = both.mean(0), both.std(0)
    spread[spread < 1e-6] = 1.0
    pos, unl = (_standardised(x, mean, spread) for x in (positive, unlabelled))
    state, _ = _descend(_start(both.shape[1], seed), 0, pos, unl, prior, np.random.default_rng(seed), EPOCHS)
    return Model(mean, spread, state[0])


def _packed(rows: DataFrame, shards: int) -> DataFrame:
    """shard, piece, n and x: the feature rows (key, x) of each shard in the order of their keys, at most SHARD_ROWS in a piece."""
    import pyarrow as pa

    most = SHARD_ROWS

    def run(batches):
        common.claim("quality")
        shard, piece, held = None, 0, []

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([piece], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["shard", "piece", "n", "x"])

        for batch in batches:
            for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (s != shard or len(held) == most):
                    yield packed()
                    piece, held = (piece + 1 if s == shard else 0), []
                shard = s
                held.append(x)
        if held:
            yield packed()

    placed = rows.select(F.pmod("key", F.lit(shards)).cast("long").alias("shard"), "key", "x")
    placed = placed.repartition("shard").sortWithinPartitions("shard", "key", "x").select("shard", "x")
    return placed.mapInArrow(run, "shard bigint, piece bigint, n bigint, x binary")


def _mean_over(packed: DataFrame, pieces: int, make) -> np.ndarray:
    """The mean over all rows of make(features of a piece, (shard, piece)), in one order of addition whatever the layout.

    No more than GATHERED sums come to the driver.
    """
    import pyarrow as pa

    def run(batches):
        common.claim("quality")
        for batch in batches:
            for shard, piece, n, x in zip(*(batch.column(i) for i in range(4)), strict=True):
                rows = np.frombuffer(x.as_buffer(), np.float32).reshape(n.as_py(), N_FEATURES).astype(float)
                made = n.as_py() * np.asarray(make(rows, (shard.as_py(), piece.as_py())), float)
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()]), pa.array([piece.as_py()]), pa.array([n.as_py()]), pa.array([made.tobytes()], pa.binary())], names=["shard", "piece", "n", "made"])

    def add(batches):
        common.claim("quality")
        group, n, total = None, 0, 0.0
        for batch in batches:
            for g, k, made in zip(*(batch.column(i) for i in range(3)), strict=True):
                if g.as_py() != group:
                    if group is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([0], pa.int64()), pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["shard", "piece", "n", "made"])
                    group, n, total = g.as_py(), 0, 0.0
                n, total = n + k.as_py(), total + np.frombuffer(made.as_buffer())
        if group is not None:
            yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([0], pa.int64()), pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["shard", "piece", "n", "made"])

    sums = packed.mapInArrow(run, _SUMS)
    if pieces > GATHERED:
        sums = sums.withColumn("group", F.pmod("shard", F.lit(GATHERED))).repartition("group").sortWithinPartitions("group", "shard", "piece").select("group", "n", "made").mapInArrow(add, _SUMS)
    found = sorted(sums.collect(), key=lambda r: (r.shard, r.piece))
    return sum(np.frombuffer(r.made) for r in found) / sum(r.n for r in found)


_SUMS = "shard bigint, piece bigint, n bigint, made binary"


def fit_over(positive: np.ndarray, texts: DataFrame, prior: float, seed: int = SEED) -> Model:
    """Fit to positives in memory and all of the texts: in each round every shard goes on from the shared state, and the states are averaged.

    A row's shard follows from its identifier and features, so the same rows give the same model in any layout.
    """
    spark = texts.sparkSession
    path = common.shared_dir(spark)
    total = texts.count()  # reads identifiers only
    packed = common.stored(_packed(_feature_rows(texts, []), max(1, -(-total // SHARD_ROWS))), f"{path}/shards")
    pieces = packed.count()
    n = len(positive)
    share = n / (n + total)
    mean = share * positive.mean(0) + (1 - share) * _mean_over(packed, pieces, lambda x, _: x.mean(0))
    spread = np.sqrt(share * ((positive - mean) ** 2).mean(0) + (1 - share) * _mean_over(packed, pieces, lambda x, _: ((x - mean) ** 2).mean(0)))
    spread[spread < 1e-6] = 1.0
    shared = spark.sparkContext.broadcast(positive.astype(np.float32))
    state, step = _start(N_FEATURES, seed), 0.0
    shapes = [p.shape for part in state for p in part]
    cuts = np.cumsum([int(np.prod(s)) for s in shapes])

    def unpacked(flat):
        made = [p.reshape(s) for p, s in zip(np.split(flat, cuts[:-1]), shapes, strict=True)]
        return made[:4], made[4:8], made[8:]

    for turn in range(ROUNDS):

        def go_on(x, place, state=state, step=step, turn=turn):
            pos, unl = (_standardised(rows, mean, spread) for rows in (shared.value.astype(float), x))
            after, steps = _descend(state, step, pos, unl, prior, np.random.default_rng([seed, turn, *place]), EPOCHS // ROUNDS)
            return np.concatenate([*(p.ravel() for part in after for p in part), [steps]])

        flat = _mean_over(packed, pieces, go_on)
        state, step = unpacked(flat[:-1]), float(flat[-1])
    shared.destroy()
    common.remove(spark, path)
    return Model(mean, spread, state[0])


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Fit scale (positive) and shift of the margin to labelled rows by Newton steps on the logistic loss."""
    m = model.margin(x)
    if not 0 < y.mean() < 1:
        return
    a, b = 1.0, 0.0
    design = np.stack([m, np.ones_like(m)])
    for _ in range(50):
        f = _sigmoid(a * m + b)
        grad = design @ (f - y) / len(y) + np.array([1e-3 * (a - 1), 0])
        hess = (design * (f * (1 - f))) @ design.T / len(y) + 1e-3 * np.eye(2)
        da, db = np.linalg.solve(hess, grad)
        a, b = max(1e-3, a - da), b - db
    model.scale = (a, b)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _chosen(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """At most ``most`` of the rows: the first ones in the order of a hash of columns, then of the columns."""
    return rows.orderBy(F.xxhash64(*by, F.lit(SEED)), *by).limit(most)


def _feature_rows(docs: DataFrame, extra: list[str]) -> DataFrame:
    """Features of the texts as bytes (x), a key that follows from doc_id and them, and the extra columns."""
    import pyarrow as pa

    def run(batches):
        common.claim("quality")
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = [features(t).astype(np.float32).tobytes() for t in part.column(0).to_pylist()]
                keys = [int.from_bytes(hashlib.blake2b(str(i).encode() + x, digest_size=8).digest(), "little", signed=True) for i, x in zip(part.column(1).to_pylist(), made, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(made, pa.binary()), *(part.column(i + 2) for i in range(len(extra)))], names=["key", "x", *extra])

    kinds = "".join(f", {e} {docs.schema[e].dataType.simpleString()}" for e in extra)
    return docs.select("text", "doc_id", *extra).mapInArrow(run, f"key bigint, x binary{kinds}")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Fit on a bounded sample of labelled rows and all texts that are not held out; None without any positive label."""
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    marked = labels.select(labels[id_col].alias("doc_id"), labels[label_col].alias("label")).where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")) & F.col("label").isNotNull())
    sample = _chosen(marked.distinct(), SAMPLE_ROWS, "doc_id", "label")  # bounded, so it may be broadcast
    labelled = _feature_rows(texts.join(F.broadcast(sample), "doc_id"), ["label"])
    found = _chosen(labelled, SAMPLE_ROWS, "key", "x", "label").collect()  # an identifier may repeat without bound
    if not found:
        return None
    x = np.stack([np.frombuffer(r.x, np.float32) for r in found]).astype(float)
    y = np.array([float(r.label == 1) for r in found])
    if not y.sum():
        return None
    prior = float(np.clip(y.mean(), 0.05, 0.98))
    model = fit_over(x[y == 1], texts, prior)
    calibrate(model, x, y)
    return model


def score_quality(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), score_name: str = "score") -> DataFrame:
    """The columns id_col, keep and a score from 0 to 1 for every row of docs."""
    import pyarrow as pa

    names = list(dict.fromkeys([id_col, *keep]))
    schema = T.StructType([T.StructField(n, docs.schema[n].dataType) for n in names] + [T.StructField(score_name, T.DoubleType())])

    def run(batches):
        common.claim("quality")
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                x = np.stack([features(t) for t in part.column(len(names)).to_pylist()])
                scores = model.score(x.astype(np.float32).astype(float)) if model else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*[docs[n] for n in names], docs[text_col].alias("__text")).mapInArrow(run, schema)


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 from THRESHOLD on) for every row of docs."""
    scored = score_quality(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select(
        F.col(id_col).alias("doc_id"), is_held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
