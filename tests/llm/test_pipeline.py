import hashlib
import random
import re

import corpus_pipeline as cp
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lithoscope.llm import common
from lithoscope.llm.decontaminate import brute_force as contamination
from lithoscope.llm.quality import THRESHOLD, features, train

from test_near_dedup import brute as near_brute


def test_decisions_take_effect(spark, words, tmp_path):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(60, 120)) + ".") for i in range(160)]
    rows += [(1000 + i, rows[i][1] + " ") for i in range(10)]  # copies, and longer: these stay
    rows += [(2000 + i, rows[20 + i][1].rsplit(" ", 1)[0] + " end.") for i in range(10)]
    item = text(30)
    rows += [(3000, f"{text(20)} {item}"), (3001, f"{text(200)} {' '.join(item.split()[:13])} {text(300)}")]
    rows += [(4000 + i, " ".join(f"{rng.choice(words)}###$$$!!".upper() for _ in range(80))) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    folder = f"file://{tmp_path}"
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 4000), 0) for i, _ in rows if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = cp.run(spark, folder)
    kept = {r.doc_id for r in out.collect()}
    assert kept.isdisjoint(range(4000, 4040)) and kept.isdisjoint(range(10)) and kept.isdisjoint(range(2000, 2010))
    assert 3000 not in kept and kept >= {*range(1000, 1010), *range(10, 160), 3001}
    assert [name for name, _ in cp.STAGES] == ["quality", "exact", "near", "decontaminate", "encode"]


#: Extra columns that have the names of what operators make.
ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, spans string, items string, n_words int, gone_id long, component_id string, row string"


def odd_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, False, "p", "q", 3, 7, "c", f"r{k}") for k, (i, t) in enumerate(rows)], ODD).repartition(3)


def tables(spark, folder, labels=(), items=()):
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")


def prose(words, seed, n=300):
    rng = random.Random(seed)
    good = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(60, 120))) + ".") for i in range(n)]
    bad = [(1000 + i, " ".join(f"{rng.choice(words)}###$$$!!".upper() for _ in range(80))) for i in range(n // 3)]
    return good, bad


def test_quality_stage(spark, words, tmp_path):
    folder = f"file://{tmp_path}"
    good, bad = prose(words, 3)
    tables(spark, folder, [(i, int(i < 1000), 0) for i, _ in good + bad if i % 2])
    odd = [(5000, None), (5001, ""), (None, good[0][1]), (None, None), (7, good[8][1]), (5002, " ".join(t for _, t in good) * 4)]
    docs = odd_docs(spark, good + bad + odd)
    out = cp.quality(spark, docs, folder)
    assert out.columns == docs.columns
    kept = out.collect()
    model = train(docs, common.table(spark, folder, "labels"))
    want = [(i, t) for i, t in good + bad + odd if model.score(features(t)[None].astype("float32").astype(float))[0] >= THRESHOLD]
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(want, key=str)
    assert all(r.doc_id is None or r.doc_id < 1000 or r.doc_id >= 5000 for r in kept) and {r.doc_id for r in kept} >= {i for i, _ in good}
    assert cp.quality(spark, docs.limit(0), folder).count() == 0
    tables(spark, folder)
    assert cp.quality(spark, docs, folder).count() == docs.count()


def test_exact_stage(spark, words, tmp_path):
    folder = f"file://{tmp_path}"
    long = " ".join(words) * 20
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t"), (None, "a  b"), (None, "own"), (None, "own"), (8, "x y"), (8, "x y"), (8, "other"), (9, long), (10, long + " ")]
    docs = odd_docs(spark, rows)
    out = cp.exact(spark, docs, folder)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(3, "a  b"), (6, " \t"), (None, "own"), (8, "x y"), (8, "other"), (10, long + " ")], key=str)
    assert cp.exact(spark, docs.limit(0), folder).count() == 0
    unique = odd_docs(spark, [(i, f"t{i % 3}") for i in range(9)])
    assert sorted(r.doc_id for r in cp.exact(spark, unique, folder).collect()) == [0, 1, 2]


def test_near_stage(spark, words, tmp_path):
    folder = f"file://{tmp_path}"
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, long, other = text(100), text(30_000), text(50)
    rows = [(1, base), (2, base + " end"), (3, None), (4, ""), (None, base), (None, None), (5, long), (6, long + " tail"), (7, other), (7, base + " more"), (8, other + " x"), (9, "one"), (10, "one")]
    docs = odd_docs(spark, rows)
    out = cp.near(spark, docs, folder)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, base), (3, None), (4, ""), (None, base), (None, None), (5, long), (9, "one")], key=str)
    assert cp.near(spark, docs.limit(0), folder).count() == 0


def test_decontaminate_stage(spark, words, tmp_path):
    folder = f"file://{tmp_path}"
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(20)
    tables(spark, folder, items=[(1, item), (None, text(15)), (2, None), (3, "")])
    rows = [(1, item), (2, text(30)), (3, None), (4, ""), (None, item), (None, text(9)), (1, text(40)), (5, f"{text(400)} {item}"), (6, f"{text(50_000)} {item}"), (7, f"{text(200)} {item}")]
    docs = odd_docs(spark, rows)
    out = cp.decontaminate(spark, docs, folder)
    assert out.columns == docs.columns
    kept = out.collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([rows[k] for k in (1, 2, 3, 5, 6, 7, 8)], key=str)
    assert all((r.score, r.kept, r.spans, r["items"], r.n_words) == (0.5, False, "p", "q", 3) for r in kept)
    assert cp.decontaminate(spark, docs.limit(0), folder).count() == 0
    tables(spark, folder)
    assert cp.decontaminate(spark, docs, folder).count() == len(rows)


def test_encode_stage(spark, words, tmp_path):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(1, "Hello, World!"), (1, "Hello, World!"), (None, "a b"), (2, None), (3, ""), (4, " ".join(words) * 10)]
    out = cp.encode(spark, odd_docs(spark, rows), "").collect()
    want = sorted((i is None, i or 0, tok.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in out) == want
    assert cp.encode(spark, odd_docs(spark, rows).limit(0), "").count() == 0
    assert cp.encode(spark, odd_docs(spark, rows).select("doc_id", "text"), "").columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_run_against_brute_force(spark, words, tmp_path):
    """The stages one after the other on lists in memory; only the classifier's weights come from the operator."""
    folder = f"file://{tmp_path}"
    good, bad = prose(words, 11, 200)
    rng = random.Random(13)
    item = " ".join(rng.choice(words) for _ in range(30))
    rows = good + bad + [(2000 + i, good[i][1].replace(" ", "  ")) for i in range(20)] + [(3000 + i, good[40 + i][1].rsplit(" ", 1)[0] + " end.") for i in range(20)]
    rows += [(4000 + i, f"{good[80 + i][1]} {item}") for i in range(5)] + [(4100, f"{' '.join(t for _, t in good[100:110])} {item[:120]}"), (4200, None), (4201, "")]
    labels = [(i, int(not 1000 <= i < 2000), 0) for i, _ in rows if i % 2]
    tables(spark, folder, labels, [(1, item), (2, "no such words here")])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    docs.write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r.ids_sha256 for r in cp.run(spark, folder).collect()}

    model = train(common.table(spark, folder, "documents"), common.table(spark, folder, "labels"))
    left = [(i, t) for i, t in rows if model.score(features(t)[None].astype("float32").astype(float))[0] >= THRESHOLD]
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups: dict[str, list] = {}
    for i, t in left:
        groups.setdefault(bare(t), []).append((-len(t or ""), i))
    stay = {min(g)[1] for g in groups.values()}
    left = [(i, t) for i, t in left if i in stay]
    component = near_brute(left, 5)
    left = [(i, t) for i, t in left if component[i][2]]
    hit = contamination(left, [(1, item), (2, "no such words here")])
    left = [(i, t) for i, t in left if not hit[i][4]]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: hashlib.sha256(" ".join(map(str, tok.encode(t or "", add_special_tokens=False).ids)).encode()).hexdigest() for i, t in left}
    assert got == want and 4000 not in got and 2000 in got


@pytest.mark.parametrize("stage", ["quality", "near", "decontaminate", "encode"])
def test_batches_of_texts_are_bounded_by_bytes(spark, stage, monkeypatch):
    tables = {"labels": "doc_id long, quality int", "benchmark": "item_id string, text string"}
    monkeypatch.setattr(common, "table", lambda spark, sf_dir, name: spark.createDataFrame([], tables[name]))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    try:
        dict(cp.STAGES)[stage](spark, spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), "")
        found = spark.range(0, 3000, 1, 1).selectExpr("repeat('abcd', 1000) as text").mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r.n for r in found) == 3000 and max(r.bytes for r in found) < 2 * common.BATCH_BYTES
        spark.conf.set(key, "1m")
        common.bound_batches(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
