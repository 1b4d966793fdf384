import hashlib
import re

import pytest

from lithoscope.llm.exact_dedup import DigestIndex, exact_dedup


def brute(rows):
    norm = [(i, t or "", re.sub(r"[\x20\x09-\x0D]", "", t or "")) for i, t in rows]
    out = []
    for i, _, n in norm:
        group = [(-len(t), j is None, j if j is not None else 0, j) for j, t, m in norm if m == n]
        keep = min(group, key=lambda g: g[:3])[3]
        out.append((i, keep, len(group), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r"), (7, "x"), (8, "x"), (8, "x"), (9, "é\xa0é"), (10, "éé"), (None, "ab"), (11, "q" * 50_000), (12, "q" * 50_000 + " ")]


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_against_brute_force(docs, digest_bytes):
    """A one-byte digest makes different texts meet, so verification and regrouping decide."""
    rows = ROWS + [(100 + i, f"text {i % 90}") for i in range(300)]
    got = sorted((tuple(r) for r in exact_dedup(docs(rows), digest_bytes=digest_bytes).collect()), key=repr)
    assert got == brute(rows)


def test_hot_group_and_empty_table(docs):
    rows = [(i, "same  text") for i in range(300)] + [(1000 + i, f"own {i}") for i in range(100)]
    got = {r.doc_id: r for r in exact_dedup(docs(rows)).collect()}
    assert {got[i].keep_id for i in range(300)} == {0} and got[5].group_size == 300
    assert sum(r.kept for r in got.values()) == 101
    assert exact_dedup(docs([])).count() == 0


def loaded(spark, rows, path, memtable_rows=5):
    index = DigestIndex(spark, f"file://{path}/index")
    index.load(rows, memtable_rows=memtable_rows)
    return index


def test_runs_merge_by_levels(spark, docs, tmp_path):
    """Compaction over several runs keeps one row for each digest, with the row that stays and all its rows."""
    rows = [(i, f"text {i % 60}" + " " * (i % 7)) for i in range(400)] + [(1000 + i, f"own {i}") for i in range(50)]
    index = loaded(spark, docs(rows), tmp_path)
    assert index.level.select("run").distinct().count() == 8 and index.level.where("group_size > 1").count()
    got = {(r.keep_id, r.group_size) for r in index.compact().collect()}
    want = {(keep, size) for _, keep, size, _, _ in brute(rows)}
    assert got == want and index.level.select("run").distinct().count() == 1


def test_filters_are_consulted(spark, docs, tmp_path):
    """Only digests that another run's filter knows are merged: with emptied filters copies in two runs stay apart."""
    rows = [(i, f"text {i % 50}") for i in range(300)] + [(1000 + i, f"own {i}") for i in range(2000)]
    index = loaded(spark, docs(rows), tmp_path / "a", memtable_rows=50)
    hits = index.probed().where("hit")
    own = index.probed().where("hit").join(index.entries.where("n_chars = 8 and doc_id >= 1000").select("digest"), "digest", "left_semi")
    assert hits.count() and own.count() < 50
    assert index.compact().count() == 2050
    index = loaded(spark, docs(rows), tmp_path / "b", memtable_rows=50)
    index.filters = index.filters.selectExpr("run", "block", "0L as mask")
    assert index.compact().count() > 2050


def test_no_python_on_the_main_path(docs):
    plan = exact_dedup(docs([(1, "a"), (2, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
