import sys
from pathlib import Path

import __spark_entry__ as entry


def test_names_agree():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len([n for n in queries if not n.startswith(("op", "pipeline"))]) > 80


def test_flagship(spark):
    assert entry.entry(spark).count() == 100


def test_nothing_else_imports_the_training_data_operators():
    root = Path(__file__).resolve().parents[1] / "lithoscope"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "llm" not in f.read_text()


def test_entry_without_training_data(monkeypatch):
    for name in list(sys.modules):
        if name.startswith("lithoscope.llm") or name == "corpus_pipeline":
            monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lithoscope.llm", None)
    assert not any(n.startswith("op1") for n in entry.queries()) and "grid_count" in entry.queries()
