import duckdb
import pytest

from lithoscope.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees(spark, name):
    with duckdb.connect() as db:
        for t in ("documents", "pages", "benchmark"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        found = db.sql(ORACLE_SQL[name])
        columns, want = sorted(found.columns), [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    shown = lambda rows: sorted((tuple(r[c] for c in columns) for r in rows), key=repr)
    assert shown(r.asDict() for r in got.collect()) == shown(want)
