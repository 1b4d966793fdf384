import datetime as dt

import pytest

from lithoscope.plans import console, grid
from lithoscope.sources.catalog import write_csv
from lithoscope.plans.grid import Filter


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, "Alpha", 1.5, True, dt.date(2024, 1, 1)), (2, "be%ta", None, False, None), (3, None, 2.5, None, dt.date(2024, 6, 1)), (4, "a\\b", 2.5, True, dt.date(2023, 1, 1)), (5, "", -1.0, True, None)]
    return spark.createDataFrame(data, "id long, `na.me` string, x double, ok boolean, d date").repartition(2)


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize(
    "filters, want",
    [
        ({"na.me": Filter("contains", "A")}, [1, 2, 4]), ({"na.me": Filter("contains", "%")}, [1, 2, 4, 5]), ({"na.me": Filter("contains", "\\")}, [4]), ({"na.me": Filter("contains", "")}, [1, 2, 3, 4, 5]),
        ({"x": Filter("eq", "2.5")}, [3, 4]), ({"x": Filter("neq", "2.5")}, [1, 5]), ({"x": Filter("between", "0", "2.5")}, [1, 3, 4]), ({"x": Filter("between", "0", "")}, [1, 2, 3, 4, 5]), ({"x": Filter("gt", None)}, [1, 2, 3, 4, 5]),
        ({"ok": Filter("is_true")}, [1, 4, 5]), ({"ok": Filter("is_false")}, [2]), ({"ok": Filter("is_null")}, [3]), ({"d": Filter("gte", "2024-01-01")}, [1, 3]), ({"d": Filter("is_not_null"), "x": Filter("lt", "2")}, [1]), ({"gone": Filter("eq", "1")}, [1, 2, 3, 4, 5]),
    ],
)
def test_filters(rows, filters, want):
    assert ids(grid.where(rows, filters)) == want


def test_illegal_operation(rows):
    with pytest.raises(ValueError):
        grid.where(rows, {"ok": Filter("gt", "1")})


def test_quick_filter_sees_hidden_columns(rows):
    assert [r.asDict() for r in grid.query(rows, visible=["id"], quick=" ALPHA ").collect()] == [{"id": 1}]
    assert ids(grid.where(rows, quick="  ")) == [1, 2, 3, 4, 5]


def test_sort_puts_nulls_last_and_pages(rows):
    order = lambda desc: [r.id for r in grid.query(rows, sort=[("x", desc), ("no", True), ("id", False)]).collect()]
    assert order(False) == [5, 1, 3, 4, 2] and order(True) == [3, 4, 1, 5, 2]
    assert [r.id for r in grid.query(rows, sort=[("id", False)], number=1, size=2).collect()] == [3, 4]
    assert grid.query(rows, sort=[("unknown", False)]).count() == 5
    assert grid.count(rows, {"x": Filter("gt", "0")}).first().n == 3


def test_page_is_a_top_k(rows):
    plan = grid.query(rows, sort=[("x", True)], size=3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_filters_and_columns_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = grid.query(df, ["l_orderkey"], {"l_quantity": Filter("gt", "30")})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,30.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_state_rules():
    s = [("a", False)]
    assert grid.cycle_sort([], "a") == s and grid.cycle_sort(s, "a") == [("a", True)] and grid.cycle_sort([("a", True)], "a") == []
    assert grid.cycle_sort(s, "b", append=True) == [*s, ("b", False)] and grid.cycle_sort([*s, ("b", True)], "b", append=True) == s and grid.cycle_sort(s, "b") == [("b", False)]
    state = grid.GridState(number=3)
    assert state.change(quick="x").number == 0 and state.change(number=4).number == 4 and state.change(size=10).number == 0
    assert [grid.pages(n, 10) for n in (0, 10, 11)] == [1, 1, 2]


def test_values(spark):
    df = spark.createDataFrame([(f"v{i % 60:02d}",) for i in range(600)] + [(None,), ("v01",)], "v string")
    assert [(r.value, r.c) for r in grid.top_values(df, "v", 2).collect()] == [("v01", 11), ("v00", 10)]
    values, more = grid.categories(df, "v")
    assert len(values) == 50 and more and values[0] == "v00"


def test_console(spark, rows, tmp_path):
    rows.createOrReplaceTempView("`my.parquet`")
    assert console.run_sql(spark, "SELECT count(*) AS n FROM read_parquet('my.parquet') WHERE x > :low ; ", {"low": 0}).first().n == 3
    kept = console.Snippets(str(tmp_path / "s.json"))
    kept.save("a", "SELECT 1")
    kept.save("a", "SELECT 2")
    kept.save("b", "SELECT 3")
    kept.delete("b")
    assert console.Snippets(str(tmp_path / "s.json")).saved == {"a": "SELECT 2"}


def test_console_dialect():
    r = console.rewrite
    assert r("SELECT a // b, 'x // y', \"c // d\" FROM t -- 1 // 2\n;") == "SELECT a  DIV  b, 'x // y', \"c // d\" FROM t -- 1 // 2"
    assert r("SELECT * EXCLUDE (a, b) FROM t") == "SELECT * EXCEPT (a, b) FROM t" and r("SELECT * exclude a FROM t") == "SELECT * EXCEPT (a) FROM t"
    assert r("SELECT * REPLACE (f(a, 1) AS a, ')' AS b) FROM t") == "SELECT * EXCEPT (a, b), f(a, 1) AS a, ')' AS b FROM t"
    assert r("SELECT x FROM t USING SAMPLE 10 ROWS") == "SELECT * FROM (SELECT x FROM t) ORDER BY rand() LIMIT 10"
    assert r("SELECT x FROM t using sample 5%;") == "SELECT * FROM (SELECT x FROM t) WHERE rand() < 5 / 100.0"
    assert r("SELECT 'USING SAMPLE 5' FROM t") == "SELECT 'USING SAMPLE 5' FROM t" and r("SELECT * FROM read_parquet('a''b.parquet')") == "SELECT * FROM `a'b.parquet`"


def test_csv_parts_and_one_file(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "concat('a,', id) as text").repartition(3)
    for single, files in ((False, 3), (True, 1)):
        path = tmp_path / str(single)
        write_csv(df, f"file://{path}", single=single)
        assert len(list(path.glob("part-*"))) == files
        assert sorted((int(r.id), r.text) for r in spark.read.option("header", True).csv(f"file://{path}").collect()) == [(i, f"a,{i}") for i in range(100)]
