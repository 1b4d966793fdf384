import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lithoscope.operators import anomalies as an
from lithoscope.operators import correlations as co
from lithoscope.operators import exact as ex
from lithoscope.operators import profile as pr
from lithoscope.operators import quality as q


@pytest.fixture(scope="module")
def mixed(spark):
    day = dt.datetime(2024, 1, 1)
    data = [(i, float(i % 10), "abc"[: i % 4] if i % 5 else None, i % 3 == 0, day + dt.timedelta(seconds=30 * i), [i] * (i % 3), {"k": i}, bytes([i]), (day + dt.timedelta(days=i)).date()) for i in range(40)]
    return spark.createDataFrame(data, "i int, x double, s string, b boolean, ts timestamp_ntz, xs array<int>, m map<string,int>, raw binary, d date").repartition(3)


def test_describe(mixed):
    got = {r.name: r for r in pr.describe(mixed, exact=True).collect()}
    assert (got["x"].num_min, got["x"].num_max, got["x"].mean, got["x"].p50, got["x"].distinct) == (0, 9, 4.5, 4.5, 10)
    assert (got["s"].nulls, got["s"].min_len, got["s"].max_len, got["s"].str_max) == (8, 0, 3, "abc")
    assert got["b"].true_count == 14 and (got["xs"].list_min, got["xs"].list_max) == (0, 2) and got["m"].list_avg == 1
    assert got["ts"].granularity == "second-level" and got["ts"].range_ms == 39 * 30_000 and got["d"].range_days == 39
    assert got["raw"].min_len == 1 and got["raw"]["count"] == 40


def test_describe_is_one_scan(mixed):
    plan = pr.describe(mixed.select("i", "x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 10, 10, math.nan)] + [(None,)], "v double")
    bins = {r.bin: (r.lo, r.hi, r.n) for r in pr.histogram(df, "v", bins=5).collect()}
    assert bins == {1: (0.0, 2.0, 3), 5: (8.0, 10.0, 2)}
    assert pr.histogram(df.where("v = 10"), "v") is None
    assert set(pr.charts(df.select("v", (df.v > 1).cast("string").alias("t")))) == {"v", "t"}


def test_correlations(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 7.0, None if i % 2 else float(-i), i % 2 == 0) for i in range(20)], "a double, b double, c double, d double, e boolean")
    got = {(r.a, r.b): r.r for r in co.correlations(df).collect()}
    assert got["a", "b"] == pytest.approx(1) and got["a", "d"] == pytest.approx(-1) and got["a", "c"] is None and ("d", "e") in got
    first = co.ranked(co.correlations(df)).first()
    assert first.strength == "very strong" and first.redundant
    assert co.matrix([("a", "b", 0.5)], ["a", "b"]) == [[1.0, 0.5], [0.5, 1.0]]
    assert co.correlations(df.select("a")).count() == 0


BASE = {"name": "c", "family": "string", "kind": "STRING", "total": 100, "count": 100, "nulls": 0, "distinct": 50, "empty": 0, "blank": 0, "untrimmed": 0, "distinct_ci": 50, "numeric_like": 0, "jsonish": 0, "json_invalid": 0, "placeholder": 0, "future": None, "max_epoch_ms": None}


@pytest.mark.parametrize(
    "change, want",
    [
        ({}, set()), ({"count": 0, "nulls": 100, "distinct": 0, "distinct_ci": 0}, {("all-null", "high")}), ({"count": 96, "nulls": 4}, set()), ({"count": 95, "nulls": 5}, {("null", "low")}), ({"count": 80, "nulls": 20}, {("null", "medium")}), ({"count": 50, "nulls": 50}, {("null", "high")}),
        ({"empty": 19, "blank": 19}, {("empty", "low")}), ({"empty": 20, "blank": 20}, {("empty", "medium")}), ({"blank": 1, "untrimmed": 1}, {("whitespace", "low")}), ({"placeholder": 19}, {("placeholder", "low")}), ({"placeholder": 20}, {("placeholder", "medium")}),
        ({"untrimmed": 9}, {("untrimmed", "low")}), ({"untrimmed": 10}, {("untrimmed", "medium")}), ({"distinct_ci": 49}, {("case", "medium")}), ({"numeric_like": 89}, set()), ({"numeric_like": 90}, {("numeric-cast", "medium")}), ({"numeric_like": 100}, set()),
        ({"jsonish": 79, "json_invalid": 1}, set()), ({"jsonish": 80, "json_invalid": 1}, {("json", "medium")}), ({"future": 4}, {("future", "low")}), ({"future": 5}, {("future", "medium")}), ({"distinct": 1, "distinct_ci": 1}, {("constant", "medium")}),
        ({"distinct": 94, "distinct_ci": 94}, set()), ({"distinct": 95, "distinct_ci": 95}, {("near-key", "medium")}), ({"distinct": 100, "distinct_ci": 100}, set()), ({"total": 20, "count": 20, "distinct": 19, "distinct_ci": 19}, set()),
    ],
)
def test_issue_thresholds(change, want):
    assert {(i.code, i.severity) for i in q.issues_of(BASE | change)} == want


def test_scores():
    as_of = dt.datetime(2024, 1, 31)
    ms = lambda d: int((d - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    clean = q.scores([BASE], 0, as_of)
    assert clean["dimensions"] == {"completeness": 100, "validity": 100, "uniqueness": 100, "freshness": None} and clean["grade"] == "Excellent"
    stamped = BASE | {"family": "timestamp", "kind": "TIMESTAMP", "max_epoch_ms": ms(dt.datetime(2023, 1, 31)), "distinct": 100, "distinct_ci": None}
    worse = q.scores([BASE | {"count": 50, "nulls": 50, "distinct": 1, "distinct_ci": 1}, stamped], 10, as_of)
    assert worse["dimensions"]["completeness"] == 75 and worse["dimensions"]["uniqueness"] == 73 and 74 <= worse["dimensions"]["freshness"] <= 76
    assert worse["candidate_keys"] == ["c"] and worse["issues"][0].severity == "high"
    assert [i.severity for i in q.duplicate_issue(4, 100) + q.duplicate_issue(5, 100)] == ["medium", "high"]
    assert [q.freshness_score(d) for d in (7, 730, 5000)] == [100, 50, 50] and [q.grade(s) for s in (90, 89, 60, 40, 39)] == ["Excellent", "Good", "Fair", "Poor", "Critical"]


def test_metrics_of_dirty_text(spark):
    values = ["", "   ", " x ", "N/A", "Active", "active", "{bad", '{"a": 1}', None, "12", "1e5", "1_000", "1d"]
    r = q.metrics(spark.createDataFrame([(v,) for v in values], "s string"), exact=True).first()
    assert (r.empty, r.blank, r.untrimmed, r.placeholder, r.jsonish, r.json_invalid, r.numeric_like, r.nulls) == (1, 2, 2, 1, 2, 1, 2, 1)
    assert r.distinct - r.distinct_ci == 1


def test_assess(spark):
    df = spark.createDataFrame([(i % 18, "a") for i in range(20)], "i int, s string")
    got = q.assess(df, as_of=dt.datetime(2024, 1, 1), exact=True)
    assert got["duplicate_rows"] == 2 and {i.code for i in got["issues"]} == {"constant", "duplicate"}
    assert q.duplicate_rows(spark.createDataFrame([([1],)], "xs array<int>")) is None
    assert q.assess(df.limit(0))["duplicate_rows"] is None


STATS = {"name": "c", "count": 1000, "constant": False, "below": 0, "above": 0, "zeros": 0, "negatives": 0, "p25": 1.0, "p75": 2.0, "min": 0.0, "max": 3.0}


@pytest.mark.parametrize(
    "change, want",
    [
        ({}, []), ({"count": 0}, [("empty", "low")]), ({"constant": True}, [("constant", "low")]), ({"above": 1}, [("outliers", "low")]), ({"above": 20}, [("outliers", "medium")]), ({"below": 50, "above": 50}, [("outliers", "high")]), ({"zeros": 699}, []), ({"zeros": 700}, [("zeros", "medium")]),
        ({"negatives": 9}, [("negatives", "low")]), ({"negatives": 10}, []), ({"max": 8.0}, []), ({"max": 8.1}, [("extreme", "medium")]), ({"min": -5.1}, [("extreme", "medium")]),
    ],
)
def test_flag_thresholds(change, want):
    assert [(f.code, f.severity) for f in an.flags_of(STATS | change)] == want


def test_anomalies(spark):
    df = spark.createDataFrame([(float(i), 5.0, None) for i in range(100)] + [(5000.0, 5.0, None)] * 2, "x double, k double, n double")
    stats, flags = an.anomalies(df, exact=True)
    by = {s["name"]: s for s in stats}
    assert by["x"]["above"] == 2 and by["k"]["constant"] and by["n"]["count"] == 0 and by["k"]["lo_fence"] is None and by["x"]["skew"] == "symmetric"
    assert {f.code for f in flags} == {"outliers", "extreme", "negatives"} - {"negatives"}
    assert an.anomalies(df.limit(0).select("x"))[1] == []


def test_correlations_with_nulls_constants_and_odd_values(spark):
    rng = np.random.default_rng(3)
    n = 5000
    base = rng.normal(0, 1, n)
    made = {"a": base + 1e9, "b": base * 2 + rng.normal(0, 1, n), "c": rng.normal(0, 1, n), "k": np.full(n, 0.1), "big": rng.normal(0, 1e-3, n) + 1e6}
    frame = pd.DataFrame(made)
    frame.loc[rng.random(n) < 0.3, "b"] = None
    frame.loc[rng.random(n) < 0.9, "c"] = None
    frame["only"] = np.where(frame["c"].notna(), 0.3, base)  # constant where c is present
    df = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r) for r in frame.itertuples(index=False)], ", ".join(f"{c} double" for c in frame)).repartition(7)
    got = {(r.a, r.b): r.r for r in co.correlations(df).collect()}
    want = frame.corr()
    for (a, b), r in got.items():
        if "k" in (a, b) or {a, b} == {"c", "only"}:
            assert r is None, (a, b)
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-7), (a, b)
    odd = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, math.nan, 2.0), (3.0, 4.0, None), (None, math.inf, 5.0)], "x double, y double, z double").repartition(2)
    got = {(r.a, r.b): r.r for r in co.correlations(odd).collect()}
    assert math.isnan(got["x", "y"]) and got["x", "z"] == pytest.approx(1) and math.isnan(got["y", "z"])
    assert all(r.r is None for r in co.correlations(odd.limit(0)).collect()) and co.correlations(odd.limit(0)).count() == 3


def test_exact_quantiles_and_counts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 3000
    made = {"normal": rng.normal(0, 1, n), "ties": rng.integers(0, 3, n).astype(float), "skew": np.exp(rng.normal(0, 4, n)), "one": np.full(n, 7.0), "sorted": np.arange(n) / 7, "few": np.r_[1.5, 2.5, np.full(n - 2, np.nan)], "none": np.full(n, np.nan)}
    rows = [tuple(None if math.isnan(v) else float(v) for v in r) for r in zip(*made.values(), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in made)).repartition(5)
    shares = (0.0, 0.25, 0.5, 0.75, 0.999, 1.0)
    for few, bracket in ((10_000, 100_000), (100, 100_000), (100, 5)):  # plain percentiles, brackets, narrowed brackets
        monkeypatch.setattr(ex, "FEW_ROWS", few)
        monkeypatch.setattr(ex, "BRACKET_ROWS", bracket)
        monkeypatch.setattr(ex, "ACCURACY", 10_000 if few > 100 else 100)
        monkeypatch.setattr(ex, "SLACK", 3e-4 if few > 100 else 0.03)
        got = ex.quantiles(df, {c: F.col(c) for c in made}, shares)
        for c, v in made.items():
            v = v[~np.isnan(v)]
            assert got[c] == ([None] * 6 if not len(v) else pytest.approx(list(np.quantile(v, shares)), rel=1e-12)), (c, few, bracket)
    monkeypatch.setattr(ex, "SLACK", -0.2)  # brackets that miss their ranks are opened
    assert ex.quantiles(df, {"normal": F.col("normal")}, (0.5,))["normal"] == [pytest.approx(np.quantile(made["normal"], 0.5))]
    texts = spark.createDataFrame([("x" * 65,), ("x" * 65,), ("x" * 66,), ("a",), (None,), ("A",)], "t string")
    assert pr.describe(texts, exact=True).first()["distinct"] == 4
    m = q.metrics(texts, exact=True).first()
    assert (m["distinct"], m.distinct_ci) == (4, 3)
