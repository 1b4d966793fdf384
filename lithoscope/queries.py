"""The registered queries of the explorer, each with the SQL that gives the same rows.

Doubles are rounded on both sides; pages are cut from total orders.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import anomalies, correlations, profile, quality
from .operators.storage import probes, sortkeys
from .plans import console, grid
from .plans.grid import Filter
from .session import prepare

AS_OF = dt.datetime(2000, 1, 1)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None, run: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- grid: filters, quick filter, sort, page, count ---------------------------------------------------

LINE_KEY = [("l_orderkey", False), ("l_linenumber", False)]


def _filtered(name: str, tbl: str, filters: dict[str, Filter], condition: str, columns: list[str]) -> None:
    register(
        name,
        f"SELECT {', '.join(columns)} FROM {tbl} WHERE {condition}",
        lambda s, d: grid.project(grid.where(table(s, d, tbl), filters), columns),
    )


LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"]
_filtered("grid_filter_eq", "lineitem", {"l_returnflag": Filter("eq", "R")}, "l_returnflag = 'R'", LINE)
_filtered("grid_filter_neq", "lineitem", {"l_linestatus": Filter("neq", "O")}, "l_linestatus <> 'O'", LINE)
_filtered("grid_filter_lt", "lineitem", {"l_quantity": Filter("lt", "5")}, "l_quantity < 5", LINE)
_filtered("grid_filter_lte", "lineitem", {"l_quantity": Filter("lte", "5")}, "l_quantity <= 5", LINE)
_filtered("grid_filter_gt", "orders", {"o_totalprice": Filter("gt", "300000")}, "o_totalprice > 300000", ["o_orderkey", "o_totalprice"])
_filtered("grid_filter_gte", "orders", {"o_orderdate": Filter("gte", "1996-01-01")}, "o_orderdate >= TIMESTAMP '1996-01-01'", ["o_orderkey", "o_orderdate"])
_filtered("grid_filter_between", "lineitem", {"l_discount": Filter("between", "0.03", "0.05")}, "l_discount BETWEEN 0.03::DOUBLE AND 0.05::DOUBLE", LINE)
_filtered("grid_filter_contains", "customer", {"c_mktsegment": Filter("contains", "UILD")}, "c_mktsegment ILIKE '%UILD%'", ["c_custkey", "c_mktsegment"])
_filtered("grid_filter_contains_wildcard", "part", {"p_name": Filter("contains", "a%e_")}, "p_name ILIKE '%a%e_%'", ["p_partkey", "p_name"])
_HOLES = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders"
for _op, _test in (("is_null", "IS NULL"), ("is_not_null", "IS NOT NULL")):
    register(
        f"grid_filter_{_op}",
        f"SELECT o_orderkey FROM ({_HOLES}) WHERE o_orderpriority {_test}",
        lambda s, d, op=_op: grid.project(grid.where(table(s, d, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority"))), {"o_orderpriority": Filter(op)}), ["o_orderkey"]),
    )
_filtered("grid_filters_and", "lineitem", {"l_returnflag": Filter("eq", "A"), "l_quantity": Filter("gte", "40"), "l_tax": Filter("lt", "")}, "l_returnflag = 'A' AND l_quantity >= 40", LINE)


def _flags(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") > 0.05).alias("cheap"))


for _op, _value in (("is_true", "TRUE"), ("is_false", "FALSE")):
    register(
        f"grid_filter_{_op}",
        f"SELECT l_orderkey, l_linenumber FROM (SELECT *, l_discount > 0.05::DOUBLE AS cheap FROM lineitem) WHERE cheap = {_value}",
        lambda s, d, op=_op: grid.project(grid.where(_flags(s, d), {"cheap": Filter(op)}), ["l_orderkey", "l_linenumber"]),
    )
register(
    "grid_quick_filter",
    "SELECT c_custkey FROM customer WHERE c_name ILIKE '%11%' OR c_mktsegment ILIKE '%11%'",
    lambda s, d: grid.project(grid.where(table(s, d, "customer"), quick=" 11 "), ["c_custkey"]),
)
register(
    "grid_sort_page",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 100 OFFSET 200",
    lambda s, d: grid.query(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_extendedprice"], sort=[("l_extendedprice", True), *LINE_KEY, ("no_such", True)], number=2),
)
register(
    "grid_filtered_sorted_page",
    "SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 20 ORDER BY l_shipdate DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 100",
    lambda s, d: grid.query(table(s, d, "lineitem"), filters={"l_returnflag": Filter("eq", "R"), "l_quantity": Filter("gt", "20")}, sort=[("l_shipdate", True), *LINE_KEY]),
)
register(
    "grid_count",
    "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25 AND l_shipdate < TIMESTAMP '1997-01-01'",
    lambda s, d: grid.count(table(s, d, "lineitem"), {"l_quantity": Filter("gt", "25"), "l_shipdate": Filter("lt", "1997-01-01")}),
)
register(
    "grid_count_quick",
    "SELECT count(*) AS n FROM part WHERE p_name ILIKE '%an%' OR p_brand ILIKE '%an%' OR p_type ILIKE '%an%'",
    lambda s, d: grid.count(table(s, d, "part"), quick="an"),
)
register("grid_project_none_visible", "SELECT * FROM nation", lambda s, d: grid.project(table(s, d, "nation"), []))
register(
    "topk_event_type",
    "SELECT event_type AS value, count(*) AS c FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY c DESC, value LIMIT 10",
    lambda s, d: grid.top_values(table(s, d, "events"), "event_type"),
)
register(
    "topk_user",
    "SELECT user_id AS value, count(*) AS c FROM events WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY c DESC, value LIMIT 10",
    lambda s, d: grid.top_values(table(s, d, "events"), "user_id"),
)
register(
    "distinct_values_brand",
    "SELECT DISTINCT p_brand AS value FROM part WHERE p_brand IS NOT NULL ORDER BY value LIMIT 51",
    lambda s, d: grid.distinct_values(table(s, d, "part"), "p_brand"),
)
register(
    "csv_export_rows",
    "SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'",
    lambda s, d: _csv_round_trip(grid.project(grid.where(table(s, d, "customer"), {"c_mktsegment": Filter("eq", "BUILDING")}), ["c_custkey", "c_mktsegment"])),
)


def _scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; on one machine the temporary folder will do."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/lithoscope-scratch-{uuid.uuid4().hex}"


def _csv_round_trip(df: DataFrame) -> DataFrame:
    from .sources.catalog import write_csv

    path = _scratch(df.sparkSession)
    write_csv(df, path)
    return df.sparkSession.read.option("header", True).csv(path)


# ---- statistics ---------------------------------------------------------------------------------------

NUMERIC = {"lineitem": ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"], "part": ["p_size", "p_retailprice"], "events": ["user_id", "value"]}
_STAT = "SELECT '{c}' AS name, count(*) AS total, count({c}) AS count, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", round(min({c})::DOUBLE, 4) AS num_min, round(max({c})::DOUBLE, 4) AS num_max, round(avg({c})::DOUBLE, 4) AS mean, round(stddev_samp({c}), 4) AS std, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75 FROM {t}"
for _t, _cs in NUMERIC.items():
    register(
        f"profile_numeric_{_t}",
        " UNION ALL ".join(_STAT.format(c=c, t=_t) for c in _cs),
        lambda s, d, t=_t, cs=_cs: rounded(profile.describe(table(s, d, t).select(*cs), exact=True)).select("name", "total", "count", "nulls", "distinct", "num_min", "num_max", "mean", "std", "p25", "p50", "p75"),
    )
_TEXT = "SELECT '{c}' AS name, count({c}) AS count, count(DISTINCT {c}) AS \"distinct\", min(length({c})) AS min_len, max(length({c})) AS max_len, round(avg(length({c})), 4) AS avg_len, min({c}) AS str_min, max({c}) AS str_max FROM {t}"
for _t, _cs in {"part": ["p_name", "p_brand", "p_type"], "customer": ["c_name", "c_mktsegment"], "documents": ["text", "lang", "source"], "conversations": ["role", "text"]}.items():
    register(
        f"profile_string_{_t}",
        " UNION ALL ".join(_TEXT.format(c=c, t=_t) for c in _cs),
        lambda s, d, t=_t, cs=_cs: rounded(profile.describe(table(s, d, t).select(*cs), exact=True)).select("name", "count", "distinct", "min_len", "max_len", "avg_len", "str_min", "str_max"),
    )
_TIME = "SELECT '{c}' AS name, count(DISTINCT {c}) AS \"distinct\", epoch_ms(max({c})) - epoch_ms(min({c})) AS range_ms, bool_and(epoch_us({c}) % 1000000 = 0) AS whole_seconds, bool_and(epoch_us({c}) % 86400000000 = 0) AS midnight, CASE WHEN bool_and(epoch_us({c}) % 86400000000 = 0) THEN 'date-only' WHEN bool_and(epoch_us({c}) % 1000000 = 0) THEN 'second-level' ELSE 'sub-second' END AS granularity FROM {t}"
register(
    "profile_timestamp",
    " UNION ALL ".join(_TIME.format(c=c, t=t) for t, c in (("orders", "o_orderdate"), ("events", "ts"), ("lineitem", "l_shipdate"))),
    lambda s, d: (
        profile.describe(table(s, d, "orders").select("o_orderdate"), exact=True)
        .unionByName(profile.describe(table(s, d, "events").select("ts"), exact=True))
        .unionByName(profile.describe(table(s, d, "lineitem").select("l_shipdate"), exact=True))
        .select("name", "distinct", "range_ms", "whole_seconds", "midnight", "granularity")
    ),
)
register(
    "profile_date",
    "SELECT 'day' AS name, count(DISTINCT o_orderdate::DATE) AS \"distinct\", min(o_orderdate::DATE)::VARCHAR AS str_min, max(o_orderdate::DATE)::VARCHAR AS str_max, date_diff('day', min(o_orderdate::DATE), max(o_orderdate::DATE)) AS range_days FROM orders",
    lambda s, d: profile.describe(table(s, d, "orders").select(F.to_date("o_orderdate").alias("day")), exact=True).select("name", "distinct", "str_min", "str_max", "range_days"),
)
register(
    "profile_boolean",
    "SELECT 'cheap' AS name, count(*) AS total, count_if(l_discount > 0.05::DOUBLE) AS true_count FROM lineitem",
    lambda s, d: profile.describe(_flags(s, d).select("cheap")).select("name", "total", "true_count"),
)
register(
    "profile_list",
    "SELECT 'embedding' AS name, count(embedding) AS count, min(len(embedding)) AS list_min, max(len(embedding)) AS list_max, round(avg(len(embedding)), 4) AS list_avg FROM embeddings",
    lambda s, d: rounded(profile.describe(table(s, d, "embeddings").select("embedding"))).select("name", "count", "list_min", "list_max", "list_avg"),
)
register(
    "profile_map",
    "SELECT 'm' AS name, count(*) AS count, 2::BIGINT AS list_min, 2::BIGINT AS list_max, 2.0::DOUBLE AS list_avg FROM nation",
    lambda s, d: profile.describe(table(s, d, "nation").select(F.create_map(F.lit("a"), "n_nationkey", F.lit("b"), "n_regionkey").alias("m"))).select("name", "count", "list_min", "list_max", "list_avg"),
)


def _histogram_sql(t: str, value: str, bins: int) -> str:
    return f"""
WITH v AS (SELECT {value} AS x FROM {t}), m AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
b AS (SELECT least({bins}, greatest(1, ceil((x - lo) / ((hi - lo) / {bins}))))::INTEGER AS bin, lo, hi FROM v, m WHERE x IS NOT NULL)
SELECT bin, round(any_value(lo) + (bin - 1) * (any_value(hi) - any_value(lo)) / {bins}, 3) AS lo, round(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / {bins}, 3) AS hi, count(*) AS n FROM b GROUP BY bin"""


register("hist_numeric", _histogram_sql("lineitem", "l_extendedprice", 20), lambda s, d: rounded(profile.histogram(table(s, d, "lineitem"), "l_extendedprice"), 3))
register("hist_timeline", _histogram_sql("orders", "epoch_ms(o_orderdate)::DOUBLE", 20), lambda s, d: rounded(profile.histogram(table(s, d, "orders"), "o_orderdate"), 3))
register(
    "hist_hours",
    "SELECT extract(hour FROM ts)::INTEGER AS bin, count(*) AS n FROM events GROUP BY 1",
    lambda s, d: profile.histogram(table(s, d, "events").select(F.expr("cast(date_format(ts, 'HH:mm:ss') as time(6))").alias("t")), "t").select("bin", "n"),
)

register(
    "hist_json",
    f"SELECT to_json(map_from_entries(list({{'k': bin, 'v': n}} ORDER BY bin)))::VARCHAR AS histogram FROM ({_histogram_sql('lineitem', 'l_quantity', 20)})",
    lambda s, d: profile.histogram_json(table(s, d, "lineitem"), "l_quantity"),
)
register(
    "topk_nested",
    "SELECT to_json(value)::VARCHAR AS value, c FROM (SELECT [n_regionkey, n_regionkey % 2] AS value, count(*) AS c FROM nation GROUP BY 1)",
    lambda s, d: grid.top_values(table(s, d, "nation").select(F.array("n_regionkey", F.col("n_regionkey") % 2).alias("pair")), "pair"),
)

# ---- correlations ---------------------------------------------------------------------------------------


def _corr_sql(t: str, names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END, 6) AS r FROM {t}" for i, a in enumerate(names) for b in names[i + 1 :])


for _t, _cs in {"lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"], "part": ["p_partkey", "p_size", "p_retailprice"]}.items():
    register(f"corr_{_t}", _corr_sql(_t, _cs), lambda s, d, t=_t: rounded(correlations.correlations(table(s, d, t)), 6))
register(
    "corr_strength",
    f"WITH p AS ({_corr_sql('lineitem', ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'])}) SELECT a, b, CASE WHEN abs(r) >= 0.9 THEN 'very strong' WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'negligible' END AS strength, abs(r) >= 0.95 AS redundant FROM p WHERE r IS NOT NULL",
    lambda s, d: correlations.ranked(correlations.correlations(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])).drop("r"),
)

# ---- data quality ---------------------------------------------------------------------------------------

_TOKENS = ", ".join(f"'{p}'" for p in quality.PLACEHOLDERS)
_DQ = """SELECT '{c}' AS name, count({c}) AS count, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS "distinct",
 coalesce(count_if({c} = ''), 0)::BIGINT AS empty, coalesce(count_if(trim({c}) = ''), 0)::BIGINT AS blank, coalesce(count_if({c} <> trim({c})), 0)::BIGINT AS untrimmed,
 count(DISTINCT lower({c})) AS distinct_ci, coalesce(count_if(trim({c}) <> '' AND try_cast(trim({c}) AS DOUBLE) IS NOT NULL), 0)::BIGINT AS numeric_like,
 coalesce(count_if(trim({c}) LIKE '{{%' OR trim({c}) LIKE '[%'), 0)::BIGINT AS jsonish,
 coalesce(count_if((trim({c}) LIKE '{{%' OR trim({c}) LIKE '[%') AND NOT json_valid({c})), 0)::BIGINT AS json_invalid,
 coalesce(count_if(lower(trim({c})) IN ({tokens})), 0)::BIGINT AS placeholder FROM {t}"""
for _t, _cs in {"part": ["p_name", "p_brand", "p_type"], "events": ["event_type", "props"], "conversations": ["role", "text"], "documents": ["text", "lang"]}.items():
    register(
        f"dq_text_{_t}",
        " UNION ALL ".join(_DQ.format(c=c, t=_t, tokens=_TOKENS) for c in _cs),
        lambda s, d, t=_t, cs=_cs: quality.metrics(table(s, d, t).select(*cs), exact=True).drop("family", "kind", "total", "future", "max_epoch_ms"),
    )
_FUTURE = "SELECT '{c}' AS name, coalesce(count_if({c} > TIMESTAMP '2000-01-01'), 0)::BIGINT AS future, epoch_ms(max({c})) AS max_epoch_ms FROM {t}"
register(
    "dq_future",
    " UNION ALL ".join(_FUTURE.format(c=c, t=t) for t, c in (("orders", "o_orderdate"), ("events", "ts"))),
    lambda s, d: (
        quality.metrics(table(s, d, "orders").select("o_orderdate"), as_of=AS_OF).unionByName(quality.metrics(table(s, d, "events").select("ts"), as_of=AS_OF)).select("name", "future", "max_epoch_ms")
    ),
)
for _t, _cs in {"lineitem": "*", "conversations": "role, text", "documents": "text, lang"}.items():
    register(
        f"dup_rows_{_t}",
        f"SELECT (SELECT count(*) FROM {_t}) - (SELECT count(*) FROM (SELECT DISTINCT {_cs} FROM {_t})) AS duplicate_rows",
        lambda s, d, t=_t, cs=_cs: quality.duplicate_rows(table(s, d, t) if cs == "*" else table(s, d, t).select(*cs.split(", "))),
    )
#: Columns with every issue that the rules know, as an expression of Spark and of DuckDB alike: name, expression, whether text.
DIRTY = [
    ("all_null", "CAST(NULL AS STRING)", True),
    ("some_null", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('v', CAST(o_orderkey AS STRING)) END", True),
    ("few_null", "CASE WHEN o_orderkey % 25 = 0 THEN NULL ELSE concat('v', CAST(o_orderkey % 90 AS STRING)) END", True),
    ("empties", "CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN '   ' ELSE 'x' END", True),
    ("stand_ins", "CASE WHEN o_orderkey % 8 = 0 THEN 'N/A' WHEN o_orderkey % 8 = 1 THEN ' TBD ' ELSE 'given' END", True),
    ("padded", "CASE WHEN o_orderkey % 11 = 0 THEN ' a ' ELSE concat('b', CAST(o_orderkey % 7 AS STRING)) END", True),
    ("cased", "CASE WHEN o_orderkey % 2 = 0 THEN 'Active' ELSE 'active' END", True),
    ("numbers", "CASE WHEN o_orderkey % 20 = 0 THEN 'n.a.x' ELSE CAST(o_orderkey % 50 AS STRING) END", True),
    ("documents", "CASE WHEN o_orderkey % 9 = 0 THEN '{bad' ELSE concat('{\"k\": ', CAST(o_orderkey % 5 AS STRING), '}') END", True),
    ("constant", "'same'", True),
    ("near_key", "CASE WHEN o_orderkey % 40 = 0 THEN 0 ELSE o_orderkey END", False),
    ("plain", "o_orderkey % 10", False),
]


def _dirty(s: SparkSession, d: str) -> DataFrame:
    """DIRTY over orders, with a time column, and every hundredth row twice."""
    rows = table(s, d, "orders").selectExpr("o_orderkey % 100 = 0 AS again", *[f"{x} AS {n}" for n, x, _ in DIRTY], "o_orderdate AS stamp")
    return rows.unionByName(rows.where("again")).drop("again")


_DIRTY_SQL = f"dirty AS (SELECT {', '.join(f'{x} AS {n}' for n, x, _ in DIRTY)}, o_orderdate AS stamp FROM orders, unnest(CASE WHEN o_orderkey % 100 = 0 THEN [1, 2] ELSE [1] END) AS r(i))"


def _issues_sql() -> str:
    """The rules of issues in SQL: one SELECT per column and rule."""
    text = f"""count_if(trim({{c}}) = '') AS blank, count_if({{c}} = '') AS empty, count_if({{c}} <> trim({{c}})) AS untrimmed, count(DISTINCT lower({{c}})) AS folded,
 count_if(trim({{c}}) <> '' AND try_cast(trim({{c}}) AS DOUBLE) IS NOT NULL) AS num, count_if(trim({{c}}) LIKE '{{{{%' OR trim({{c}}) LIKE '[%') AS js, count_if((trim({{c}}) LIKE '{{{{%' OR trim({{c}}) LIKE '[%') AND NOT json_valid({{c}})) AS ji,
 count_if(lower(trim({{c}})) IN ({_TOKENS})) AS ph, 0 AS late"""
    plain = "0 AS blank, 0 AS empty, 0 AS untrimmed, count(DISTINCT {c}) AS folded, 0 AS num, 0 AS js, 0 AS ji, 0 AS ph, 0 AS late"
    time = plain.replace("0 AS late", "count_if({c} > TIMESTAMP '2000-01-01') AS late")
    rules = [
        ("completeness", "all-null", "'high'", "nulls", "total > 0 AND n = 0"),
        ("completeness", "null", "CASE WHEN nulls >= 0.5 * total THEN 'high' WHEN nulls >= 0.2 * total THEN 'medium' ELSE 'low' END", "nulls", "n > 0 AND nulls >= 0.05 * total"),
        ("completeness", "empty", "CASE WHEN empty >= 0.2 * n THEN 'medium' ELSE 'low' END", "empty", "empty > 0"),
        ("completeness", "whitespace", "'low'", "blank - empty", "blank > empty"),
        ("completeness", "placeholder", "CASE WHEN ph >= 0.2 * n THEN 'medium' ELSE 'low' END", "ph", "ph > 0"),
        ("validity", "untrimmed", "CASE WHEN untrimmed - (blank - empty) >= 0.1 * n THEN 'medium' ELSE 'low' END", "untrimmed - (blank - empty)", "untrimmed > blank - empty"),
        ("validity", "case", "'medium'", "NULL", "d > folded"),
        ("validity", "numeric-cast", "'medium'", "n - blank - num", "n - blank >= 10 AND num >= 0.9 * (n - blank) AND num < n - blank"),
        ("validity", "json", "'medium'", "ji", "ji > 0 AND n - blank >= 10 AND js >= 0.8 * (n - blank)"),
        ("validity", "future", "CASE WHEN late >= 0.05 * n THEN 'medium' ELSE 'low' END", "late", "late > 0"),
        ("uniqueness", "constant", "'medium'", "NULL", "d = 1"),
        ("uniqueness", "near-key", "'medium'", "n - d", "n > 20 AND nulls = 0 AND d >= 0.95 * n AND d < n"),
    ]
    columns = [(n, text if is_text else plain) for n, _, is_text in DIRTY] + [("stamp", time)]
    metrics = " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS total, count({c}) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS d, {more.format(c=c)} FROM dirty" for c, more in columns)
    found = " UNION ALL ".join(f"SELECT name AS column, '{dim}' AS dimension, '{code}' AS code, {severity} AS severity, ({bad})::BIGINT AS bad FROM metrics WHERE {where}" for dim, code, severity, bad, where in rules)
    same = "SELECT '(whole row)', 'uniqueness', 'duplicate', CASE WHEN k >= 0.05 * total THEN 'high' ELSE 'medium' END, k FROM (SELECT count(*) AS total, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS k FROM dirty) WHERE k > 0"
    return f"WITH {_DIRTY_SQL}, metrics AS ({metrics}), issues AS ({found} UNION ALL {same})"


register("dq_issues", f"{_issues_sql()} SELECT * FROM issues", lambda s, d: quality.issue_frame(_dirty(s, d), AS_OF, exact=True))


def _scores(s: SparkSession, d: str) -> DataFrame:
    found = quality.assess(_dirty(s, d), as_of=AS_OF, exact=True)
    rows = [*found["dimensions"].items(), ("overall", found["score"])]
    return s.createDataFrame(rows, "dimension string, score int")


register(
    "dq_scores",
    f"""{_issues_sql()},
b AS (SELECT dimension, sum(coalesce(bad, 0)) AS bad FROM issues GROUP BY 1),
t AS (SELECT max(total) AS total, sum(total) AS cells, sum(n) AS filled, count_if(n > 0 AND d = 1) AS constants FROM metrics),
k AS (SELECT count_if(code = 'case') AS cased, count_if(code = 'near-key') AS near_keys, coalesce(max(bad) FILTER (code = 'duplicate'), 0) AS copies FROM issues),
age AS (SELECT epoch(TIMESTAMP '2000-01-01') / 86400 - epoch_ms(max(stamp)) / 86400000 AS days FROM dirty),
raw AS (
  SELECT 'completeness' AS dimension, 0.35 AS weight, 100 * (1 - (SELECT bad FROM b WHERE dimension = 'completeness') / cells) AS x FROM t
  UNION ALL SELECT 'validity', 0.35, 100 * (1 - (SELECT bad FROM b WHERE dimension = 'validity') / filled) - least(15, 5 * cased) FROM t, k
  UNION ALL SELECT 'uniqueness', 0.2, 100 - least(45, 220 * copies / total) - least(25, 5 * constants) - least(15, 5 * near_keys) FROM t, k
  UNION ALL SELECT 'freshness', 0.1, CASE WHEN days <= 7 THEN 100 ELSE greatest(50, 100 - (days - 7) * 50 / 723) END FROM age),
s AS (SELECT dimension, weight, least(100, greatest(0, floor(x + 0.5)))::INTEGER AS score FROM raw)
SELECT dimension, score FROM s UNION ALL SELECT 'overall', floor(sum(weight * score) / sum(weight) + 0.5)::INTEGER FROM s""",
    _scores,
)


def _tally(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(profile.type_tally(grid.logical_types(table(s, d, "lineitem"))), "label string, n int")


register("type_tally_lineitem", "SELECT label, n::INTEGER AS n FROM (VALUES ('DOUBLE', 4), ('INT64', 3), ('STRING', 2), ('INT32', 1), ('TIMESTAMP(MICROS)', 1)) AS v(label, n)", _tally)

# ---- anomalies ------------------------------------------------------------------------------------------

_FENCE = """SELECT '{c}' AS name, count({c}) AS count, round(p25, 4) AS p25, round(p75, 4) AS p75, round(p25 - 1.5 * (p75 - p25), 4) AS lo_fence, round(p75 + 1.5 * (p75 - p25), 4) AS hi_fence,
 CASE WHEN (mean - p50) / std > 0.2 THEN 'right' WHEN (mean - p50) / std < -0.2 THEN 'left' ELSE 'symmetric' END AS skew, zeros, negatives
FROM (SELECT quantile_cont({c}::DOUBLE, 0.25) AS p25, quantile_cont({c}::DOUBLE, 0.5) AS p50, quantile_cont({c}::DOUBLE, 0.75) AS p75, avg({c}) AS mean, stddev_samp({c}) AS std, coalesce(count_if({c} = 0), 0)::BIGINT AS zeros, coalesce(count_if({c} < 0), 0)::BIGINT AS negatives FROM {t}), (SELECT {c} FROM {t}) GROUP BY ALL"""
_ANOMALY = {"lineitem": ["l_quantity", "l_extendedprice", "l_discount"], "customer": ["c_acctbal"], "events": ["value"]}
for _t, _cs in _ANOMALY.items():
    register(
        f"anomaly_fences_{_t}",
        " UNION ALL ".join(_FENCE.format(c=c, t=_t) for c in _cs),
        lambda s, d, t=_t, cs=_cs: rounded(anomalies.fences(anomalies.spread(table(s, d, t), cs, exact=True))).select("name", "count", "p25", "p75", "lo_fence", "hi_fence", "skew", "zeros", "negatives"),
    )
_OUT = "SELECT '{c}' AS name, coalesce(count_if({c} < lo), 0)::BIGINT AS below, coalesce(count_if({c} > hi), 0)::BIGINT AS above FROM {t}, (SELECT p25 - 1.5 * (p75 - p25) AS lo, p75 + 1.5 * (p75 - p25) AS hi FROM (SELECT quantile_cont({c}::DOUBLE, 0.25) AS p25, quantile_cont({c}::DOUBLE, 0.75) AS p75 FROM {t}))"
for _t, _cs in _ANOMALY.items():
    register(
        f"anomaly_outliers_{_t}",
        " UNION ALL ".join(_OUT.format(c=c, t=_t) for c in _cs),
        lambda s, d, t=_t, cs=_cs: anomalies.outliers(table(s, d, t), anomalies.fences(anomalies.spread(table(s, d, t), cs, exact=True))),
    )



#: Numeric columns with every flag, as expressions of Spark and of DuckDB alike.
ODD_NUMBERS = {
    "spread": "value",
    "mostly_zero": "CASE WHEN event_id % 10 < 8 THEN 0.0 ELSE value END",
    "rarely_negative": "CASE WHEN event_id % 500 = 0 THEN -1.0 ELSE 1.0 + event_id % 17 END",
    "far_out": "CASE WHEN event_id % 300 = 0 THEN 1000000.0 WHEN event_id % 300 = 1 THEN -1000000.0 ELSE event_id % 29 + 0.5 END",
    "often_out": "CASE WHEN event_id % 8 = 0 THEN 500.0 ELSE event_id % 20 + 0.0 END",
    "same": "7.0",
    "missing": "CAST(NULL AS DOUBLE)",
}


def _flags_of(s: SparkSession, d: str) -> DataFrame:
    odd = table(s, d, "events").selectExpr(*[f"CAST({x} AS DOUBLE) AS {n}" for n, x in ODD_NUMBERS.items()])
    _, flags = anomalies.anomalies(odd, exact=True)
    return s.createDataFrame([(f.column, f.severity, f.code) for f in flags], "column string, severity string, code string")


_ODD_STATS = " UNION ALL ".join(
    f"SELECT '{n}' AS name, count(x) AS n, min(x) AS low, max(x) AS high, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.75) AS p75, count_if(x = 0) AS zeros, count_if(x < 0) AS negatives, list(x) AS xs FROM (SELECT ({e})::DOUBLE AS x FROM events)" for n, e in ODD_NUMBERS.items()
)
register(
    "anomaly_flags",
    f"""WITH s AS ({_ODD_STATS}),
f AS (SELECT * EXCLUDE (xs), p75 - p25 AS iqr, CASE WHEN p75 > p25 THEN len(list_filter(xs, lambda x: x < p25 - 1.5 * (p75 - p25) OR x > p75 + 1.5 * (p75 - p25))) ELSE 0 END AS outside FROM s WHERE n > 0 AND low < high)
SELECT name AS column, CASE WHEN outside >= 0.1 * n THEN 'high' WHEN outside >= 0.02 * n THEN 'medium' ELSE 'low' END AS severity, 'outliers' AS code FROM f WHERE outside > 0
UNION ALL SELECT name, 'medium', 'zeros' FROM f WHERE zeros >= 0.7 * n
UNION ALL SELECT name, 'low', 'negatives' FROM f WHERE negatives > 0 AND negatives < 0.01 * n
UNION ALL SELECT name, 'medium', 'extreme' FROM f WHERE iqr > 0 AND high > p75 + 6 * iqr
UNION ALL SELECT name, 'medium', 'extreme' FROM f WHERE iqr > 0 AND low < p25 - 6 * iqr""",
    _flags_of,
)

# ---- storage probes -------------------------------------------------------------------------------------

_PROBE_NUM = "SELECT '{c}' AS name, count({c}) AS non_null, count(DISTINCT {c}) AS \"distinct\", round(min({c})::DOUBLE, 4) AS num_min, round(max({c})::DOUBLE, 4) AS num_max, bool_and({c} = trunc({c})) AS int_valued, bool_and({c} = {c}::FLOAT::DOUBLE) AS float_round_trips FROM {t}"
register(
    "probe_double",
    " UNION ALL ".join(_PROBE_NUM.format(c=c, t="lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    lambda s, d: rounded(probes.probes(table(s, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax"), exact=True)).select("name", "non_null", "distinct", "num_min", "num_max", "int_valued", "float_round_trips"),
)
register(
    "probe_int",
    " UNION ALL ".join(f"SELECT '{c}' AS name, min({c})::DOUBLE AS num_min, max({c})::DOUBLE AS num_max FROM {t}" for t, c in (("part", "p_partkey"), ("part", "p_size"))),
    lambda s, d: probes.probes(table(s, d, "part").select("p_partkey", "p_size"), exact=True).select("name", "num_min", "num_max"),
)
_PROBE_TEXT = "SELECT '{c}' AS name, min(length({c})) AS min_len, max(length({c})) AS max_len, bool_and(regexp_matches({c}, '^[+-]?[0-9]+$')) AS all_int, bool_and(regexp_matches({c}, '^(true|false|t|f|yes|no)$', 'i')) AS all_bool, bool_and(starts_with(trim({c}), '{{') OR starts_with(trim({c}), '[')) AS all_json, bool_and(try_cast({c} AS DOUBLE) IS NOT NULL) AS all_double, bool_and(try_cast({c} AS TIMESTAMP) IS NOT NULL) AS all_timestamp FROM {t}"
register(
    "probe_string",
    " UNION ALL ".join(_PROBE_TEXT.format(c=c, t="events") for c in ("event_type", "props")),
    lambda s, d: probes.probes(table(s, d, "events").select("event_type", "props"), exact=True).select("name", "min_len", "max_len", "all_int", "all_bool", "all_json", "all_double", "all_timestamp"),
)
register(
    "probe_string_typed",
    " UNION ALL ".join(_PROBE_TEXT.format(c=c, t=f"(SELECT {v} AS {c} FROM orders)") for c, v in (("as_int", "o_orderkey::VARCHAR"), ("as_day", "strftime(o_orderdate, '%Y-%m-%d')"), ("as_bool", "CASE WHEN o_custkey % 2 = 0 THEN 'yes' ELSE 'No' END"))),
    lambda s, d: probes.probes(
        table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("as_int"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("as_day"), F.when(F.col("o_custkey") % 2 == 0, "yes").otherwise("No").alias("as_bool")), exact=True
    ).select("name", "min_len", "max_len", "all_int", "all_bool", "all_json", "all_double", "all_timestamp"),
)
register(
    "probe_timestamp",
    " UNION ALL ".join(f"SELECT '{c}' AS name, bool_and(epoch_us({c}) % 1000 = 0) AS whole_millis, bool_and(epoch_us({c}) % 86400000000 = 0) AS midnight FROM {t}" for t, c in (("orders", "o_orderdate"), ("events", "ts"))),
    lambda s, d: probes.probes(table(s, d, "orders").select("o_orderdate")).unionByName(probes.probes(table(s, d, "events").select("ts"))).select("name", "whole_millis", "midnight"),
)
register(
    "sort_overlap_sim",
    "SELECT rg, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM (SELECT o_totalprice, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 1000 AS rg FROM orders) GROUP BY rg",
    lambda s, d: sortkeys.simulated_groups(table(s, d, "orders"), ["o_orderdate", "o_orderkey"], "o_totalprice", 1000),
)


# ---- footers --------------------------------------------------------------------------------------------


def _footer(kind: str, *args):
    def run(s: SparkSession, d: str) -> DataFrame:
        from .sources import footer

        return getattr(footer, kind)(s, f"{d}/{args[0]}.parquet")

    return run


def _rollup(s: SparkSession, d: str) -> DataFrame:
    from .sources import footer

    return footer.column_rollup(footer.column_chunks(s, f"{d}/lineitem.parquet")).select("top", "codecs", "compressed", "uncompressed", "num_values", "nulls", "any_bloom")


def _read_by_duckdb(t: str, sql: str, function: str = "parquet_metadata") -> str:
    """SQL over DuckDB's own reading of the footer of a table's file: of the scales' files the one with the table's rows."""
    files = f"/root/testdata/sf0*/{t}.parquet"
    chosen = f"SELECT file_name FROM parquet_file_metadata('{files}') WHERE num_rows = (SELECT count(*) FROM {t})"
    return sql.format(footer=f"(SELECT * FROM {function}('{files}') WHERE file_name IN ({chosen}))")


register(
    "footer_rollup",
    _read_by_duckdb("lineitem", "SELECT path_in_schema AS top, string_agg(DISTINCT compression, ', ') AS codecs, sum(total_compressed_size)::BIGINT AS compressed, sum(total_uncompressed_size)::BIGINT AS uncompressed, sum(num_values)::BIGINT AS num_values, sum(stats_null_count)::BIGINT AS nulls, bool_or(bloom_filter_offset IS NOT NULL) AS any_bloom FROM {footer} GROUP BY 1"),
    _rollup,
)
register(
    "footer_row_groups",
    _read_by_duckdb("orders", "SELECT row_group_id::INTEGER AS row_group, any_value(row_group_num_rows) AS num_rows, sum(total_compressed_size)::BIGINT AS compressed FROM {footer} GROUP BY 1"),
    lambda s, d: _footer("row_groups", "orders")(s, d).select("row_group", "num_rows", "compressed"),
)
register(
    "footer_file",
    _read_by_duckdb("documents", "SELECT created_by, num_rows, num_row_groups::INTEGER AS num_row_groups FROM {footer}", "parquet_file_metadata"),
    lambda s, d: _footer("file_meta", "documents")(s, d).select("created_by", "num_rows", "num_row_groups"),
)
register(
    "footer_summary",
    _read_by_duckdb("events", "SELECT (SELECT count(*) FROM events) AS num_rows, count(DISTINCT row_group_id) AS num_row_groups, string_agg(DISTINCT compression, ', ') AS codecs, sum(total_compressed_size)::BIGINT AS compressed, bool_or(contains(path_in_schema, ', ')) AS nested, count(DISTINCT path_in_schema) AS num_columns FROM {footer}"),
    lambda s, d: _footer("file_summary", "events")(s, d).select("num_rows", "num_row_groups", "codecs", "compressed", "nested", "num_columns"),
)
register(
    "footer_schema",
    _read_by_duckdb("embeddings", "SELECT DISTINCT name, type AS physical, repetition_type AS repetition, num_children::INTEGER AS num_children, converted_type AS converted FROM {footer}", "parquet_schema"),
    lambda s, d: _footer("schema_nodes", "embeddings")(s, d).select("name", "physical", "repetition", "num_children", "converted"),
)
register(
    "footer_kv",
    _read_by_duckdb("lineitem", "SELECT decode(key) AS key, md5(decode(value)) AS value FROM {footer}", "parquet_kv_metadata"),
    lambda s, d: _footer("kv_meta", "lineitem")(s, d).select("key", F.md5("value").alias("value")),
)


def _candidates(s: SparkSession, d: str) -> DataFrame:
    from .sources import footer

    return footer.categorical_candidates(footer.column_chunks(s, f"{d}/lineitem.parquet"))


register("categorical_candidates", "SELECT unnest(['l_linestatus', 'l_returnflag']) AS top", _candidates)


def _advice(s: SparkSession, d: str) -> DataFrame:
    from .operators.storage.advise import advise

    found = advise(s, f"{d}/lineitem.parquet", _scratch(s), exact=True)
    return s.createDataFrame([(x.id, x.category, x.severity, x.current, x.suggested, x.saves) for x in found], "id string, category string, severity string, current string, suggested string, saves bigint")


register("optimize_lineitem", None, _advice)


#: Columns that ask for another type, as expressions of Spark and of DuckDB: name, Spark's, DuckDB's or None where it is the same, the suggestion and its severity in SQL (None: no suggestion).
ASKING = [
    ("narrow", "o_orderkey % 50", None, "CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'INT8' END", "'high'"),
    ("middle", "o_orderkey % 30000 + 100", None, "CASE WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'INT16' END", "'high'"),
    ("below", "CAST(o_orderkey % 100000 AS BIGINT) - 50000", None, "CASE WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'INT16' WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'INT32' END", "CASE WHEN min({c}) >= -32768 THEN 'high' ELSE 'medium' END"),
    ("wide", "o_orderkey * 5000000000", None, None, None),
    ("whole", "CAST(o_orderkey % 200 AS DOUBLE)", None, "CASE WHEN bool_and({c} = trunc({c})) AND max({c}) > 127 AND max({c}) <= 255 THEN 'UINT8' END", "'high'"),
    ("halves", "CAST(o_orderkey AS DOUBLE) / 2", None, "CASE WHEN bool_and({c} = {c}::FLOAT::DOUBLE) THEN 'FLOAT' END", "'medium'"),
    ("price", "o_totalprice", None, None, None),
    ("uid", "concat('0f8fad5b-d9cb-469f-a165-70867728', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'))", None, "CASE WHEN bool_and(regexp_full_match({c}, '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}')) THEN 'UUID' END", "'medium'"),
    ("digits", "CAST(o_orderkey % 60000 AS STRING)", None, "CASE WHEN bool_and(regexp_full_match({c}, '[+-]?[0-9]+')) THEN CASE WHEN max({c}::BIGINT) <= 127 THEN 'INT8' WHEN max({c}::BIGINT) <= 255 THEN 'UINT8' WHEN max({c}::BIGINT) <= 32767 THEN 'INT16' ELSE 'UINT16' END END", "'high'"),
    ("truth", "CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'No' END", None, "CASE WHEN bool_and(lower({c}) IN ('yes', 'no')) THEN 'BOOLEAN' END", "'high'"),
    ("day_text", "date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')", "CASE WHEN bool_and(try_cast({c} AS DATE) IS NOT NULL) THEN 'DATE' END", "'high'"),
    ("time_text", "date_format(o_orderdate + INTERVAL 1 HOUR, 'yyyy-MM-dd HH:mm:ss')", "strftime(o_orderdate + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S')", "CASE WHEN bool_and(try_cast({c} AS TIMESTAMP) IS NOT NULL) THEN 'TIMESTAMP(MICROS)' END", "'high'"),
    ("number_text", "concat(CAST(o_orderkey AS STRING), '.5')", None, "CASE WHEN bool_and(try_cast({c} AS DOUBLE) IS NOT NULL) THEN 'DOUBLE' END", "'high'"),
    ("json_text", "concat('{\"k\": ', CAST(o_orderkey AS STRING), '}')", None, "CASE WHEN bool_and(json_valid({c})) THEN 'JSON' END", "'low'"),
    ("few_texts", "o_orderpriority", None, "CASE WHEN count(DISTINCT {c}) < 100 AND count({c}) >= 10 * count(DISTINCT {c}) THEN 'ENUM' END", "'medium'"),
    ("same_length", "concat('K', lpad(CAST(o_orderkey AS STRING), 9, '0'), 'Z')", None, "CASE WHEN min(length({c})) = max(length({c})) THEN 'FIXED_LEN_BYTE_ARRAY(' || min(length({c})) || ')' END", "'low'"),
    ("midnight", "o_orderdate", None, "CASE WHEN bool_and(epoch_us({c}) % 86400000000 = 0) THEN 'DATE' END", "'high'"),
    ("millis", "o_orderdate + INTERVAL 1 HOUR", None, "CASE WHEN bool_and(epoch_us({c}) % 1000 = 0) THEN 'TIMESTAMP(MILLIS)' END", "'low'"),
    ("amount", "CAST(o_orderkey % 1000 AS DECIMAL(18,2))", None, "CASE WHEN max(abs({c})) < 1000 THEN 'DECIMAL(5, 2)' END", "'low'"),
]


def _types_asked(s: SparkSession, d: str) -> DataFrame:
    """What the type rules suggest for ASKING."""
    from .operators.storage import rules

    rows = table(s, d, "orders").selectExpr(*[f"{x} AS {n}" for n, x, *_ in ASKING])
    types = grid.logical_types(rows)
    found = {r["name"]: r.asDict() for r in probes.probes(rows, types, exact=True).collect()}
    made = []
    for path, t in probes.targets(types):
        few = grid.categories(rows, path[0]) if t.kind == "STRING" and rules.low_cardinality(found[path[0]]) else None
        made += filter(None, [rules.type_suggestion(path, t, found[path[0]], None, few)])
    return s.createDataFrame([(x.column, x.suggested, x.severity) for x in made], "column string, suggested string, severity string")


register(
    "type_rules",
    f"WITH asking AS (SELECT {', '.join(f'{y or x} AS {n}' for n, x, y, _, _ in ASKING)} FROM orders), found AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS column, {suggested.format(c=n)} AS suggested, {severity.format(c=n)} AS severity FROM asking" for n, _, _, suggested, severity in ASKING if suggested)
    + ") SELECT * FROM found WHERE suggested IS NOT NULL",
    _types_asked,
)


LINE_COLUMNS = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


def _storage_rules(s: SparkSession, d: str) -> DataFrame:
    """What the rules of compression and Bloom filters suggest for lineitem."""
    from .operators.storage import rules
    from .sources import footer

    rows = table(s, d, "lineitem")
    types = grid.logical_types(rows)
    found = {r["name"]: r.asDict() for r in probes.probes(rows, types, exact=True).collect()}
    rolled = {r["top"]: r.asDict() for r in footer.column_rollup(footer.column_chunks(s, f"{d}/lineitem.parquet")).collect()}
    made = [x for n, t in types.items() for x in (rules.compression_suggestion(n, rolled[n]), rules.bloom_suggestion(n, t, found[n], rolled[n], bool(rolled[n]["all_bloom"]))) if x]
    return s.createDataFrame([(x.id, x.severity, x.saves) for x in made], "id string, severity string, saves bigint")


register(
    "storage_rules",
    _read_by_duckdb(
        "lineitem",
        "WITH m AS (SELECT path_in_schema AS c, string_agg(DISTINCT compression, ', ') AS codec, sum(total_compressed_size) AS packed, sum(total_uncompressed_size) AS plain, bool_and(bloom_filter_offset IS NOT NULL) AS bloom FROM {footer} GROUP BY 1), d AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS c, count(DISTINCT {c}) AS d FROM lineitem" for c in LINE_COLUMNS)
        + ") SELECT 'compression:' || c AS id, 'medium' AS severity, round_even(packed * 0.25, 0)::BIGINT AS saves FROM m WHERE codec = 'SNAPPY' AND plain > 1048576 AND plain < 3 * packed UNION ALL SELECT 'bloom:' || c, 'low', NULL FROM m JOIN d USING (c) WHERE d >= 10000 AND NOT bloom",
    ),
    _storage_rules,
)
_IN_ORDER = ["o_orderkey", "o_custkey", "o_totalprice"]
register(
    "columns_in_order",
    "WITH r AS (SELECT * FROM read_parquet('/root/testdata/sf0*/orders.parquet', file_row_number = true, filename = true) WHERE filename IN (SELECT file_name FROM parquet_file_metadata('/root/testdata/sf0*/orders.parquet') WHERE num_rows = (SELECT count(*) FROM orders))) "
    + " UNION ALL ".join(f"SELECT '{c}' AS name, coalesce(bool_and(c >= p), true) AS sorted FROM (SELECT {c} AS c, lag({c}) OVER (ORDER BY file_row_number) AS p FROM r WHERE {c} IS NOT NULL)" for c in _IN_ORDER),
    lambda s, d: probes.sorted_columns(table(s, d, "orders"), _IN_ORDER),
)


def _rewritten(s: SparkSession, d: str) -> DataFrame:
    from .operators.storage import rewrite, rules

    orders = table(s, d, "orders")
    made = [
        rules.Suggestion("type:o_orderkey", "type", "medium", "o_orderkey", "INT64", "INT32", "", rule=rules.Rule("cast", ("o_orderkey",), "int")),
        rules.Suggestion("rowgroup:sort:o_orderdate", "rowgroup", "high", "o_orderdate", "", "sort key", "", rule=rules.Rule("sort", ("o_orderdate",))),
        rules.Suggestion("bloom:o_custkey", "bloom", "low", "o_custkey", "", "", "", rule=rules.Rule("bloom", ("o_custkey",))),
    ]
    target = _scratch(s)
    plan = rewrite.plan_of(made, rules.actionable(made), grid.logical_types(orders))
    rewrite.write(rewrite.transformed(orders, plan), plan, target, partitions=4)
    return s.read.parquet(target)


register("rewrite_round_trip", "SELECT * REPLACE (o_orderkey::INTEGER AS o_orderkey) FROM orders", _rewritten)


# ---- console: one query per category of SQL -------------------------------------------------------------


def _views(s: SparkSession, d: str) -> SparkSession:
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        table(s, d, t).createOrReplaceTempView(t)
    return s


def _console(name: str, sql: str, oracle: str | None = None) -> None:
    register(f"console_{name}", oracle or sql, lambda s, d: console.run_sql(_views(s, d), sql))


_console("join_inner", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name;", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
_console("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
_console("join_full", "SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) a FULL OUTER JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) b ON a.k = b.k")
_console("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_console("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_orderpriority LIKE '1%'", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
_console("join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_console("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_console("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_console("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
_console("window_rank", "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders")
_console("window_lag", "SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders")
_console("window_frame", "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_quantity ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS q FROM lineitem")
_console("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_console("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_console("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
_console("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey) SELECT c_mktsegment, count(*) AS n FROM big JOIN customer ON c_custkey = o_custkey WHERE spent > 1000000 GROUP BY c_mktsegment")
_console("subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
_console("correlated", "SELECT p_partkey FROM part WHERE p_retailprice = (SELECT max(q.p_retailprice) FROM part q WHERE q.p_brand = part.p_brand)")
_console(
    "join_asof",
    "SELECT event_id, order_before FROM (SELECT event_id, is_event, last(CASE WHEN NOT is_event THEN k END, true) OVER (PARTITION BY u ORDER BY t, is_event, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS order_before FROM (SELECT user_id AS u, ts AS t, event_id AS k, event_id, true AS is_event FROM events UNION ALL SELECT o_custkey, o_orderdate, o_orderkey, NULL, false FROM orders)) WHERE is_event",
    "SELECT event_id, (SELECT max_by(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey = user_id AND o_orderdate <= ts) AS order_before FROM events",
)
_console("join_range", "SELECT p.p_partkey, count(*) AS n FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey AND l.l_extendedprice BETWEEN p.p_retailprice * 10 AND p.p_retailprice * 30 GROUP BY p.p_partkey")
_console("star_replace", "SELECT * REPLACE (n_nationkey // 2 AS n_nationkey, upper(n_name) AS n_name) FROM nation")
_console("star_exclude", "SELECT * EXCLUDE (r_name) FROM region -- a // b", "SELECT * EXCLUDE (r_name) FROM region")
register(
    "console_sample",
    "SELECT 40 AS n, 40 AS distinct_keys",
    lambda s, d: console.run_sql(_views(s, d), "SELECT * FROM customer USING SAMPLE 40 ROWS").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_distinct("c_custkey").cast("int").alias("distinct_keys")),
)
_console("read_parquet", "SELECT count(*) AS n FROM read_parquet('region')", "SELECT count(*) AS n FROM region")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered, sorted page of the largest table."""
    return QUERIES["grid_filtered_sorted_page"](spark, sf_dir)
