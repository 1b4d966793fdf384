"""Numeric anomalies: spread and fences in one scan, values outside of them in a second, flags by rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import family
from ..plans.grid import column, logical_types
from .exact import quantiles
from .fused import QUARTILES, fused, quartiles

FIELDS = {
    "count": "bigint", "min": "double", "max": "double", "mean": "double", "std": "double", "p25": "double", "p50": "double", "p75": "double", "zeros": "bigint", "negatives": "bigint",
}
FENCE, EXTREME, SKEW = 1.5, 6.0, 0.2


def spread(df: DataFrame, names: list[str] | None = None, exact: bool = False) -> DataFrame:
    """First pass: FIELDS of every numeric column.  exact: exact quartiles, found by jobs of their own."""
    names = names or [n for n, t in logical_types(df).items() if family(t) == "numeric"]
    known = quantiles(df, {n: column(n).cast("double") for n in names}, tuple(QUARTILES.values())) if exact else {}

    def aggregates(name: str) -> dict[str, Column]:
        d = column(name).cast("double")
        out = {"count": F.count(d), "min": F.min(d), "max": F.max(d), "mean": F.avg(d), "std": F.stddev_samp(d)}
        out |= {f: F.max(F.lit(v)) for f, v in zip(QUARTILES, known[name], strict=True)} if exact else quartiles(d)
        return out | {"zeros": F.count_if(d == 0), "negatives": F.count_if(d < 0)}

    return fused(df, {n: aggregates(n) for n in names}, FIELDS)


def fences(stats: DataFrame) -> DataFrame:
    """The first pass with constant, lo_fence, hi_fence and skew."""
    constant = (F.col("count") == 0) | F.col("std").isNull() | (F.col("std") == 0) | F.coalesce(F.col("min") == F.col("max"), F.lit(False))
    iqr = F.col("p75") - F.col("p25")
    ranged = ~constant & (iqr > 0)
    z = F.try_divide(F.col("mean") - F.col("p50"), F.col("std"))
    return stats.select(
        "*",
        constant.alias("constant"),
        F.when(ranged, F.col("p25") - FENCE * iqr).alias("lo_fence"),
        F.when(ranged, F.col("p75") + FENCE * iqr).alias("hi_fence"),
        F.when(~constant, F.when(z > SKEW, "right").when(z < -SKEW, "left").otherwise("symmetric")).alias("skew"),
    )


def outliers(df: DataFrame, fenced: DataFrame) -> DataFrame:
    """Second pass: name, below and above, the values strictly outside of each column's fences.

    The fences (one row per column) are collected and become literals, so the pass is one scan of aggregates.
    """
    bounds = [(r["name"], r["lo_fence"], r["hi_fence"]) for r in fenced.select("name", "lo_fence", "hi_fence").collect()]
    aggs = {}
    for name, low, high in bounds:
        d = column(name).cast("double")
        aggs[name] = {"below": F.count_if(d < F.lit(low)), "above": F.count_if(d > F.lit(high))} if low is not None else {"below": F.sum(F.lit(0)), "above": F.sum(F.lit(0))}
    return fused(df, aggs, {"below": "bigint", "above": "bigint"}).select("name", F.coalesce("below", F.lit(0).cast("bigint")).alias("below"), F.coalesce("above", F.lit(0).cast("bigint")).alias("above"))


@dataclass(frozen=True)
class Flag:
    column: str
    severity: str
    code: str


def flags_of(s: dict) -> list[Flag]:
    """The flags of one column's statistics, outliers included."""
    name, n = s["name"], s["count"]
    if not n:
        return [Flag(name, "low", "empty")]
    if s["constant"]:
        return [Flag(name, "low", "constant")]
    out = []
    outside = s["below"] + s["above"]
    if outside:
        rate = outside / n
        out.append(Flag(name, "high" if rate >= 0.1 else "medium" if rate >= 0.02 else "low", "outliers"))
    if s["zeros"] >= 0.7 * n:
        out.append(Flag(name, "medium", "zeros"))
    if 0 < s["negatives"] < 0.01 * n:
        out.append(Flag(name, "low", "negatives"))
    iqr = (s["p75"] or 0) - (s["p25"] or 0)
    if iqr > 0:
        out += [Flag(name, "medium", "extreme")] * ((s["max"] > s["p75"] + EXTREME * iqr) + (s["min"] < s["p25"] - EXTREME * iqr))
    return out


def flagged(flags: list[Flag]) -> list[Flag]:
    """Flags worth showing, the severest first."""
    return sorted((f for f in flags if f.code not in ("constant", "empty")), key=lambda f: ("high", "medium", "low").index(f.severity))


def anomalies(df: DataFrame, names: list[str] | None = None, exact: bool = False) -> tuple[list[dict], list[Flag]]:
    """Statistics of every numeric column, and the flags worth showing."""
    fenced = fences(spread(df, names, exact))
    rows = {r["name"]: r.asDict() for r in fenced.collect()}
    if not rows:
        return [], []
    known = df.sparkSession.createDataFrame([(n, r["lo_fence"], r["hi_fence"]) for n, r in rows.items()], "name string, lo_fence double, hi_fence double")
    for r in outliers(df, known).collect():
        rows[r["name"]] |= {"below": r["below"], "above": r["above"]}
    stats = list(rows.values())
    return stats, flagged([f for s in stats for f in flags_of(s)])
