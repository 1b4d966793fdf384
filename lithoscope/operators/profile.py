"""Column statistics by family, histograms, and the tally of types."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import LogicalType, chip, family
from ..plans.grid import column, logical_types, top_values
from .exact import quantiles, with_distinct
from .fused import QUARTILES, at_midnight, distinct, epoch_ms, fused, quartiles, whole_seconds

FIELDS = {
    "family": "string", "total": "bigint", "count": "bigint", "nulls": "bigint", "distinct": "bigint",
    "num_min": "double", "num_max": "double", "mean": "double", "std": "double", "p25": "double", "p50": "double", "p75": "double",
    "min_len": "bigint", "max_len": "bigint", "avg_len": "double", "str_min": "string", "str_max": "string",
    "range_ms": "bigint", "range_days": "bigint", "whole_seconds": "boolean", "midnight": "boolean", "true_count": "bigint",
    "list_min": "bigint", "list_max": "bigint", "list_avg": "double", "granularity": "string",
}
BINS, HOURS = 20, 24
TOP_K, TOP_K_DISTINCT = 10, 50


def column_aggregates(name: str, t: LogicalType, known: list[float | None] | None = None) -> dict[str, Column]:
    """The aggregates of one column's family.  known: its exact quartiles; sketches without."""
    c, kind = column(name), family(t)
    out = {"family": F.first(F.lit(kind)), "total": F.count(F.lit(1)), "count": F.count(c), "nulls": F.count(F.lit(1)) - F.count(c)}
    bounds = lambda x: {"str_min": F.min(x).cast("string"), "str_max": F.max(x).cast("string")}
    match kind:
        case "numeric":
            out |= {"distinct": distinct(c), "num_min": F.min(c).cast("double"), "num_max": F.max(c).cast("double"), "mean": F.avg(c).cast("double"), "std": F.stddev_samp(c)}
            out |= {f: F.max(F.lit(v)) for f, v in zip(QUARTILES, known, strict=True)} if known else quartiles(c.cast("double"))
        case "string" | "json":
            length = F.octet_length(c) if t.kind in ("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY", "BSON") else F.length(c)
            shown = F.hex(c) if t.kind in ("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY", "BSON") else c
            out |= {"distinct": distinct(c), "min_len": F.min(length), "max_len": F.max(length), "avg_len": F.avg(length), **bounds(shown)}
        case "enum" | "uuid" | "time":
            out |= {"distinct": distinct(c), **bounds(c)}
        case "timestamp":
            ts = F.timestamp_micros((c / 1000).cast("bigint")) if t.unit == "NANOS" else c
            out |= {"distinct": distinct(c), **bounds(ts), "range_ms": epoch_ms(F.max(ts)) - epoch_ms(F.min(ts)), "whole_seconds": F.bool_and(whole_seconds(ts)), "midnight": F.bool_and(at_midnight(ts))}
            out["granularity"] = F.when(out["midnight"], "date-only").when(out["whole_seconds"], "second-level").when(F.count(c) > 0, "sub-second")
        case "date":
            out |= {"distinct": distinct(c), **bounds(c), "range_days": F.date_diff(F.max(c), F.min(c))}
        case "boolean":
            out |= {"true_count": F.count_if(c)}
        case "list" | "map":
            size = F.when(c.isNotNull(), F.size(c))
            out |= {"list_min": F.min(size), "list_max": F.max(size), "list_avg": F.avg(size)}
    return out


def describe(df: DataFrame, types: dict[str, LogicalType] | None = None, exact: bool = False) -> DataFrame:
    """One row per column (FIELDS), from one scan.

    exact: exact distinct counts and quartiles instead of sketches, which takes further scans of single columns;
    the quartiles are found at once, by jobs of their own.
    """
    types = types or logical_types(df)
    known = quantiles(df, {n: column(n).cast("double") for n, t in types.items() if family(t) == "numeric"}, tuple(QUARTILES.values())) if exact else {}
    aggs = {n: column_aggregates(n, t, known.get(n)) for n, t in types.items()}
    counted = {(n, "distinct"): column(n) for n, a in aggs.items() if exact and "distinct" in a}
    for n, _ in counted:
        aggs[n].pop("distinct")
    return with_distinct(fused(df, aggs, FIELDS), df, counted)


def _binned(df: DataFrame, value: Column, bins: int, low: float, high: float) -> DataFrame:
    """bin (1..bins), lo, hi, n of the non-empty bins; each bin's upper edge is its own, the first holds the minimum."""
    width = F.lit((high - low) / bins)
    number = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((value - F.lit(low)) / width))).cast("int")
    counts = df.where(value.isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", (F.lit(low) + (F.col("bin") - 1) * width).alias("lo"), (F.lit(low) + F.col("bin") * width).alias("hi"), "n")


def histogram(df: DataFrame, name: str, t: LogicalType | None = None, bins: int = BINS) -> DataFrame | None:
    """Equal-width bins of a numeric, timestamp or date column (epoch milliseconds), or hours of a time column.

    None where there is nothing to spread: no values, or a single one.
    """
    t = t or logical_types(df)[name]
    c = column(name)
    kind = family(t)
    if kind == "time":
        hour = F.hour(c) if t.unit and not t.utc else F.floor(c / 3_600_000_000)
        counts = df.where(c.isNotNull()).groupBy(hour.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        return counts.select("bin", F.col("bin").cast("double").alias("lo"), (F.col("bin") + 1).cast("double").alias("hi"), "n")
    if kind == "numeric":
        value = c.cast("double")
    elif kind in ("timestamp", "date"):
        value = epoch_ms(c).cast("double")
    else:
        raise ValueError(f"no histogram for {name} of type {t.kind}")
    value = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None or not high > low:
        return None
    return _binned(df, value, bins, low, high)


def histogram_json(df: DataFrame, name: str, t: LogicalType | None = None, bins: int = BINS) -> DataFrame | None:
    """One row with histogram: the counts of the non-empty bins as one JSON object, by number; None where there is nothing to spread."""
    made = histogram(df, name, t, bins)
    return made and made.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bin", "n"))))).alias("histogram"))


def charts(df: DataFrame, types: dict[str, LogicalType] | None = None, exact: bool = False) -> dict[str, DataFrame]:
    """A histogram or top values for each column that has any."""
    types = types or logical_types(df)
    out = {}
    for r in describe(df, types, exact).collect():
        t = types[r["name"]]
        if family(t) in ("numeric", "timestamp", "date", "time"):
            made = histogram(df, r["name"], t)
            if made is not None:
                out[r["name"]] = made
        elif t.kind == "ENUM" or (family(t) in ("string", "json") and 1 <= (r["distinct"] or 0) <= TOP_K_DISTINCT):
            out[r["name"]] = top_values(df, r["name"], TOP_K)
    return out


def type_tally(types: dict[str, LogicalType]) -> list[tuple[str, int]]:
    """Labels and how many columns have them, most first, then by label."""
    return sorted(Counter(chip(t) for t in types.values()).items(), key=lambda x: (-x[1], x[0]))
