"""Many columns' aggregates in one scan, turned into one row per column without leaving the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fused(df: DataFrame, per_column: dict[str, dict[str, Column]], kinds: dict[str, str]) -> DataFrame:
    """One row per column: its name and the fields of ``kinds`` (name: DDL type); a field that a column lacks is null.

    All aggregates run in a single pass; the wide row is then split into structs.
    """
    flat = [agg.alias(f"c{i}_{field}") for i, (_, aggs) in enumerate(per_column.items()) for field, agg in aggs.items()]
    if not flat:
        return df.sparkSession.createDataFrame([], "name string, " + ", ".join(f"{k} {t}" for k, t in kinds.items()))
    rows = []
    for i, (name, aggs) in enumerate(per_column.items()):
        fields = [(F.col(f"c{i}_{k}") if k in aggs else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]
        rows.append(F.struct(F.lit(name).alias("name"), *fields))
    return df.agg(*flat).select(F.inline(F.array(*rows)))


#: The quantiles of a column: field and share.
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def quartiles(c: Column) -> dict[str, Column]:
    """Quartiles by one sketch of bounded size (``exact.quantiles`` has exact ones)."""
    sketch = F.percentile_approx(c, F.array(*map(F.lit, QUARTILES.values())), F.lit(10_000))
    return {field: sketch[i] for i, field in enumerate(QUARTILES)}


def distinct(c: Column) -> Column:
    """The number of distinct values by a sketch of bounded size (``exact.with_distinct`` has exact ones)."""
    return F.approx_count_distinct(c, 0.01)


def at_midnight(ts: Column) -> Column:
    return (F.hour(ts) == 0) & (F.minute(ts) == 0) & (F.date_part(F.lit("second"), ts) == 0)


def whole_seconds(ts: Column) -> Column:
    seconds = F.date_part(F.lit("second"), ts)
    return seconds == F.floor(seconds)


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970, rounded."""
    return F.round(F.unix_micros(ts.cast("timestamp")) / 1000).cast("bigint")
