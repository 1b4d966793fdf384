"""The grid: project, filter, quick-filter, sort, page and count, as lazy DataFrames."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import TEXT_KINDS, LogicalType, from_spark, legal_ops, literal_ddl

PAGE_SIZES, PAGE_SIZE = (10, 50, 100, 500), 100
CATEGORIES = 50


@dataclass(frozen=True)
class Filter:
    """An operation on one column, with up to two bounds as text."""

    op: str
    v1: str | None = None
    v2: str | None = None


def column(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def logical_types(df: DataFrame) -> dict[str, LogicalType]:
    return {f.name: from_spark(f.dataType, f.metadata) for f in df.schema}


def _ilike(c: Column, text: str) -> Column:
    # Backslashes stand for themselves; % and _ stay wildcards.
    return c.cast("string").ilike(f"%{text.replace(chr(92), chr(92) * 2)}%")


def predicate(name: str, t: LogicalType, f: Filter) -> Column | None:
    """The filter as a boolean column; None where a needed bound is empty."""
    c = column(name)
    bound = lambda v: F.lit(v).cast(ddl) if (ddl := literal_ddl(t)) else F.lit(v)
    if f.op not in ("contains", *legal_ops(t)) and f.op not in ("is_null", "is_not_null"):
        raise ValueError(f"{f.op} does not apply to {name} of type {t.kind}")
    match f.op:
        case "is_null":
            return c.isNull()
        case "is_not_null":
            return c.isNotNull()
        case "is_true" | "is_false":
            return c == F.lit(f.op == "is_true")
    if f.v1 in (None, ""):
        return None
    match f.op:
        case "contains":
            return _ilike(c, f.v1)
        case "between":
            return None if f.v2 in (None, "") else c.between(bound(f.v1), bound(f.v2))
        case "eq":
            return c == bound(f.v1)
        case "neq":
            return c != bound(f.v1)
        case "lt":
            return c < bound(f.v1)
        case "lte":
            return c <= bound(f.v1)
        case "gt":
            return c > bound(f.v1)
        case "gte":
            return c >= bound(f.v1)
    raise ValueError(f"unknown filter operation {f.op}")


def where(df: DataFrame, filters: dict[str, Filter] | None = None, quick: str | None = None) -> DataFrame:
    """Rows that pass all column filters and hold the quick text in any text column, hidden ones included."""
    types = logical_types(df)
    parts = [p for name, f in (filters or {}).items() if name in types and (p := predicate(name, types[name], f)) is not None]
    text = (quick or "").strip()
    searched = [n for n, t in types.items() if t.kind in TEXT_KINDS]
    if text and searched:
        parts.append(reduce(Column.__or__, (_ilike(column(n), text) for n in searched)))
    return df.where(reduce(Column.__and__, parts)) if parts else df


def order(df: DataFrame, sort: list[tuple[str, bool]]) -> DataFrame:
    """Sort by (name, descending) keys that exist, nulls last either way."""
    keys = [column(n).desc_nulls_last() if desc else column(n).asc_nulls_last() for n, desc in sort if n in df.columns]
    return df.orderBy(*keys) if keys else df


def project(df: DataFrame, visible: list[str] | None) -> DataFrame:
    names = [n for n in df.columns if visible is None or n in visible]
    return df.select(*map(column, names)) if names else df


def page(df: DataFrame, number: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """Rows number*size .. (number+1)*size; with a sort before it, a top-k by partition rather than a full sort."""
    return df.offset(number * size).limit(size) if number else df.limit(size)


def query(df: DataFrame, visible: list[str] | None = None, filters: dict[str, Filter] | None = None, quick: str | None = None, sort: list[tuple[str, bool]] = (), number: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """One page of the grid."""
    return page(project(order(where(df, filters, quick), list(sort)), visible), number, size)


def count(df: DataFrame, filters: dict[str, Filter] | None = None, quick: str | None = None) -> DataFrame:
    """One row with n, the rows that pass."""
    return where(df, filters, quick).agg(F.count(F.lit(1)).alias("n"))


def pages(total: int, size: int = PAGE_SIZE) -> int:
    return max(1, math.ceil(total / size))


def cycle_sort(sort: list[tuple[str, bool]], name: str, append: bool = False) -> list[tuple[str, bool]]:
    """The next sort after a click on a column: ascending, descending, none; with append, other keys stay."""
    current = dict(sort).get(name)
    following = [(name, False)] if current is None else [(name, True)] if current is False else []
    if not append:
        return following
    if current is None:
        return [*sort, *following]
    return [s for old in sort for s in (following if old[0] == name else [old])]


@dataclass(frozen=True)
class GridState:
    """What the grid shows; every change of filters, sort or size goes back to the first page."""

    filters: tuple[tuple[str, Filter], ...] = ()
    quick: str = ""
    sort: tuple[tuple[str, bool], ...] = ()
    number: int = 0
    size: int = PAGE_SIZE

    def change(self, **changes) -> GridState:
        kept = {**self.__dict__, **changes}
        if any(k != "number" for k in changes):
            kept["number"] = changes.get("number", 0)
        return GridState(**kept)

    def run(self, df: DataFrame, visible: list[str] | None = None) -> DataFrame:
        return query(df, visible, dict(self.filters), self.quick, list(self.sort), self.number, self.size)


def top_values(df: DataFrame, name: str, n: int = 10) -> DataFrame:
    """The n most frequent non-null values (value, c); ties by value.  Nested values are shown as JSON."""
    shown = F.to_json(column(name)) if df.select(column(name)).dtypes[0][1].startswith(("array", "map", "struct")) else column(name)
    counts = df.where(column(name).isNotNull()).groupBy(shown.alias("value")).agg(F.count(F.lit(1)).alias("c"))
    return counts.orderBy(F.desc("c"), F.asc("value")).limit(n)


def distinct_values(df: DataFrame, name: str, n: int = CATEGORIES + 1) -> DataFrame:
    """The first n distinct non-null values in order."""
    return df.select(column(name).alias("value")).where("value is not null").distinct().orderBy("value").limit(n)


def categories(df: DataFrame, name: str) -> tuple[list, bool]:
    """Up to CATEGORIES values, and whether there are more."""
    found = [r[0] for r in distinct_values(df, name).collect()]
    return found[:CATEGORIES], len(found) > CATEGORIES
