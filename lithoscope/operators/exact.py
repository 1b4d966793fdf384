"""Exact distinct counts and quantiles whose state does not grow with the data.

Distinct counts group each column's values by themselves, with partial aggregation before the shuffle.  A quantile is
bracketed by a sketch, whose error is bounded; then the rows below the bracket are counted and the values within it
taken with their counts, so the value at an exact rank is known.  Brackets that hold too many rows are narrowed again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of the sketch, and how far from a quantile it is asked, in shares of the rows (three times its error).
ACCURACY, SLACK = 10_000, 3e-4
#: Rows up to which values are simply kept, and rows of a bracket whose values are taken.
FEW_ROWS, BRACKET_ROWS = 10_000, 100_000
#: Bytes beyond which a text is counted by its digest; a digest with its prefix is longer than that.
DIGEST_BYTES = 64


def counted_by(c: Column, dtype: str) -> Column:
    """What tells values of a column apart: long texts by their SHA-256."""
    if dtype != "string":
        return c
    return F.when(F.octet_length(c) > DIGEST_BYTES, F.concat(F.lit("sha256:"), F.sha2(c, 256))).otherwise(c)


def distinct_counts(df: DataFrame, wanted: dict[tuple[str, str], Column]) -> DataFrame:
    """name, field and n: the number of distinct values that are not null of each column under (name, field).

    One aggregation per column over a scan of that column alone, all in one plan.
    """
    parts = []
    for (name, what), c in wanted.items():
        values = df.select(c.alias("v"))
        values = values.select(counted_by(F.col("v"), values.dtypes[0][1]).alias("v")).where("v is not null")
        parts.append(values.groupBy("v").agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.lit(what).alias("field"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_distinct(stats: DataFrame, df: DataFrame, wanted: dict[tuple[str, str], Column]) -> DataFrame:
    """Statistics (one row per name) with the fields that ``wanted`` names replaced by exact counts; others stay as they are."""
    if not wanted:
        return stats
    fields = list(dict.fromkeys(f for _, f in wanted))
    counts = distinct_counts(df, wanted).groupBy(F.col("name").alias("counted")).agg(*[F.max(F.when(F.col("field") == f, F.col("n"))).alias(f"exact_{f}") for f in fields])
    joined = stats.join(F.broadcast(counts), F.col("name") == F.col("counted"), "left")  # one row per column of the table
    return joined.select(*[(F.coalesce(f"exact_{c}", c).alias(c) if c in fields else F.col(c)) for c in stats.columns])


@dataclass(eq=False)
class _Target:
    """One quantile that is looked for: the ranks that it lies between, and where they are known to be."""

    name: str
    c: Column
    share: float
    n: int
    low: float = -math.inf
    high: float = math.inf
    below: int = 0
    inside: int = 0

    @property
    def at(self) -> float:
        return (self.n - 1) * self.share

    def holds(self) -> bool:
        """Whether the bracket has both ranks."""
        return self.below <= math.floor(self.at) and math.ceil(self.at) < self.below + self.inside

    def within(self) -> Column:
        return (self.c >= F.lit(self.low)) & (self.c <= F.lit(self.high))


def quantiles(df: DataFrame, columns: dict[str, Column], shares: tuple[float, ...]) -> dict[str, list[float | None]]:
    """For each column of doubles its interpolated quantiles, as F.percentile gives them; NaN counts as infinite.

    Collects counts, a sketch's brackets, and at most about BRACKET_ROWS values of a bracket.
    """
    if not columns:
        return {}
    data = df.select(*[F.when(F.isnan(c), F.lit(math.inf)).otherwise(c).alias(f"q{i}") for i, c in enumerate(columns.values())])
    cs = {name: F.col(f"q{i}") for i, name in enumerate(columns)}
    asked = sorted({min(1.0, max(0.0, s + d)) for s in shares for d in (-SLACK, SLACK)})
    first = data.agg(*[x for c in cs.values() for x in (F.count(c), F.percentile_approx(c, F.array(*map(F.lit, asked)), F.lit(ACCURACY)))]).first()
    out: dict[str, list[float | None]] = {}
    few, targets = [], []
    for i, (name, c) in enumerate(cs.items()):
        n, sketch = first[2 * i], first[2 * i + 1]
        if not n:
            out[name] = [None] * len(shares)
        elif n <= FEW_ROWS:
            few.append(name)
        else:
            at = dict(zip(asked, sketch, strict=True))
            targets += [_Target(name, c, s, n, at[min(1.0, max(0.0, s - SLACK))], at[min(1.0, max(0.0, s + SLACK))]) for s in shares]
    if few:
        found = data.agg(*[F.percentile(cs[name], F.array(*map(F.lit, shares))) for name in few]).first()
        out |= {name: list(found[k]) for k, name in enumerate(few)}
    if targets:
        _count(data, targets)
        for t in targets:
            if not t.holds():
                t.low, t.high, t.below, t.inside = -math.inf, math.inf, 0, t.n
        wide = [t for t in targets if t.inside > BRACKET_ROWS]
        while wide:  # each turn leaves fewer rows in every bracket that stays here
            wide = [t for t in _narrowed(data, wide) if t.inside > BRACKET_ROWS]
        values = _values(data, targets)
        for t in targets:
            out.setdefault(t.name, []).append(_at_rank(t, values[t.name, t.share]))
    return {name: out[name] for name in columns}


def _count(data: DataFrame, targets: list[_Target]) -> None:
    """The rows below and within each bracket."""
    found = data.agg(*[x for t in targets for x in (F.count_if(t.c < F.lit(t.low)), F.count_if(t.within()))]).first()
    for k, t in enumerate(targets):
        t.below, t.inside = found[2 * k], found[2 * k + 1]


def _narrowed(data: DataFrame, wide: list[_Target]) -> list[_Target]:
    """Ask a sketch of each bracket's rows again; the targets whose brackets have become narrower, others are as before."""
    shares = [[min(1.0, max(0.0, (t.at - t.below) / t.inside + d)) for d in (-SLACK, SLACK)] for t in wide]
    found = data.agg(*[F.percentile_approx(F.when(t.within(), t.c), F.array(*map(F.lit, s)), F.lit(ACCURACY)) for t, s in zip(wide, shares, strict=True)]).first()
    before = [(t.low, t.high, t.below, t.inside) for t in wide]
    for t, (low, high) in zip(wide, found, strict=True):
        t.low, t.high = low, high
    _count(data, wide)
    better = [t for t, b in zip(wide, before, strict=True) if t.holds() and t.inside < b[3]]
    for t, b in zip(wide, before, strict=True):
        if t not in better:
            t.low, t.high, t.below, t.inside = b
    return better


def _values(data: DataFrame, targets: list[_Target]) -> dict[tuple[str, float], list[tuple[float, int]]]:
    """The distinct values of each bracket with their counts, in order."""
    hits = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.when(t.within(), t.c).alias("v")) for k, t in enumerate(targets)]), lambda x: x["v"].isNotNull())
    rows = data.select(F.explode(hits).alias("x")).groupBy("x.k", "x.v").agg(F.count(F.lit(1)).alias("n")).collect()
    out: dict[tuple[str, float], list[tuple[float, int]]] = {(t.name, t.share): [] for t in targets}
    for r in sorted(rows, key=lambda r: r["v"]):
        out[targets[r["k"]].name, targets[r["k"]].share].append((r["v"], r["n"]))
    return out


def _at_rank(t: _Target, values: list[tuple[float, int]]) -> float:
    """The value at the target's rank, between two of them in proportion."""
    picked, seen = [], t.below
    ranks = [math.floor(t.at), math.ceil(t.at)]
    for v, n in values:
        while len(picked) < 2 and ranks[len(picked)] < seen + n:
            picked.append(v)
        seen += n
    low, high = picked
    return low if low == high else low + (high - low) * (t.at - ranks[0])
