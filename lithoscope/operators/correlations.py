"""Pearson correlations of all pairs of numeric and boolean columns in one scan.

Every task turns its rows into the moments of all pairs by products of matrices, over the rows in which both columns
are present; moments of tasks are joined around the pairs' common means, so no sum grows large and cancels out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import family
from ..plans.grid import column, logical_types

MOST_COLUMNS = 30
REDUNDANT, NOTABLE, MOST_INSIGHTS = 0.95, 0.7, 8
#: Least absolute value of each strength.
STRENGTHS = ((0.9, "very strong"), (0.7, "strong"), (0.4, "moderate"), (0.2, "weak"))


def eligible(df: DataFrame) -> list[str]:
    return [n for n, t in logical_types(df).items() if family(t) in ("numeric", "boolean")]


def as_double(name: str, t) -> Column:
    return column(name).cast("int").cast("double") if t.kind == "BOOLEAN" else column(name).cast("double")


#: Of the rows of a task in which both columns are present: their number, means, centred sums, and whether both vary.
MOMENTS = "a int, b int, n bigint, mean_a double, mean_b double, aa double, bb double, ab double, odd boolean, low_a double, high_a double, low_b double, high_b double"


class _Moments:
    """Sums over pairs of k columns, taken around each column's first value."""

    def __init__(self, k: int):
        self.shift = np.full(k, np.nan)
        self.n, self.sums, self.squares, self.products, self.odd = (np.zeros((k, k)) for _ in range(5))
        self.low, self.high = np.full((k, k), np.inf), np.full((k, k), -np.inf)  # of the first column of a pair

    def add(self, values: np.ndarray, present: np.ndarray) -> None:
        """k rows of values, and where they are present."""
        finite = present & np.isfinite(values)
        for i in np.flatnonzero(np.isnan(self.shift) & finite.any(1)):
            self.shift[i] = values[i, finite[i].argmax()]
        here = present.astype(float)
        x = np.where(finite, values - np.nan_to_num(self.shift)[:, None], 0.0)
        self.n += here @ here.T
        self.sums += x @ here.T
        self.squares += (x * x) @ here.T
        self.products += x @ x.T
        strange = (present & ~finite).astype(float)
        if strange.any():
            self.odd += strange @ here.T
        for j in range(len(values)):  # ranges of all columns where column j is present
            if not present[j].any():
                continue
            rows = slice(None) if present[j].all() else present[j]
            self.low[:, j] = np.minimum(self.low[:, j], np.where(finite[:, rows], values[:, rows], np.inf).min(1))
            self.high[:, j] = np.maximum(self.high[:, j], np.where(finite[:, rows], values[:, rows], -np.inf).max(1))

    def rows(self) -> list[np.ndarray]:
        """The columns of MOMENTS, one row for each pair of columns that share rows."""
        a, b = np.nonzero(np.triu(self.n > 0, 1))
        n = self.n[a, b]
        sa, sb = self.sums[a, b], self.sums[b, a]
        shift = np.nan_to_num(self.shift)
        return [
            a.astype(np.int32), b.astype(np.int32), n.astype(np.int64), shift[a] + sa / n, shift[b] + sb / n,
            np.maximum(0, self.squares[a, b] - sa * sa / n), np.maximum(0, self.squares[b, a] - sb * sb / n), self.products[a, b] - sa * sb / n,
            (self.odd[a, b] + self.odd[b, a]) > 0, self.low[a, b], self.high[a, b], self.low[b, a], self.high[b, a],
        ]


def _moments(df: DataFrame) -> DataFrame:
    """MOMENTS of each task's rows of columns of doubles."""
    import pyarrow as pa

    k, names = len(df.columns), [f.split(" ")[0] for f in MOMENTS.split(", ")]

    def run(batches):
        found = _Moments(k)
        for batch in batches:
            if batch.num_rows:
                present = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
                found.add(np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]), present)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.rows()], names=names)

    return df.mapInArrow(run, MOMENTS)


def correlations(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(a, b, r) for every pair a before b of the first MOST_COLUMNS eligible columns.

    r is over the rows where both are present; null where either does not vary there, NaN where either holds
    a value that is not finite.
    """
    types = logical_types(df)
    names = (names or eligible(df))[:MOST_COLUMNS]
    spark = df.sparkSession
    pairs = [(i, j, a, b) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    if not pairs:
        return spark.createDataFrame([], "a string, b string, r double")
    parts = _moments(df.select(*[as_double(n, types[n]).alias(f"x{i}") for i, n in enumerate(names)]))
    # One row per task and pair: the means that all of a pair's rows share, counted from its least mean.
    pair = Window.partitionBy("a", "b")
    away = [F.col(f"mean_{x}") - F.min(f"mean_{x}").over(pair) for x in "ab"]
    parts = parts.withColumns({"da": away[0], "db": away[1]})
    parts = parts.withColumns({f"d{x}": F.col(f"d{x}") - F.sum(F.col("n") * F.col(f"d{x}")).over(pair) / F.sum("n").over(pair) for x in "ab"})
    total = lambda own, x, y: F.sum(F.col(own) + F.col("n") * F.col(f"d{x}") * F.col(f"d{y}"))
    vary = (F.min("low_a") < F.max("high_a")) & (F.min("low_b") < F.max("high_b"))
    sums = parts.groupBy("a", "b").agg(total("aa", "a", "a").alias("aa"), total("bb", "b", "b").alias("bb"), total("ab", "a", "b").alias("ab"), vary.alias("vary"), F.bool_or("odd").alias("odd"))
    r = F.when(F.col("vary") & ~F.col("odd"), F.try_divide("ab", F.sqrt(F.col("aa")) * F.sqrt(F.col("bb"))))
    found = sums.select(F.col("a").alias("i"), F.col("b").alias("j"), F.when(F.col("odd"), F.lit(float("nan"))).otherwise( F.when(F.abs(r) > 1, F.signum(r)).otherwise(r)).alias("r"))
    named = spark.createDataFrame(pairs, "i int, j int, a string, b string")
    return named.join(F.broadcast(found), ["i", "j"], "left").select("a", "b", "r")  # at most a row for each pair


def ranked(pairs: DataFrame) -> DataFrame:
    """Finite pairs, strongest first, with strength and redundancy."""
    size = F.abs("r")
    strength = F.lit("negligible")
    for least, label in reversed(STRENGTHS):
        strength = F.when(size >= least, label).otherwise(strength)
    finite = pairs.where(F.col("r").isNotNull() & ~F.isnan("r"))
    return finite.select("a", "b", "r", strength.alias("strength"), (size >= REDUNDANT).alias("redundant")).orderBy(F.desc(size), "a", "b")


def insights(pairs: DataFrame) -> DataFrame:
    """The strongest pairs that are worth a remark."""
    return ranked(pairs).where(F.abs("r") >= NOTABLE).limit(MOST_INSIGHTS)


def matrix(pairs: list[tuple], names: list[str]) -> list[list[float | None]]:
    """The symmetric matrix of collected pairs, with ones on its diagonal."""
    at = {n: i for i, n in enumerate(names)}
    out: list[list[float | None]] = [[1.0 if i == j else None for j in range(len(names))] for i in range(len(names))]
    for a, b, r in pairs:
        out[at[a]][at[b]] = out[at[b]][at[a]] = r
    return out
