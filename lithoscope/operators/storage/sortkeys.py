"""Sort keys: how far row groups overlap now, and how far they would after a sort."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.types import LogicalType
from ...plans.grid import column
from .rules import Rule, Suggestion

SAMPLE_ROWS, MOST_GROUPS = 1_000_000, 200
SORTED, KEY_RATIO = 0.05, 0.95


def overlap(bounds: list[tuple]) -> float | None:
    """Of (min, max) per group: the share of groups, by their minimum, that begin below the end of the one before."""
    known = sorted((b for b in bounds if b[0] is not None and b[1] is not None), key=lambda b: b[0])
    if len(known) < 2:
        return None
    return sum(b[0] < a[1] for a, b in zip(known, known[1:], strict=False)) / (len(known) - 1)


def overlaps(chunks: DataFrame) -> dict[str, float | None]:
    """For each top-level column that is no struct: the overlap of its chunks' bounds (see ``overlap``), one row for each comes to the driver."""
    known = chunks.where("size(path) = 1")
    number = F.col("min_num").isNotNull()
    out: dict[str, float | None] = {}
    for low, high, kind in (("min_num", "max_num", number), ("min_text", "max_text", ~number)):
        bounds = known.where(kind & F.col(low).isNotNull() & F.col(high).isNotNull()).select("top", F.col(low).alias("low"), F.col(high).alias("high"))
        before = F.lag("high").over(Window.partitionBy("top").orderBy("low", "high"))
        shares = bounds.withColumn("over", F.coalesce(F.col("low") < before, F.lit(False))).groupBy("top").agg(F.count(F.lit(1)).alias("n"), F.count_if("over").alias("k"))
        out |= {r["top"]: r["k"] / (r["n"] - 1) if r["n"] > 1 else None for r in shares.collect()}
    return out


def simulated_groups(df: DataFrame, keys: list[str], measured: str, group_rows: int) -> DataFrame:
    """rg, lo, hi of a column in groups of rows after a sort by keys (nulls last).

    Rows are dealt by ranges of the keys and numbered in their tasks; the tasks' counts (one row for each) are added up.
    """
    order = [F.col(f"k{i}").asc_nulls_last() for i in range(len(keys))]
    rows = df.select(*[column(k).alias(f"k{i}") for i, k in enumerate(keys)], column(measured).alias("sec"))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("sec", F.monotonically_increasing_id().alias("at"))
    # Kept, as numbers and counts have to come from the same dealing.
    placed = placed.select("sec", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("i")).persist(StorageLevel.MEMORY_AND_DISK)
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "part long, start long"))
    numbered = placed.join(offsets, "part").select("sec", F.expr(f"(start + i) DIV {group_rows}").alias("rg"))
    return numbered.groupBy("rg").agg(F.min("sec").alias("lo"), F.max("sec").alias("hi"))


def sampled(df: DataFrame, rows: int, most: int = SAMPLE_ROWS, seed: int = 1) -> DataFrame:
    """All rows if they are few, else ``most`` of them at random."""
    if rows <= most:
        return df
    share = min(1.0, (most + 6 * math.sqrt(most) + 10) / rows)  # a few more, so that it is enough
    return df.sample(False, share, seed).orderBy(F.rand(seed)).limit(most)


def measured_overlap(df: DataFrame, keys: list[str], measured: str, rows: int, groups: int) -> float | None:
    n, groups = min(rows or SAMPLE_ROWS, SAMPLE_ROWS), min(max(groups, 2), MOST_GROUPS)
    found = simulated_groups(sampled(df, rows), keys, measured, max(1, math.ceil(n / groups))).collect()
    return overlap([(r["lo"], r["hi"]) for r in found])


def candidates(types: dict[str, LogicalType], bounds: dict[str, list[tuple] | float | None], probes: dict[str, dict]) -> list[tuple[str, float]]:
    """(column, overlap), the most useful first: no near-keys if others are there, then the least overlap.

    bounds: each column's overlap, or the (min, max) of its chunks.
    """
    found = []
    for name, t in types.items():
        share = bounds.get(name)
        share = overlap(share) if isinstance(share, list) else share
        p = probes.get(name) or {}
        d, n = p.get("distinct"), p.get("num_values")
        if t.kind in ("LIST", "MAP", "STRUCT", "BOOLEAN") or share is None or (d is not None and d <= 1):
            continue
        near_key = bool(d is not None and n and d / n > KEY_RATIO)
        found.append((near_key, share, name))
    return [(name, share) for _, share, name in sorted(found, key=lambda x: x[:2])]


def choose(ranked: list[tuple[str, float]], measure) -> tuple[list[str], dict[str, float]]:
    """The keys of the plan that gains most, and each key's overlap after it.

    measure(keys, column): the overlap of a column after a sort by keys, or None.  Ties go to fewer keys.
    """
    (a, gain_a), *rest = ranked
    plans = [(gain_a, [a], {a: 0.0})]
    if rest:
        b, gain_b = rest[0]
        plans.append((gain_b, [b], {b: 0.0}))
        for first, own, second, other in ((a, gain_a, b, gain_b), (b, gain_b, a, gain_a)):
            after = measure([first, second], second)
            if after is not None:
                plans.append((own + max(0.0, other - after), [first, second], {first: 0.0, second: after}))
    best = max(plans, key=lambda p: (p[0], -len(p[1])))
    return best[1], best[2]


def sort_suggestions(df: DataFrame, types: dict[str, LogicalType], bounds: dict[str, list[tuple] | float | None], probes: dict[str, dict], rows: int, groups: int) -> list[Suggestion]:
    """Keys to sort by, or the remark that the file is sorted; nothing for a single row group."""
    ranked = candidates(types, bounds, probes) if groups >= 2 else []
    if not ranked:
        return []
    name, share = ranked[0]
    if share < SORTED:
        return [Suggestion(f"rowgroup:sort:{name}", "rowgroup", "low", name, f"overlap {share:.0%}", "keep", "Row groups hardly overlap: filters on it skip them already.")]
    keys, after = choose(ranked, lambda k, c: measured_overlap(df, k, c, rows, groups))
    now = dict(ranked)
    out = []
    for rank, key in enumerate(keys):
        better = now[key] - after[key]
        severity = "high" if not rank else "medium" if better > 0.3 else "low"
        label = "sort key" if not rank else "secondary sort key"
        out.append(Suggestion(f"rowgroup:sort:{key}", "rowgroup", severity, key, f"overlap {now[key]:.0%}", label, f"Sorted by {', '.join(keys)}, its overlap would be {after[key]:.0%}.", rule=Rule("sort", (key,), rank=rank)))
    return out
