"""Data quality: metrics per column in one scan, issues by rules, and scores by dimension."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import NESTED, LogicalType, family
from ..plans.grid import column, logical_types
from .exact import with_distinct
from .fused import distinct, epoch_ms, fused

# Texts that stand for a missing value.
PLACEHOLDERS = ("n/a", "na", "null", "none", "nil", "nan", "unknown", "undefined", "tbd", "-", "--", "?", "(blank)", "(null)")
# Weights of the dimensions and least scores of the grades.
WEIGHTS = {"completeness": 0.35, "validity": 0.35, "uniqueness": 0.20, "freshness": 0.10}
GRADES = ((90, "Excellent"), (75, "Good"), (60, "Fair"), (40, "Poor"))

FIELDS = {
    "family": "string", "kind": "string", "total": "bigint", "count": "bigint", "nulls": "bigint", "distinct": "bigint",
    "empty": "bigint", "blank": "bigint", "untrimmed": "bigint", "distinct_ci": "bigint", "numeric_like": "bigint",
    "jsonish": "bigint", "json_invalid": "bigint", "placeholder": "bigint", "future": "bigint", "max_epoch_ms": "bigint",
}
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity|nan)$"


def numeric_like(text: Column) -> Column:
    return text.rlike(_NUMBER)


def column_metrics(name: str, t: LogicalType, as_of: dt.datetime | None) -> dict[str, Column]:
    c, kind = column(name), family(t)
    out = {"family": F.first(F.lit(kind)), "kind": F.first(F.lit(t.kind)), "total": F.count(F.lit(1)), "count": F.count(c), "nulls": F.count(F.lit(1)) - F.count(c)}
    if t.kind not in NESTED:
        out["distinct"] = distinct(c)
    if t.kind == "STRING":
        trimmed = F.trim(c)
        shaped = trimmed.startswith("{") | trimmed.startswith("[")
        out |= {
            "empty": F.count_if(c == ""),
            "blank": F.count_if(trimmed == ""),
            "untrimmed": F.count_if(c != trimmed),
            "distinct_ci": distinct(F.lower(c)),
            "numeric_like": F.count_if((trimmed != "") & numeric_like(trimmed)),
            "jsonish": F.count_if(shaped),
            "json_invalid": F.count_if(shaped & F.try_parse_json(c).isNull()),
            "placeholder": F.count_if(F.lower(trimmed).isin(*PLACEHOLDERS)),
        }
    elif kind in ("timestamp", "date") and t.unit != "NANOS":
        now = F.lit(as_of).cast("timestamp_ntz") if as_of else F.localtimestamp()
        late = c > now.cast("date") if kind == "date" else c.cast("timestamp_ntz") > now
        out |= {"future": F.count_if(late), "max_epoch_ms": epoch_ms(F.max(c))}
    return out


def metrics(df: DataFrame, types: dict[str, LogicalType] | None = None, as_of: dt.datetime | None = None, exact: bool = False) -> DataFrame:
    """One row per column (FIELDS).  as_of: the time that later values lie in the future of; now by default.  exact: no sketches."""
    types = types or logical_types(df)
    aggs = {n: column_metrics(n, t, as_of) for n, t in types.items()}
    counted = {(n, f): c for n, a in aggs.items() for f, c in (("distinct", column(n)), ("distinct_ci", F.lower(column(n)))) if exact and f in a}
    for n, f in counted:
        aggs[n].pop(f)
    return with_distinct(fused(df, aggs, FIELDS), df, counted)


def duplicate_rows(df: DataFrame, types: dict[str, LogicalType] | None = None) -> DataFrame | None:
    """One row with duplicate_rows = all rows - distinct rows over columns that are not nested; None without any."""
    types = types or logical_types(df)
    simple = [n for n, t in types.items() if t.kind not in NESTED]
    if not simple:
        return None
    # Partial counts per distinct row before the shuffle, so a row that repeats very often is no hot key.
    groups = df.groupBy(*[column(n).alias(f"k{i}") for i, n in enumerate(simple)]).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


@dataclass(frozen=True)
class Issue:
    column: str
    dimension: str
    code: str
    severity: str
    bad: int | None = None


def _by(rate: float, *steps: tuple[float, str], otherwise: str = "low") -> str:
    return next((s for least, s in steps if rate >= least), otherwise)


def issues_of(m: dict) -> list[Issue]:
    """The issues of one column's metrics."""
    name, total, count, nulls = m["name"], m["total"], m["count"], m["nulls"]
    empty, blank = m.get("empty"), m.get("blank")
    spaces = max(0, blank - empty) if blank is not None and empty is not None else 0
    filled = count - (blank or 0)
    found: list[Issue] = []
    add = lambda dimension, code, severity, bad=None: found.append(Issue(name, dimension, code, severity, bad))
    rate = nulls / total if total else 0
    if total and not count:
        add("completeness", "all-null", "high", nulls)
    elif rate >= 0.05:
        add("completeness", "null", _by(rate, (0.5, "high"), (0.2, "medium")), nulls)
    if count:
        if empty:
            add("completeness", "empty", _by(empty / count, (0.2, "medium")), empty)
        if spaces:
            add("completeness", "whitespace", "low", spaces)
        if m.get("placeholder"):
            add("completeness", "placeholder", _by(m["placeholder"] / count, (0.2, "medium")), m["placeholder"])
        padded = max(0, (m.get("untrimmed") or 0) - spaces)
        if padded:
            add("validity", "untrimmed", _by(padded / count, (0.1, "medium")), padded)
        if m.get("distinct_ci") is not None and m["distinct"] > m["distinct_ci"]:
            add("validity", "case", "medium")
        numbers = m.get("numeric_like")
        if numbers is not None and filled >= 10 and 0.9 * filled <= numbers < filled:
            add("validity", "numeric-cast", "medium", filled - numbers)
        if m.get("json_invalid") and filled >= 10 and m["jsonish"] >= 0.8 * filled:
            add("validity", "json", "medium", m["json_invalid"])
        if m.get("future"):
            add("validity", "future", _by(m["future"] / count, (0.05, "medium")), m["future"])
        values = m.get("distinct")
        if values == 1:
            add("uniqueness", "constant", "medium")
        if values is not None and count > 20 and not nulls and 0.95 * count <= values < count:
            add("uniqueness", "near-key", "medium", count - values)
    return found


def duplicate_issue(rows: int | None, total: int) -> list[Issue]:
    return [Issue("(whole row)", "uniqueness", "duplicate", _by(rows / max(1, total), (0.05, "high"), otherwise="medium"), rows)] if rows else []


def clamp(x: float) -> int:
    return max(0, min(100, int(x + 0.5)))


def freshness_score(age_days: float) -> int:
    """Full marks for a week, then a steady fall to half after two years."""
    return 100 if age_days <= 7 else clamp(max(50.0, 100 - (age_days - 7) * 50 / 723))


def grade(score: int) -> str:
    return next((g for least, g in GRADES if score >= least), "Critical")


def scores(columns: list[dict], duplicates: int | None, as_of: dt.datetime) -> dict:
    """Scores of the dimensions (None where not applicable), the overall score and its grade, and the issues."""
    total = max((m["total"] for m in columns), default=0)
    issues = [i for m in columns for i in issues_of(m)] + duplicate_issue(duplicates, total)
    issues.sort(key=lambda i: ("high", "medium", "low").index(i.severity))
    bad = lambda dimension: sum(i.bad or 0 for i in issues if i.dimension == dimension)
    cells, filled = total * len(columns), sum(m["count"] for m in columns)
    cased = sum(i.code == "case" for i in issues)
    checked = any(m["kind"] == "STRING" or m["family"] in ("timestamp", "date") for m in columns)
    constants = sum(m["count"] > 0 and m.get("distinct") == 1 for m in columns)
    near_keys = sum(i.code == "near-key" for i in issues)
    lost = min(45, 220 * duplicates / total) if duplicates and total else 0
    newest = max((m["max_epoch_ms"] for m in columns if m.get("max_epoch_ms") is not None), default=None)
    age = None if newest is None else (as_of - dt.datetime(1970, 1, 1)).total_seconds() / 86_400 - newest / 86_400_000
    dimensions = {
        "completeness": clamp(100 * (1 - bad("completeness") / cells)) if cells else 100,
        "validity": clamp((100 * (1 - bad("validity") / filled) if filled else 100) - min(15, 5 * cased)) if checked else None,
        "uniqueness": clamp(100 - lost - min(25, 5 * constants) - min(15, 5 * near_keys)),
        "freshness": None if age is None else freshness_score(age),
    }
    counted = {d: s for d, s in dimensions.items() if s is not None}
    overall = clamp(sum(WEIGHTS[d] * s for d, s in counted.items()) / sum(WEIGHTS[d] for d in counted))
    keys = [m["name"] for m in columns if m.get("distinct") == m["count"] > 1 and not m["nulls"]]
    return {"dimensions": dimensions, "score": overall, "grade": grade(overall), "issues": issues, "candidate_keys": keys, "age_days": age}


def assess(df: DataFrame, types: dict[str, LogicalType] | None = None, as_of: dt.datetime | None = None, exact: bool = False) -> dict:
    """Metrics, issues and scores of a table: two jobs, of which the driver sees one row per column and one count."""
    types = types or logical_types(df)
    columns = [r.asDict() for r in metrics(df, types, as_of, exact).collect()]
    repeated = duplicate_rows(df, types)
    total = columns[0]["total"] if columns else 0
    rows = repeated.first()[0] if repeated is not None and total else None
    return {"columns": columns, "duplicate_rows": rows, **scores(columns, rows, as_of or dt.datetime.now(dt.UTC).replace(tzinfo=None))}


def issue_frame(df: DataFrame, as_of: dt.datetime | None = None, exact: bool = False) -> DataFrame:
    """The issues of a table as rows."""
    found = assess(df, as_of=as_of, exact=exact)["issues"]
    return df.sparkSession.createDataFrame([(i.column, i.dimension, i.code, i.severity, i.bad) for i in found], "column string, dimension string, code string, severity string, bad bigint")
