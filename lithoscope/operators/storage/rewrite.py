"""Apply selected suggestions as one rewrite, report on it, and print the script that does the same."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.types import LogicalType
from ...plans.grid import column, logical_types
from ...sources import footer
from .rules import Suggestion


@dataclass
class Plan:
    """What the selected suggestions ask of a rewrite."""

    casts: dict[tuple[str, ...], str] = field(default_factory=dict)
    sort: list[str] = field(default_factory=list)
    group_rows: int | None = None
    bloom: list[str] = field(default_factory=list)
    delta: list[str] = field(default_factory=list)
    run_length: list[str] = field(default_factory=list)
    recompressed: bool = False
    dictionary: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def plan_of(suggestions: list[Suggestion], selected: set[str], types: dict[str, LogicalType]) -> Plan:
    """The plan of the selected suggestions; what the writer cannot do becomes a note."""
    plan, ranks = Plan(), []
    for s in suggestions:
        r = s.rule
        if not r or s.id not in selected:
            continue
        match r.kind:
            case "cast":
                t = types.get(r.path[0])
                if s.suggested.startswith("TIMESTAMP(MILLIS"):
                    plan.notes.append(f"{'.'.join(r.path)} stays at microseconds: the writer has no coarser unit for it")
                    if t is not None and t.kind == "TIMESTAMP" and t.unit == "MICROS":
                        continue  # nothing would change
                plan.casts[r.path] = r.ddl
            case "sort":
                ranks.append((r.rank, r.path[0]))
            case "row_group":
                plan.group_rows = r.rows
            case "bloom":
                plan.bloom.append(r.path[0])
            case "compression":
                plan.recompressed = True
            case "categorical" | "enum":
                plan.dictionary.append(r.path[0])
                if r.kind == "enum":
                    plan.notes.append(f"{r.path[0]} stays text, dictionary-encoded: the writer has no enumerations")
            case "encoding":
                name, t = r.path[0], types.get(r.path[0])
                if r.encoding.startswith("DELTA") and (t is None or t.kind == "INT"):
                    plan.delta.append(name)
                elif r.encoding == "RLE":
                    plan.run_length.append(name)
                else:
                    plan.notes.append(f"{name} keeps its encoding: the writer has {r.encoding} for whole numbers only")
    plan.sort = list(dict.fromkeys(name for _, name in sorted(ranks)))
    plan.notes += [f"{n} is written at microseconds instead of milliseconds" for n, t in types.items() if t.kind == "TIMESTAMP" and t.unit == "MILLIS" and (n,) not in plan.casts]
    plan.dictionary = [n for n in dict.fromkeys(plan.dictionary) if n not in plan.delta]
    return plan


def options_of(plan: Plan, distinct: dict[str, int] | None = None) -> dict[str, str]:
    """The writer's options for a plan.  distinct: numbers of values, for the sizes of Bloom filters."""
    # Delta and run-length encodings are the second format's; a dictionary would come before them.
    out = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0" if plan.delta or plan.run_length else "PARQUET_1_0"}
    if plan.group_rows:
        out |= {"parquet.block.row.count.limit": str(plan.group_rows), "parquet.block.size": str(1 << 30)}
    out |= {f"parquet.enable.dictionary#{n}": "true" for n in plan.dictionary} | {f"parquet.enable.dictionary#{n}": "false" for n in plan.delta}
    for n in plan.bloom:
        out |= {f"parquet.bloom.filter.enabled#{n}": "true", f"parquet.bloom.filter.expected.ndv#{n}": str((distinct or {}).get(n) or 1_000_000)}
    return out


def _casted(c: Column, ddl: str, t: LogicalType | None) -> Column:
    if t is not None and t.kind == "TIMESTAMP" and t.unit == "NANOS" and ddl.startswith(("timestamp", "date")):
        micros = F.timestamp_micros((c / 1000).cast("bigint"))  # carried as nanoseconds
        return micros.cast(ddl)
    return c.cast(ddl)


def transformed(df: DataFrame, plan: Plan, types: dict[str, LogicalType] | None = None) -> DataFrame:
    """The rows with all casts applied (struct leaves in place), in the order of the sort keys, nulls last."""
    types = types or logical_types(df)
    changes: dict[str, Column] = {}
    for path, ddl in plan.casts.items():
        if len(path) == 1:
            changes[path[0]] = _casted(column(path[0]), ddl, types.get(path[0]))
        else:
            root, leaf = path[0], column(path[0])
            for name in path[1:]:
                leaf = leaf.getField(name)
            before = changes.get(root, column(root))
            changes[root] = before.withField(".".join(f"`{n}`" for n in path[1:]), leaf.cast(ddl))
    out = df.select(*[changes.get(n, column(n)).alias(n) for n in df.columns])
    return out


def write(df: DataFrame, plan: Plan, path: str, distinct: dict[str, int] | None = None, partitions: int | None = None) -> None:
    """Write as ZSTD.  A sort is by ranges of the keys: files follow one another, each sorted within."""
    if plan.sort:
        order = [column(n).asc_nulls_last() for n in plan.sort]
        ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
        df = ranged.sortWithinPartitions(*order)
    df.write.mode("overwrite").options(**options_of(plan, distinct)).parquet(path)


@dataclass(frozen=True)
class Report:
    original_bytes: int
    optimized_bytes: int
    original_groups: int
    optimized_groups: int
    notes: tuple[str, ...] = ()

    @property
    def saved_bytes(self) -> int:
        return self.original_bytes - self.optimized_bytes

    @property
    def saved_percent(self) -> float:
        return 100 * self.saved_bytes / self.original_bytes if self.original_bytes > 0 else 0.0


def remarks(plan: Plan) -> tuple[str, ...]:
    """Why reads get faster."""
    out = []
    if plan.sort:
        out.append(f"sorted by {', '.join(plan.sort)}: filters on them skip row groups")
    if plan.casts:
        out.append(f"{len(plan.casts)} narrower column(s): less to read")
    if plan.recompressed:
        out.append("ZSTD: fewer bytes to read")
    if plan.group_rows:
        out.append(f"row groups of {plan.group_rows:,} rows")
    if plan.dictionary:
        out.append(f"{len(plan.dictionary)} dictionary-encoded column(s): faster equality filters")
    if plan.delta or plan.run_length:
        out.append(f"{len(plan.delta) + len(plan.run_length)} column(s) in delta or run-length encoding: fewer bytes")
    if plan.bloom:
        out.append(f"Bloom filters on {', '.join(plan.bloom)}: faster look-ups")
    return tuple(out + plan.notes)


def sizes(spark, path: str) -> tuple[int, int]:
    """Compressed bytes and row groups under a path."""
    r = footer.row_groups(spark, path).selectExpr("coalesce(sum(compressed), 0) b", "count(*) n").first()
    return int(r["b"]), int(r["n"])


def rewrite(df: DataFrame, source: str, target: str, suggestions: list[Suggestion], selected: set[str] | None = None, types: dict[str, LogicalType] | None = None, partitions: int | None = None) -> Report:
    """Apply the suggestions (all actionable ones by default) and compare footers before and after."""
    types = types or logical_types(df)
    chosen = selected if selected is not None else {s.id for s in suggestions if s.rule}
    plan = plan_of(suggestions, chosen, types)
    write(transformed(df, plan, types), plan, target, partitions=partitions)
    (before, groups_before), (after, groups_after) = sizes(df.sparkSession, source), sizes(df.sparkSession, target)
    return Report(before, after, groups_before, groups_after, remarks(plan))


def script(plan: Plan, source: str, target: str) -> str:
    """A PySpark script of the plan."""
    lines = ["from pyspark.sql import SparkSession, functions as F", "", "spark = SparkSession.builder.getOrCreate()", 'spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")', f"df = spark.read.parquet({source!r})"]
    for path, ddl in plan.casts.items():
        name, quoted = path[0], "`" + path[0].replace("`", "``") + "`"
        if len(path) == 1:
            lines.append(f"df = df.withColumn({name!r}, F.col({quoted!r}).cast({ddl!r}))")
        else:
            inner = ".".join(f"`{n}`" for n in path[1:])
            full = f"{quoted}.{inner}"
            lines.append(f"df = df.withColumn({name!r}, F.col({quoted!r}).withField({inner!r}, F.col({full!r}).cast({ddl!r})))")
    if plan.sort:
        keys = ", ".join(f"F.col({('`' + n + '`')!r}).asc_nulls_last()" for n in plan.sort)
        lines.append(f"df = df.repartitionByRange({keys}).sortWithinPartitions({keys})")
    lines.append("writer = df.write.mode('overwrite')")
    lines += [f"writer = writer.option({k!r}, {v!r})" for k, v in options_of(plan).items()]
    lines.append(f"writer.parquet({target!r})")
    return "\n".join([*lines, *(f"# {n}" for n in plan.notes)]) + "\n"
