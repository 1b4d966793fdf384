"""The whole advice for a source: probes, footers, rules, sort keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...plans.grid import categories
from ...sources import footer
from ...sources.catalog import read_source
from . import rules, sortkeys
from .probes import probes, sorted_columns, targets

PROBE_ROWS = 200_000


def measured_group_rows(df: DataFrame, path: str) -> int:
    """Rows per group by writing the first rows as ZSTD and reading the footer back."""
    df.limit(PROBE_ROWS).write.mode("overwrite").option("compression", "zstd").parquet(path)
    spark = df.sparkSession
    size = footer.column_chunks(spark, path).groupBy().sum("compressed").first()[0]
    rows = footer.file_meta(spark, path).groupBy().sum("num_rows").first()[0]
    return rules.target_rows(size, rows)


def advise(spark: SparkSession, path: str, scratch: str, exact: bool = False) -> list[rules.Suggestion]:
    """All suggestions for a Parquet path, in order.  scratch: a folder for the probe of row sizes."""
    df, types, _ = read_source(spark, path)
    found = {r["name"]: r.asDict() for r in probes(df, types, exact).collect()}
    # Of footers the driver sees one row per column, and one for all row groups.
    chunks = footer.column_chunks(spark, path).cache()
    rolled = {r["top"]: r.asDict() for r in footer.column_rollup(chunks).collect()}
    spread = sortkeys.overlaps(chunks)
    sizes = chunks.groupBy("file", "row_group").agg(F.sum("compressed").alias("compressed"))
    s = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("compressed").alias("total"), F.min("compressed").alias("least"), F.max("compressed").alias("most")).first()
    rows = footer.file_meta(spark, path).agg(F.coalesce(F.sum("num_rows"), F.lit(0))).first()[0]
    layout = rules.Layout(s["n"], rows, s["total"] or 0, s["least"] or 0, s["most"] or 0)
    chunks.unpersist()
    out: list[rules.Suggestion] = []
    for where, t in targets(types):
        name = ".".join(where)
        few = categories(df, name) if len(where) == 1 and t.kind == "STRING" and rules.low_cardinality(found[name]) else None
        made = rules.type_suggestion(where, t, found[name], rolled.get(where[0]), few)
        out += [made] if made else []
    ordered = [n for n, t in types.items() if n in rolled and t.kind in ("INT", "FLOAT", "DOUBLE", "DECIMAL")] if layout.groups > 1 else []
    in_order = {r["name"]: r["sorted"] for r in sorted_columns(df, ordered).collect()}
    for name, t in types.items():
        own = rolled.get(name)
        p = found.get(name, {}) | ({"sorted": in_order[name]} if name in in_order else {})
        if own:
            for made in (rules.compression_suggestion(name, own), rules.encoding_suggestion(name, t, p, own), rules.bloom_suggestion(name, t, p, own, bool(own["all_bloom"]))):
                out += [made] if made else []
    out += sortkeys.sort_suggestions(df, types, spread, found, layout.rows, layout.groups)
    out += rules.row_group_suggestions(layout, measured_group_rows(df, f"{scratch}/probe"))
    version = footer.file_meta(spark, path).first()
    written_by_spark = "parquet-mr" in (version["created_by"] or "")
    out += [] if written_by_spark else rules.file_suggestions(version["format_version"])
    return rules.ordered(out)
