"""Parquet footers as DataFrames: schema nodes, column chunks, row groups, key-values, files, and their rollups.

Footers are read by tasks, one row per file in, a few rows per column chunk out, so a dataset of many files
is as distributed as its data.  Paths of columns are lists, so a dot in a name and equal leaf names of
different structs stay apart, and bounds are compared by type rather than as text.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formatting import format_kv
from . import thrift

CHUNKS = (
    "file string, row_group int, ordinal int, path array<string>, top string, physical string, codec string, encodings array<string>, "
    "compressed bigint, uncompressed bigint, num_values bigint, nulls bigint, distinct bigint, min_text string, max_text string, min_num double, max_num double, bloom boolean"
)
GROUPS = "file string, row_group int, num_rows bigint, uncompressed bigint"
FILES = "file string, created_by string, num_rows bigint, num_row_groups int, format_version string, footer_bytes bigint, num_columns int, kv array<struct<key:string,value:string>>"
NODES = (
    "file string, ordinal int, path array<string>, name string, physical string, length int, repetition string, num_children int, converted string, precision int, scale int, field_id int, "
    "logical string, max_definition int, max_repetition int"
)


def raw_footer(path: str) -> bytes:
    """The encoded footer of a file, on any file system that pyarrow knows."""
    import pyarrow.fs as pafs

    uri = path if "://" in path else "file://" + path.removeprefix("file:") if path.startswith("file:") else None
    fs, inner = pafs.FileSystem.from_uri(uri) if uri else (pafs.LocalFileSystem(), path)
    with fs.open_input_file(inner) as f:
        end = f.size()
        f.seek(max(0, end - 8))
        tail = f.read(8)
        n = int.from_bytes(tail[:4], "little")
        if tail[4:] != thrift.MAGIC or n > end - 12:
            raise ValueError(f"{path} is no Parquet file")
        f.seek(end - 8 - n)
        return f.read(n)


def metadata(footer: bytes):
    """pyarrow's view of an encoded footer."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    return pq.ParquetFile(pa.BufferReader(thrift.MAGIC + footer + len(footer).to_bytes(4, "little") + thrift.MAGIC)).metadata


def open_footer(path: str):
    """pyarrow's footer of a file."""
    return metadata(raw_footer(path))


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The data files under a path, as Spark lists them."""
    return sorted(spark.read.schema("lithoscope_none int").parquet(path).inputFiles())


def paths_of_columns(meta) -> list[list[str]]:
    """Each leaf's path as a list: pyarrow joins names by dots, so the schema is walked instead."""
    found: list[list[str]] = []

    def walk(at: list[str], kind) -> None:
        import pyarrow.types as pt

        if pt.is_struct(kind):
            for i in range(kind.num_fields):
                walk([*at, kind.field(i).name], kind.field(i).type)
        elif pt.is_map(kind):
            walk([*at, "key_value", "key"], kind.key_type)
            walk([*at, "key_value", "value"], kind.item_type)
        elif pt.is_list(kind) or pt.is_large_list(kind):
            walk([*at, "list", "element"], kind.value_type)
        else:
            found.append(at)

    for f in meta.schema.to_arrow_schema():
        walk([f.name], f.type)
    if len(found) != meta.num_columns:  # a shape that Arrow folds otherwise
        found = [meta.schema.column(i).path.split(".") for i in range(meta.num_columns)]
    return found


def _number(v) -> float | None:
    import datetime as dt
    from decimal import Decimal

    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float, Decimal)):
        return float(v)
    if isinstance(v, dt.datetime):
        return (v.replace(tzinfo=None) - dt.datetime(1970, 1, 1)).total_seconds()
    if isinstance(v, dt.date):
        return float((v - dt.date(1970, 1, 1)).days)
    return None


def _chunks(file: str, raw: bytes):
    meta, blooms = metadata(raw), thrift.blooms(thrift.decoded(raw))
    paths = paths_of_columns(meta)
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            col = group.column(c)
            stats = col.statistics if col.is_stats_set else None
            bounds = stats is not None and stats.has_min_max
            low, high = (stats.min, stats.max) if bounds else (None, None)
            shown = lambda v: None if v is None else v.hex() if isinstance(v, bytes) else str(v)
            yield (
                file, g, c, paths[c], paths[c][0], col.physical_type, col.compression, sorted(set(col.encodings)), col.total_compressed_size, col.total_uncompressed_size, col.num_values,
                stats.null_count if stats is not None and stats.has_null_count else None, stats.distinct_count if stats is not None and stats.has_distinct_count else None, shown(low), shown(high), _number(low), _number(high), blooms[g][c],
            )


def _groups(file: str, raw: bytes):
    meta = metadata(raw)
    for g in range(meta.num_row_groups):
        yield file, g, meta.row_group(g).num_rows, meta.row_group(g).total_byte_size


def _files(file: str, raw: bytes):
    meta = metadata(raw)
    kv = [{"key": format_kv(k), "value": format_kv(v)} for k, v in (meta.metadata or {}).items()]
    yield file, meta.created_by, meta.num_rows, meta.num_row_groups, meta.format_version, meta.serialized_size, meta.num_columns, kv


def _nodes(file: str, raw: bytes):
    meta, leaf = metadata(raw), 0
    for i, node in enumerate(thrift.nodes(thrift.decoded(raw))):
        if node[2] is None:  # a group
            yield file, i, *node, None, None, None
        else:
            c = meta.schema.column(leaf)
            leaf += 1
            yield file, i, *node, str(c.logical_type.type) if c.logical_type else "NONE", c.max_definition_level, c.max_repetition_level


def read_footers(spark: SparkSession, path: str, rows_of, schema: str) -> DataFrame:
    """The rows that rows_of(file, encoded footer) gives for every file, read by tasks."""
    import pandas as pd

    files = files_of(spark, path)
    names = [p.strip().split(" ")[0] for p in _split(schema)]

    def run(batches):
        for batch in batches:
            for file in batch["file"]:
                yield pd.DataFrame(list(rows_of(file, raw_footer(file))), columns=names, dtype=object)

    return spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), 1000))).mapInPandas(run, schema)


def _split(schema: str) -> list[str]:
    out, depth = [""], 0
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def column_chunks(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, row group and leaf column."""
    return read_footers(spark, path, _chunks, CHUNKS)


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """One row per file and row group: rows, uncompressed and compressed bytes."""
    sizes = column_chunks(spark, path).groupBy("file", "row_group").agg(F.sum("compressed").alias("compressed"))
    return read_footers(spark, path, _groups, GROUPS).join(sizes, ["file", "row_group"])


def file_meta(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: writer, rows, groups, format version, footer size."""
    return read_footers(spark, path, _files, FILES).drop("kv")


def kv_meta(spark: SparkSession, path: str) -> DataFrame:
    """Key-values of each file, as text or hexadecimal."""
    return read_footers(spark, path, _files, FILES).select("file", F.explode("kv").alias("kv")).select("file", "kv.key", "kv.value")


def schema_nodes(spark: SparkSession, path: str) -> DataFrame:
    """One row per node of the schema, groups and the root (whose path is empty) included."""
    return read_footers(spark, path, _nodes, NODES)


def column_rollup(chunks: DataFrame) -> DataFrame:
    """Per top-level column: codecs, encodings, sizes, values, nulls, bounds (numbers as numbers), Bloom filters in any and in all chunks."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    return (
        chunks.withColumn("encoding", F.array_join("encodings", ", "))
        .groupBy("top")
        .agg(
            listed("codec").alias("codecs"),
            F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("encodings")))), ", ").alias("encodings"),
            F.sum("compressed").alias("compressed"),
            F.sum("uncompressed").alias("uncompressed"),
            F.sum("num_values").alias("num_values"),
            F.sum("nulls").alias("nulls"),
            F.max("distinct").alias("distinct"),
            F.min("min_num").alias("min_num"),
            F.max("max_num").alias("max_num"),
            F.min("min_text").alias("min_text"),
            F.max("max_text").alias("max_text"),
            F.bool_or("bloom").alias("any_bloom"),
            F.bool_and("bloom").alias("all_bloom"),
        )
    )


def file_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row: totals, ratio, codecs, encodings, nulls, nesting, and the spread of row-group sizes."""
    chunks = column_chunks(spark, path)
    per = row_groups(spark, path)
    a = per.agg(
        F.sum("num_rows").alias("num_rows"), F.count(F.lit(1)).alias("num_row_groups"), F.sum("compressed").alias("compressed"),
        F.min("num_rows").alias("min_group_rows"), F.max("num_rows").alias("max_group_rows"), F.avg("num_rows").alias("avg_group_rows"),
    )
    b = chunks.agg(
        F.sum("uncompressed").alias("uncompressed"), F.array_join(F.array_sort(F.collect_set("codec")), ", ").alias("codecs"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("encodings")))), ", ").alias("encodings"), F.sum("nulls").alias("nulls"), F.max(F.size("path") > 1).alias("nested"), F.count_distinct("top").alias("num_columns"),
    )
    return a.crossJoin(b).withColumn("ratio", F.try_divide("uncompressed", "compressed"))


def with_share(groups: DataFrame) -> DataFrame:
    """Row groups with their share of all compressed bytes."""
    total = groups.agg(F.sum("compressed").alias("all"))
    return groups.crossJoin(F.broadcast(total)).withColumn("share", F.try_divide("compressed", "all")).drop("all")


def categorical_candidates(chunks: DataFrame) -> DataFrame:
    """Text columns that are dictionary-encoded and, where the footer tells, of few values."""
    rolled = column_rollup(chunks.where("physical = 'BYTE_ARRAY' and size(path) = 1"))
    few = F.col("distinct").isNull() | (F.try_divide("distinct", "num_values") < 0.05) | (F.col("distinct") < 100)
    return rolled.where(F.upper("encodings").contains("DICTIONARY") & few).select("top")


def arrow_schema(kv_value: str):
    """The Arrow schema that some writers keep under ARROW:schema."""
    import pyarrow as pa

    return pa.ipc.read_schema(pa.py_buffer(base64.b64decode(kv_value)))


def bloom_columns(spark: SparkSession, path: str) -> set[str]:
    """Top-level columns with a Bloom filter in every row group of every file."""
    return {r["top"] for r in column_rollup(column_chunks(spark, path)).where("all_bloom").select("top").collect()}


#: Rows of a section of file_info that are brought to the driver.
SECTION_ROWS = 10_000


def file_info(spark: SparkSession, path: str) -> dict:
    """What the footers say of a path, section by section; a section that fails is absent and its error kept under "errors".

    Of each section the first SECTION_ROWS rows are shown, and "truncated" names those that have more.
    """
    sections = {"files": file_meta, "kv": kv_meta, "row_groups": lambda s, p: with_share(row_groups(s, p)), "columns": lambda s, p: column_rollup(column_chunks(s, p)), "schema": schema_nodes}
    out: dict = {"errors": {}, "truncated": []}
    for name, read in sections.items():
        try:
            rows = [r.asDict() for r in read(spark, path).limit(SECTION_ROWS + 1).collect()]
            out[name] = rows[:SECTION_ROWS]
            out["truncated"] += [name] if len(rows) > SECTION_ROWS else []
        except Exception as e:  # noqa: BLE001  whatever it is, the other sections can still be shown
            out["errors"][name] = str(e)
    return out
