"""Open Parquet sources: reading with a schema built from the footer, aliases, views, closing.

One column that Spark cannot infer makes a whole file unreadable, so the schema is built from the footers of all files:
UUID, INTERVAL and zoned TIME are read as their raw bytes or numbers and decoded, nanosecond timestamps as
numbers, and columns that cannot be carried at all (16-bit floats, types that differ between files) are left out
and reported.  Columns that only some files have are null elsewhere, and reported too.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import LogicalType, from_spark
from ..plans.grid import column
from .footer import metadata, read_footers

EXTENSIONS = (".parquet", ".pq")
UNITS = {"s": "MILLIS", "ms": "MILLIS", "us": "MICROS", "ns": "NANOS"}


def _spark_type(kind) -> T.DataType | None:
    """The type that Spark's reader takes for an Arrow type; None if it takes none."""
    import pyarrow.types as pt

    simple = [
        (pt.is_boolean, T.BooleanType()), (pt.is_int8, T.ByteType()), (pt.is_int16, T.ShortType()), (pt.is_int32, T.IntegerType()), (pt.is_int64, T.LongType()),
        (pt.is_uint8, T.ShortType()), (pt.is_uint16, T.IntegerType()), (pt.is_uint32, T.LongType()), (pt.is_uint64, T.DecimalType(20, 0)),
        (pt.is_float32, T.FloatType()), (pt.is_float64, T.DoubleType()), (pt.is_date, T.DateType()),
    ]
    for test, found in simple:
        if test(kind):
            return found
    if pt.is_string(kind) or pt.is_large_string(kind):
        return T.StringType()
    if pt.is_binary(kind) or pt.is_large_binary(kind) or pt.is_fixed_size_binary(kind):
        return T.BinaryType()
    if pt.is_decimal(kind):
        return T.DecimalType(kind.precision, kind.scale) if kind.precision <= 38 else None
    if pt.is_timestamp(kind):
        return T.LongType() if kind.unit == "ns" else T.TimestampType() if kind.tz else T.TimestampNTZType()
    if pt.is_time(kind):
        return T.LongType() if pt.is_time64(kind) else T.IntegerType()
    if pt.is_struct(kind):
        members = [(kind.field(i).name, _spark_type(kind.field(i).type)) for i in range(kind.num_fields)]
        return None if any(t is None for _, t in members) else T.StructType([T.StructField(n, t) for n, t in members])
    if pt.is_map(kind):
        key, item = _spark_type(kind.key_type), _spark_type(kind.item_type)
        return T.MapType(key, item) if key and item else None
    if pt.is_list(kind) or pt.is_large_list(kind):
        item = _spark_type(kind.value_type)
        return T.ArrayType(item) if item else None
    return None


def _logical(kind, parquet_logical: str) -> LogicalType | None:
    """The logical type where Spark's own type does not tell it."""
    import pyarrow.types as pt

    if parquet_logical == "UUID":
        return LogicalType("UUID")
    if parquet_logical in ("JSON", "BSON", "ENUM", "INTERVAL"):
        return LogicalType(parquet_logical)
    if pt.is_unsigned_integer(kind):
        return LogicalType("INT", bits=kind.bit_width, signed=False)
    if pt.is_timestamp(kind):
        return LogicalType("TIMESTAMP", unit=UNITS[kind.unit], utc=bool(kind.tz))
    if pt.is_time(kind):
        return LogicalType("TIME", unit=UNITS[kind.unit])
    if pt.is_fixed_size_binary(kind):
        return LogicalType("FIXED_LEN_BYTE_ARRAY", length=kind.byte_width)
    return None


@dataclass
class Source:
    """One open dataset."""

    alias: str
    path: str
    df: DataFrame
    types: dict[str, LogicalType]
    unreadable: dict[str, str] = field(default_factory=dict)
    display_name: str = ""


def _fields(file: str, raw: bytes):
    """One row: the file's columns as (name, Spark's type or None, logical type, Arrow's type), encoded."""
    meta = metadata(raw)
    leaves = {meta.schema.column(i).path: meta.schema.column(i) for i in range(meta.num_columns)}
    found = []
    for f in meta.schema.to_arrow_schema():
        leaf, arrow = leaves.get(f.name), getattr(f.type, "storage_type", f.type)
        stated = str(leaf.logical_type.type) if leaf is not None and leaf.logical_type else "NONE"
        if leaf is not None and stated == "NONE" and leaf.converted_type in ("INTERVAL", "JSON", "BSON", "ENUM"):
            stated = leaf.converted_type
        legacy = leaf is not None and leaf.physical_type == "INT96"
        dt = T.TimestampType() if legacy else T.BinaryType() if stated in ("UUID", "INTERVAL") else _spark_type(arrow)
        kind = None if dt is None else LogicalType("INT96") if legacy else _logical(arrow, stated) or from_spark(dt)
        found.append((f.name, dt, kind, str(f.type)))
    yield file, pickle.dumps(found)


#: Pairs of Spark's types of which the reader widens the first to the second.
_WIDER = [("tinyint", "smallint"), ("tinyint", "int"), ("smallint", "int"), ("tinyint", "bigint"), ("smallint", "bigint"), ("int", "bigint"), ("float", "double"), ("tinyint", "double"), ("smallint", "double"), ("int", "double")]


def _merged(schemas: list[list[tuple]], files: list[int]) -> tuple[list[T.StructField], dict[str, LogicalType], dict[str, str]]:
    """One schema for files of several: fields, logical types, and what is to be reported.  files: how many have each."""
    fields: dict[str, T.DataType] = {}
    types: dict[str, LogicalType] = {}
    report: dict[str, str] = {}
    holders: dict[str, int] = {}
    for schema, n in zip(schemas, files, strict=True):
        for name, dt, kind, shown in schema:
            holders[name] = holders.get(name, 0) + n
            if dt is None:
                report[name] = f"Spark cannot read {shown}"
            elif name not in fields:
                fields[name], types[name] = dt, kind
            elif fields[name] != dt or types[name] != kind:
                old, new = fields[name].simpleString(), dt.simpleString()
                if (old, new) in _WIDER:
                    fields[name], types[name] = dt, kind
                elif (new, old) not in _WIDER:
                    report[name] = f"files differ in its type: {old} and {new}" if old != new else f"files differ in its type: {types[name].kind} and {kind.kind}"
    total = sum(files)
    for name, n in holders.items():
        if n < total and name not in report:
            report[name] = f"{total - n:,} of {total:,} files lack it: null there"
    kept = [n for n in fields if n not in report or "lack it" in report[n]]
    return [T.StructField(n, fields[n]) for n in kept], {n: types[n] for n in kept}, report


def read_source(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, LogicalType], dict[str, str]]:
    """The rows of a Parquet path with a schema from all footers, the logical types, and columns that are left out or partly absent, with reasons.

    Footers are read by tasks; each distinct schema comes to the driver once.
    """
    seen = read_footers(spark, path, _fields, "file string, fields binary").groupBy("fields").agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("n"))
    rows = sorted(seen.collect(), key=lambda r: r["file"])
    fields, types, missing = _merged([pickle.loads(bytes(r["fields"])) for r in rows], [r["n"] for r in rows])
    df = spark.read.schema(T.StructType(fields)).parquet(path)
    shown = []
    for f in fields:
        c = column(f.name)
        if types[f.name].kind == "UUID":
            h = F.lower(F.hex(c))
            c = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
            c = F.when(column(f.name).isNotNull(), c)
        shown.append(c.alias(f.name))
    return df.select(*shown), types, missing


class Catalog:
    """Open sources by alias, one of them active; analyses are remembered per alias until it closes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.sources, self.active = spark, {}, None
        self.results: dict[tuple, object] = {}

    def pick_alias(self, name: str) -> str:
        """The name, or with the first free number from 2 on before it."""
        n, alias = 1, name
        while alias in self.sources:
            n += 1
            alias = f"{n}_{name}"
        return alias

    def open(self, path: str, name: str | None = None) -> Source:
        """Register a path; its view carries the alias."""
        if not path.rstrip("/").lower().endswith(EXTENSIONS):
            raise ValueError(f"unsupported file: {path}; expected one of {', '.join(EXTENSIONS)}")
        display = name or path.rstrip("/").rsplit("/", 1)[-1]
        alias = self.pick_alias(display)
        df, types, missing = read_source(self.spark, path)
        return self._add(Source(alias, path, df, types, missing, display))

    def open_frame(self, df: DataFrame, name: str) -> Source:
        """Register rows that are in memory already."""
        return self._add(Source(self.pick_alias(name), "", df, {f.name: from_spark(f.dataType, f.metadata) for f in df.schema}, {}, name))

    def _add(self, source: Source) -> Source:
        self.sources[source.alias] = source
        self.active = source.alias
        # Spark's view names hold no quotes or dots of their own, so odd aliases are quoted once here.
        self.spark.sql(f"DROP VIEW IF EXISTS `{source.alias.replace('`', '``')}`")
        source.df.createOrReplaceTempView("`" + source.alias.replace("`", "``") + "`")
        return source

    def activate(self, alias: str) -> Source:
        self.active = alias if alias in self.sources else self.active
        return self.sources[self.active]

    def close(self, alias: str) -> None:
        """Drop the view and all that is remembered of it; another source becomes active."""
        self.sources.pop(alias)
        self.spark.sql(f"DROP VIEW IF EXISTS `{alias.replace('`', '``')}`")
        self.results = {k: v for k, v in self.results.items() if k[0] != alias}
        if self.active == alias:
            self.active = next(reversed(self.sources), None)

    def once(self, alias: str, kind: str, make):
        """A result that is made once per alias; a failure is not remembered."""
        if (alias, kind) not in self.results:
            self.results[alias, kind] = make(self.sources[alias])
        return self.results[alias, kind]


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV files with a header each, of exactly the rows given, one per task; ``single``: one file, gathered after a shuffle, so that the rows are still made in parallel."""
    out = df.repartition(1) if single else df
    out.write.mode("overwrite").option("header", True).csv(path)
