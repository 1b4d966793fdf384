"""What the rules need to know of each column and struct leaf, from one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.types import LogicalType
from ...plans.grid import column, logical_types
from ..exact import with_distinct
from ..fused import at_midnight, distinct, fused

FIELDS = {
    "num_values": "bigint", "non_null": "bigint", "distinct": "bigint",
    "num_min": "double", "num_max": "double", "abs_max": "double", "int_valued": "boolean", "float_round_trips": "boolean", "sorted": "boolean",
    "min_len": "bigint", "max_len": "bigint", "all_uuid": "boolean", "all_int": "boolean", "int_min": "double", "int_max": "double", "all_double": "boolean",
    "all_bool": "boolean", "all_timestamp": "boolean", "ts_midnight": "boolean", "all_json": "boolean",
    "whole_millis": "boolean", "midnight": "boolean", "whole_micros": "boolean", "true_count": "bigint",
}

# The texts that count as each type.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
INTEGER = r"^[+-]?[0-9]+$"
BOOLEAN = r"(?i)^(true|false|t|f|yes|no)$"
#: Gates before Spark's casts, which take some texts that are no such values (1d, 2024, now).
DOUBLE_GATE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity|nan)\s*$"
TIMESTAMP_GATE = r"^\s*\d+-\d+-\d+"


def targets(types: dict[str, LogicalType]) -> list[tuple[tuple[str, ...], LogicalType]]:
    """(path, type) of every top-level column that is no struct, and of every leaf of structs."""
    out: list[tuple[tuple[str, ...], LogicalType]] = []

    def walk(path: tuple[str, ...], t: LogicalType) -> None:
        if t.kind == "STRUCT":
            for name, inner in t.fields:
                walk((*path, name), inner)
        else:
            out.append((path, t))

    for name, t in types.items():
        walk((name,), t)
    return out


def value_of(path: tuple[str, ...]) -> Column:
    c = column(path[0])
    for name in path[1:]:
        c = c.getField(name)
    return c


def probe(path: tuple[str, ...], t: LogicalType) -> dict[str, Column]:
    c = value_of(path)
    if t.kind in ("LIST", "MAP", "UNKNOWN"):
        return {"num_values": F.count(F.lit(1)), "non_null": F.count(c)}
    out = {"num_values": F.count(F.lit(1)), "non_null": F.count(c), "distinct": distinct(c)}
    match t.kind:
        case "INT":
            out |= {"num_min": F.min(c), "num_max": F.max(c)}
        case "FLOAT" | "DOUBLE":
            whole = c.cast("double") == F.expr("1D") * c.try_cast("bigint").cast("double")
            out |= {"num_min": F.min(c), "num_max": F.max(c), "abs_max": F.max(F.abs(c)), "int_valued": F.bool_and(whole)}
            if t.kind == "DOUBLE":
                out["float_round_trips"] = F.bool_and(c == c.cast("float").cast("double"))
        case "DECIMAL":
            out["abs_max"] = F.max(F.abs(c))
        case "STRING":
            ts = F.when(c.rlike(TIMESTAMP_GATE), c.try_cast("timestamp_ntz"))
            trimmed = F.trim(c)
            out |= {
                "min_len": F.min(F.length(c)),
                "max_len": F.max(F.length(c)),
                "all_uuid": F.bool_and(c.rlike(UUID)),
                "all_int": F.bool_and(c.rlike(INTEGER)),
                "int_min": F.min(F.when(c.rlike(INTEGER), c.try_cast("bigint"))),
                "int_max": F.max(F.when(c.rlike(INTEGER), c.try_cast("bigint"))),
                "all_double": F.bool_and(c.isNull() | (c.rlike(DOUBLE_GATE) & c.try_cast("double").isNotNull())),
                "all_bool": F.bool_and(c.isNull() | c.rlike(BOOLEAN)),
                "all_timestamp": F.bool_and(c.isNull() | ts.isNotNull()),
                "ts_midnight": F.bool_and(ts.isNull() | at_midnight(ts)),
                "all_json": F.bool_and(trimmed.startswith("{") | trimmed.startswith("[")),
            }
        case "BYTE_ARRAY":
            out |= {"min_len": F.min(F.octet_length(c)), "max_len": F.max(F.octet_length(c))}
        case "TIMESTAMP" if t.unit == "NANOS":  # carried as a number of nanoseconds
            out |= {"whole_millis": F.bool_and(c % 1_000_000 == 0), "whole_micros": F.bool_and(c % 1000 == 0), "midnight": F.bool_and(c % 86_400_000_000_000 == 0)}
        case "TIMESTAMP":
            millis = F.date_part(F.lit("second"), c) * 1000
            out |= {"whole_millis": F.bool_and(millis == F.floor(millis)), "midnight": F.bool_and(at_midnight(c))}
        case "BOOLEAN":
            out["true_count"] = F.count_if(c)
    return out


def probes(df: DataFrame, types: dict[str, LogicalType] | None = None, exact: bool = False) -> DataFrame:
    """One row per target (its path joined by dots) with FIELDS."""
    types = types or logical_types(df)
    aggs = {".".join(p): probe(p, t) for p, t in targets(types)}
    counted = {(".".join(p), "distinct"): value_of(p) for p, _ in targets(types) if exact and "distinct" in aggs[".".join(p)]}
    for n, _ in counted:
        aggs[n].pop("distinct")
    return with_distinct(fused(df, aggs, FIELDS), df, counted)


def sorted_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """name and sorted: whether a column of a Parquet source never falls from row to row of a file.

    One scan for all columns: tasks compare the rows of their part of a file in the file's order and give out its
    ends; the ends of consecutive parts are compared after, one row for each part.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], "name string, sorted boolean")
    rows = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("i"), *[column(n).alias(f"c{k}") for k, n in enumerate(names)])
    types = [rows.schema[f"c{k}"].dataType.simpleString() for k in range(len(names))]
    schema = "file string, start bigint" + "".join(f", a{k} {t}, b{k} {t}, falls{k} boolean" for k, t in enumerate(types))

    class Part:
        """Consecutive rows of one file: of each column its first and last value, and whether it fell."""

        def __init__(self, file, start):
            self.file, self.start, self.next = file, start, start
            self.first, self.last, self.falls = [None] * len(names), [None] * len(names), [False] * len(names)

        def add(self, columns, n):
            self.next += n
            for k, values in enumerate(columns):
                v = values.drop_null()
                if len(v):
                    before = self.last[k]
                    self.falls[k] |= (before is not None and pc.less(v[0], before).as_py()) or bool(pc.any(pc.less(v[1:], v[:-1])).as_py())
                    self.first[k] = v[0] if before is None else self.first[k]
                    self.last[k] = v[-1]

        def row(self, kinds):
            ends = [x for k, t in enumerate(kinds) for x in (pa.array([self.first[k]] if self.first[k] is not None else [None], t), pa.array([self.last[k]] if self.last[k] is not None else [None], t), pa.array([bool(self.falls[k])]))]
            return pa.RecordBatch.from_arrays([pa.array([self.file]), pa.array([self.start], pa.int64()), *ends], names=[f.split(" ")[0] for f in schema.split(", ")])

    def run(batches):
        part, kinds = None, []
        for batch in batches:
            kinds = [c.type for c in batch.columns[2:]]
            files, index = batch.column(0), batch.column(1).to_numpy()
            cuts = [0] if batch.num_rows else []
            cuts += [at for at in range(1, batch.num_rows) if index[at] != index[at - 1] + 1] if batch.num_rows and index[-1] - index[0] != batch.num_rows - 1 else []
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                file, start = files[a].as_py(), int(index[a])
                if part is None or (part.file, part.next) != (file, start):
                    if part is not None:
                        yield part.row(kinds)
                    part = Part(file, start)
                part.add([c.slice(a, b - a) for c in batch.columns[2:]], b - a)
        if part is not None:
            yield part.row(kinds)

    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.mapInArrow(run, schema)
    falls = [F.bool_or(F.col(f"f{k}")).alias(f"f{k}") for k in range(len(names))]
    joined = parts.select(*[(F.col(f"falls{k}") | F.coalesce(F.col(f"a{k}") < F.last(f"b{k}", ignorenulls=True).over(before), F.lit(False))).alias(f"f{k}") for k in range(len(names))])
    found = [F.struct(F.lit(n).alias("name"), (~F.coalesce(F.col(f"f{k}"), F.lit(False))).alias("sorted")) for k, n in enumerate(names)]
    return joined.agg(*falls).select(F.inline(F.array(*found)))


def is_sorted(df: DataFrame, name: str) -> DataFrame:
    """One row with sorted, of one column (see ``sorted_columns``)."""
    return sorted_columns(df, [name]).select("sorted")
