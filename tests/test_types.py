import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from lithoscope.functions import formatting as fm
from lithoscope.functions.types import LogicalType, chip, family, filterable, from_spark, integer, legal_ops, literal_ddl, parse_type


@pytest.mark.parametrize(
    "text, label",
    [
        ("BIGINT", "INT64"), ("UBIGINT", "UINT64"), ("HUGEINT", "INT128"), ("TINYINT", "INT8"), ("VARCHAR", "STRING"), ("BLOB", "BYTE_ARRAY"), ("DECIMAL(18,4)", "DECIMAL(18, 4)"),
        ("TIMESTAMP_MS", "TIMESTAMP(MILLIS)"), ("TIMESTAMP WITH TIME ZONE", "TIMESTAMP(MICROS, UTC)"), ("TIMESTAMPTZ", "TIMESTAMP(MICROS, UTC)"), ("DATE", "DATE"), ("BOOLEAN", "BOOLEAN"), ("INTEGER[]", "LIST<INT32>"),
        ("MAP(VARCHAR, INTEGER)", "MAP<STRING, INT32>"), ("STRUCT(a INTEGER, b VARCHAR)", "STRUCT<a: INT32, b: STRING>"), ("STRUCT(xs INTEGER[], y VARCHAR)", "STRUCT<xs: LIST<INT32>, y: STRING>"),
        ("STRUCT(a INTEGER)[]", "LIST<STRUCT<a: INT32>>"), ("STRUCT(\"a, b\" INTEGER, \"c\"\"d\" DATE)", 'STRUCT<a, b: INT32, c"d: DATE>'), ("INTEGER[][]", "LIST<LIST<INT32>>"), ("NUMERIC(5)", "DECIMAL(5, 0)"), ("odd thing", "odd thing"), ("STRUCT(a", "STRUCT(a"),
    ],
)
def test_parse_and_label(text, label):
    assert chip(parse_type(text)) == label


def test_labels_of_deep_types_and_enums():
    assert chip(parse_type("STRUCT(a STRUCT(b INTEGER[]))"), max_depth=1) == "STRUCT<a: STRUCT<1 field>>"
    assert chip(parse_type("STRUCT(a INTEGER, b DATE)"), max_depth=0) == "STRUCT<2 fields>"
    assert parse_type("ENUM('a', 'it''s')").values == ("a", "it's")


def test_families_and_filters():
    assert [family(parse_type(t)) for t in ("INTEGER", "VARCHAR", "UUID", "JSON", "TIMESTAMP", "TIME", "MAP(DATE, DATE)", "what")] == ["numeric", "string", "uuid", "json", "timestamp", "time", "map", "other"]
    assert not any(filterable(parse_type(t)) for t in ("BLOB", "INTEGER[]", "BSON", "INT96", "what")) and filterable(parse_type("FLOAT16"))
    assert "contains" in legal_ops(parse_type("VARCHAR")) and legal_ops(parse_type("FLOAT16")) == ("is_null", "is_not_null")
    assert [literal_ddl(integer(b, s)) for b, s in ((8, True), (8, False), (32, False), (64, False), (128, True))] == ["tinyint", "smallint", "bigint", "decimal(20,0)", "decimal(38,0)"]


def test_from_spark():
    assert chip(from_spark(T.StructType([T.StructField("a", T.ArrayType(T.DecimalType(9, 2))), T.StructField("t", T.TimestampNTZType())]))) == "STRUCT<a: LIST<DECIMAL(9, 2)>, t: TIMESTAMP(MICROS)>"


@pytest.mark.parametrize(
    "value, kind, text",
    [
        (None, "INTEGER", "NULL"), (123456789012345, "BIGINT", "123456789012345"), (1234567, "INTEGER", "1,234,567"), (12345, "DECIMAL(6,2)", "123.45"), (-12345, "DECIMAL(6,2)", "-123.45"), (Decimal("1.50"), "DECIMAL(6,2)", "1.50"),
        (True, "BOOLEAN", "true"), ([1, 2, 3], "INTEGER[]", "[3 items]"), ([1], "INTEGER[]", "[1 item]"), ({"a": 1, "b": 2, "c": 3, "d": 4}, "STRUCT(a INTEGER, b INTEGER, c INTEGER, d INTEGER)", "{a, b, c, …}"),
        ({"k": 1}, "MAP(VARCHAR, INTEGER)", "{1 entries}"), (dt.date(2026, 5, 4), "DATE", "2026-05-04"), (1.5, "DOUBLE", "1.5"), (b"\x01\xff", "BLOB", "01ff"), (1_000_001, "TIME", "00:00:01.000001"), (1_700_000_000_123, "TIMESTAMP_MS", "2023-11-14T22:13:20.123000"),
        (dt.datetime(2024, 1, 2, 3, 4, 5, 6), "TIMESTAMPTZ", "2024-01-02T03:04:05.000006Z"), ((14).to_bytes(4, "little") + (3).to_bytes(4, "little") + (1500).to_bytes(4, "little"), "INTERVAL", "14 mo 3 d 1.500000 s"), (bytes(12), "INTERVAL", "0"),
    ],
)
def test_cells(value, kind, text):
    assert fm.format_cell(value, parse_type(kind)) == text


def test_long_text_sizes_and_metadata():
    shown = fm.format_cell("x" * 500, LogicalType("STRING"))
    assert len(shown) == 198 and shown.endswith("…")
    assert [fm.format_bytes(n) for n in (999, 1500, 2_500_000)] == ["999 B", "1.5 kB", "2.5 MB"]
    assert [fm.format_human(n) for n in (0, 512, 1536, 150 << 20)] == ["0 B", "512 B", "1.50 KB", "150 MB"]
    assert fm.format_kv(b"text") == "text" and fm.format_kv(b"\xff\xfe") == "fffe"
