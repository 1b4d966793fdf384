"""Parquet-flavoured logical types: parsing, labels, families, filter rules and Spark types."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class LogicalType:
    """A kind and what it needs: bits and sign, precision and scale, unit and zone, length, members."""

    kind: str
    bits: int = 0
    signed: bool = True
    precision: int = 0
    scale: int = 0
    unit: str = ""
    utc: bool = False
    length: int | None = None
    element: LogicalType | None = None
    key: LogicalType | None = None
    fields: tuple[tuple[str, LogicalType], ...] = field(default=())
    values: tuple[str, ...] = ()
    raw: str = ""


def integer(bits: int, signed: bool = True) -> LogicalType:
    return LogicalType("INT", bits=bits, signed=signed)


# The type names that engines print, and what they stand for.
_SCALARS = {
    "BOOLEAN": LogicalType("BOOLEAN"), "BOOL": LogicalType("BOOLEAN"),
    "TINYINT": integer(8), "SMALLINT": integer(16), "INTEGER": integer(32), "INT": integer(32), "BIGINT": integer(64), "HUGEINT": integer(128),
    "UTINYINT": integer(8, False), "USMALLINT": integer(16, False), "UINTEGER": integer(32, False), "UBIGINT": integer(64, False), "UHUGEINT": integer(128, False),
    "FLOAT": LogicalType("FLOAT"), "REAL": LogicalType("FLOAT"), "DOUBLE": LogicalType("DOUBLE"), "FLOAT16": LogicalType("FLOAT16"),
    "VARCHAR": LogicalType("STRING"), "TEXT": LogicalType("STRING"), "STRING": LogicalType("STRING"),
    "BLOB": LogicalType("BYTE_ARRAY"), "BINARY": LogicalType("BYTE_ARRAY"), "UUID": LogicalType("UUID"), "JSON": LogicalType("JSON"), "BSON": LogicalType("BSON"),
    "DATE": LogicalType("DATE"), "TIME": LogicalType("TIME", unit="MICROS"), "TIMETZ": LogicalType("TIME", unit="MICROS", utc=True), "TIME WITH TIME ZONE": LogicalType("TIME", unit="MICROS", utc=True),
    "TIMESTAMP": LogicalType("TIMESTAMP", unit="MICROS"), "TIMESTAMP_MS": LogicalType("TIMESTAMP", unit="MILLIS"), "TIMESTAMP_S": LogicalType("TIMESTAMP", unit="MILLIS"), "TIMESTAMP_NS": LogicalType("TIMESTAMP", unit="NANOS"),
    "TIMESTAMPTZ": LogicalType("TIMESTAMP", unit="MICROS", utc=True), "TIMESTAMP WITH TIME ZONE": LogicalType("TIMESTAMP", unit="MICROS", utc=True), "TIMESTAMP_NTZ": LogicalType("TIMESTAMP", unit="MICROS"),
    "INTERVAL": LogicalType("INTERVAL"), "INT96": LogicalType("INT96"),
}
_TOKEN = re.compile(r"""\s*(?:"((?:[^"]|"")*)"|'((?:[^']|'')*)'|([A-Za-z_][A-Za-z0-9_]*)|([0-9]+)|(\[\]|[(),]))""")


def parse_type(text: str) -> LogicalType:
    """The logical type that an engine's type string names; UNKNOWN with the text where it names none."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            return LogicalType("UNKNOWN", raw=text)
        quoted, literal, word, number, mark = m.groups()
        if quoted is not None:
            tokens.append(("name", quoted.replace('""', '"')))
        elif literal is not None:
            tokens.append(("text", literal.replace("''", "'")))
        else:
            tokens.append(("word", word) if word else ("number", number) if number else (mark, mark))
        at = m.end()
    try:
        found, rest = _parse(tokens, 0)
    except (IndexError, ValueError):
        return LogicalType("UNKNOWN", raw=text)
    return found if rest == len(tokens) else LogicalType("UNKNOWN", raw=text)


def _expect(tokens, at, what):
    if tokens[at][0] != what:
        raise ValueError(what)
    return at + 1


def _parse(tokens, at):
    if tokens[at][0] != "word":
        raise ValueError(tokens[at])
    word = tokens[at][1].upper()
    at += 1
    if word == "STRUCT":
        members, at = [], _expect(tokens, at, "(")
        while True:
            name, (kind, at) = tokens[at][1], _parse(tokens, at + 1)
            members.append((name, kind))
            if tokens[at][0] == ")":
                break
            at = _expect(tokens, at, ",")
        found, at = LogicalType("STRUCT", fields=tuple(members)), at + 1
    elif word == "MAP":
        key, at = _parse(tokens, _expect(tokens, at, "("))
        value, at = _parse(tokens, _expect(tokens, at, ","))
        found, at = LogicalType("MAP", key=key, element=value), _expect(tokens, at, ")")
    elif word in ("DECIMAL", "NUMERIC"):
        numbers = [18, 3]
        if at < len(tokens) and tokens[at][0] == "(":
            numbers = [int(tokens[at + 1][1]), 0]
            at += 2
            if tokens[at][0] == ",":
                numbers[1], at = int(tokens[at + 1][1]), at + 2
            at = _expect(tokens, at, ")")
        found = LogicalType("DECIMAL", precision=numbers[0], scale=numbers[1])
    elif word == "ENUM":
        values = []
        if at < len(tokens) and tokens[at][0] == "(":
            while tokens[at][0] != ")":
                values.append(tokens[at + 1][1])
                at += 2
            at += 1
        found = LogicalType("ENUM", values=tuple(values))
    else:
        while at < len(tokens) and tokens[at][0] == "word" and f"{word} {tokens[at][1].upper()}" in " ".join(_SCALARS):
            word, at = f"{word} {tokens[at][1].upper()}", at + 1
        if word not in _SCALARS:
            raise ValueError(word)
        found = _SCALARS[word]
    while at < len(tokens) and tokens[at][0] == "[]":
        found, at = LogicalType("LIST", element=found), at + 1
    return found, at


def chip(t: LogicalType, max_depth: int = 3, depth: int = 0) -> str:
    """The label of a type; nested ones beyond max_depth are abbreviated."""
    inner = lambda x: chip(x, max_depth, depth + 1)
    deep = depth >= max_depth
    zone = ", UTC" if t.utc else ""
    match t.kind:
        case "INT":
            return f"{'' if t.signed else 'U'}INT{t.bits}"
        case "DECIMAL":
            return f"DECIMAL({t.precision}, {t.scale})"
        case "FIXED_LEN_BYTE_ARRAY":
            return f"FIXED_LEN_BYTE_ARRAY({t.length})"
        case "TIME" | "TIMESTAMP":
            return f"{t.kind}({t.unit}{zone})"
        case "LIST":
            return "LIST<…>" if deep else f"LIST<{inner(t.element)}>"
        case "MAP":
            return "MAP<…>" if deep else f"MAP<{inner(t.key)}, {inner(t.element)}>"
        case "STRUCT":
            n = len(t.fields)
            return f"STRUCT<{n} field{'' if n == 1 else 's'}>" if deep else "STRUCT<" + ", ".join(f"{name}: {inner(x)}" for name, x in t.fields) + ">"
        case "UNKNOWN":
            return t.raw
    return t.kind


_FAMILIES = {
    "numeric": ("INT", "FLOAT", "DOUBLE", "DECIMAL", "FLOAT16"),
    "string": ("STRING", "BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY"),
    "json": ("JSON", "BSON"),
    "timestamp": ("TIMESTAMP", "INT96"),
}
FAMILY_OF = {kind: family for family, kinds in _FAMILIES.items() for kind in kinds} | {k: k.lower() for k in ("ENUM", "UUID", "DATE", "TIME", "BOOLEAN", "LIST", "MAP", "STRUCT")}
NESTED = {"LIST", "MAP", "STRUCT"}
TEXT_KINDS = {"STRING", "ENUM", "JSON", "UUID"}

# The filter operations that each kind takes.
_COMPARE = ("eq", "neq", "lt", "lte", "gt", "gte", "between", "is_null", "is_not_null")
_EQUAL = ("eq", "neq", "is_null", "is_not_null")
LEGAL_OPS = {
    "BOOLEAN": ("is_true", "is_false", "is_null", "is_not_null"),
    "INT": _COMPARE, "FLOAT": _COMPARE, "DOUBLE": _COMPARE, "DECIMAL": _COMPARE, "DATE": _COMPARE, "TIME": _COMPARE, "TIMESTAMP": _COMPARE,
    "STRING": ("contains", *_EQUAL), "JSON": ("contains", "is_null", "is_not_null"), "UUID": _EQUAL, "ENUM": _EQUAL, "INTERVAL": _EQUAL,
}


def family(t: LogicalType) -> str:
    return FAMILY_OF.get(t.kind, "other")


def filterable(t: LogicalType) -> bool:
    return t.kind not in NESTED and t.kind not in ("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY", "INT96", "BSON", "UNKNOWN")


def legal_ops(t: LogicalType) -> tuple[str, ...]:
    return LEGAL_OPS.get(t.kind, ("is_null", "is_not_null"))


def literal_ddl(t: LogicalType) -> str | None:
    """The Spark type that a filter's text is cast to; None where the text is compared as it is."""
    match t.kind:
        case "INT":
            wider = t.bits * (1 if t.signed else 2)  # unsigned ones are read as the next wider type
            return {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}.get(wider, "decimal(20,0)" if t.bits == 64 else "decimal(38,0)")
        case "DECIMAL":
            return f"decimal({t.precision},{t.scale})"
        case "TIMESTAMP":
            return "bigint" if t.unit == "NANOS" else "timestamp" if t.utc else "timestamp_ntz"
        case "TIME":
            return "bigint" if t.utc else "time(6)"
    return {"DATE": "date", "FLOAT": "float", "DOUBLE": "double", "BOOLEAN": "boolean", "STRING": "string", "JSON": "string", "UUID": "string"}.get(t.kind)


def from_spark(dt: T.DataType, metadata: dict | None = None) -> LogicalType:
    """The logical type of a Spark column; a footer's own one in its metadata comes first."""
    if metadata and metadata.get("logical"):
        return parse_type(metadata["logical"])
    match dt:
        case T.BooleanType():
            return LogicalType("BOOLEAN")
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return integer({"byte": 8, "short": 16, "integer": 32, "long": 64}[dt.typeName()])
        case T.FloatType() | T.DoubleType() | T.DateType():
            return LogicalType(dt.typeName().upper())
        case T.DecimalType():
            return LogicalType("DECIMAL", precision=dt.precision, scale=dt.scale)
        case T.StringType():
            return LogicalType("STRING")
        case T.BinaryType():
            return LogicalType("BYTE_ARRAY")
        case T.TimestampNTZType():
            return LogicalType("TIMESTAMP", unit="MICROS")
        case T.TimestampType():
            return LogicalType("TIMESTAMP", unit="MICROS", utc=True)
        case T.ArrayType():
            return LogicalType("LIST", element=from_spark(dt.elementType))
        case T.MapType():
            return LogicalType("MAP", key=from_spark(dt.keyType), element=from_spark(dt.valueType))
        case T.StructType():
            return LogicalType("STRUCT", fields=tuple((f.name, from_spark(f.dataType, f.metadata)) for f in dt))
    return LogicalType("TIME", unit="MICROS") if dt.typeName().startswith("time") else LogicalType("UNKNOWN", raw=dt.simpleString())
