"""Values as a grid shows them."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

from .types import LogicalType

SHOWN_CHARS, KV_BYTES = 200, 96


def format_bytes(n: float) -> str:
    """Decimal units, for sizes of files."""
    for unit in ("B", "kB", "MB", "GB"):
        if abs(n) < 1000:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1000
    return f"{n:.1f} TB"


def format_human(n: float) -> str:
    """Binary units, for the storage advice."""
    if n <= 0:
        return "0 B"
    units = ["B", "KB", "MB", "GB", "TB"]
    while n >= 1024 and len(units) > 1:
        n /= 1024
        units.pop(0)
    return f"{n:.{0 if n >= 100 else 1 if n >= 10 else 2}f} {units[0]}"


def format_interval(months: int, days: int, micros: int) -> str:
    seconds, rest = divmod(abs(micros), 1_000_000)
    sign = "-" if micros < 0 else ""
    parts = [f"{months} mo"] * bool(months) + [f"{days} d"] * bool(days)
    if micros:
        parts.append(f"{sign}{seconds}{f'.{rest:06d}' if rest else ''} s")
    return " ".join(parts) or "0"


def _time_of(micros: int, utc: bool) -> str:
    seconds, rest = divmod(micros, 1_000_000)
    return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}.{rest:06d}{'Z' if utc else ''}"


def format_kv(value: bytes) -> str:
    """Metadata values: text where they are UTF-8, else the first bytes in hexadecimal."""
    try:
        return value.decode()
    except UnicodeDecodeError:
        return value[:KV_BYTES].hex()


def format_cell(value, t: LogicalType) -> str:
    """One value as text; nested values as a short preview."""
    if value is None:
        return "NULL"
    match t.kind:
        case "BOOLEAN":
            return "true" if value else "false"
        case "INT":
            return str(value) if t.bits >= 64 else f"{value:,}"
        case "FLOAT" | "DOUBLE" | "FLOAT16":
            return f"{value:,.6f}".rstrip("0").rstrip(".")
        case "DECIMAL":
            return f"{Decimal(value).scaleb(-t.scale):f}" if isinstance(value, int) else str(value)
        case "STRING" | "JSON" | "UUID" | "ENUM":
            text = str(value)
            return text if len(text) <= SHOWN_CHARS else text[: SHOWN_CHARS - 3] + "…"
        case "BYTE_ARRAY" | "FIXED_LEN_BYTE_ARRAY" | "BSON":
            return bytes(value).hex()
        case "DATE":
            return value.isoformat() if isinstance(value, dt.date) else str(dt.date(1970, 1, 1) + dt.timedelta(days=value))
        case "TIME":
            if isinstance(value, dt.time):
                value = ((value.hour * 60 + value.minute) * 60 + value.second) * 1_000_000 + value.microsecond
            return _time_of(value, t.utc)
        case "TIMESTAMP":
            if not isinstance(value, dt.datetime):
                micros = value * 1000 if t.unit == "MILLIS" else value // 1000 if t.unit == "NANOS" else value
                value = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=micros)
            return value.strftime("%Y-%m-%dT%H:%M:%S.%f") + ("Z" if t.utc else "")
        case "INTERVAL":
            data = bytes(value)
            months, days, millis = (int.from_bytes(data[i : i + 4], "little") for i in (0, 4, 8))
            return format_interval(months, days, millis * 1000)
        case "LIST":
            return f"[{len(value)} item{'' if len(value) == 1 else 's'}]"
        case "STRUCT":
            names = list(value.asDict() if hasattr(value, "asDict") else value)
            return "{" + ", ".join(names[:3]) + (", …" if len(names) > 3 else "") + "}"
        case "MAP":
            return f"{{{len(value)} entries}}"
    return json.dumps(value, default=str)
