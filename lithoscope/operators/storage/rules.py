"""Rules over probes and footers: plain dictionaries in, suggestions out."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from ...functions.formatting import format_human
from ...functions.types import LogicalType, chip, integer

MIB = 1 << 20
# Target, least, most, rounding and fallback of rows per row group.
GROUP_BYTES, GROUP_ROWS_MIN, GROUP_ROWS_MAX, GROUP_ROWS_STEP, GROUP_ROWS_DEFAULT = 128 * MIB, 50_000, 20_000_000, 10_000, 122_880
SEVERITIES = ("high", "medium", "low")
CATEGORIES = ("type", "compression", "encoding", "bloom", "rowgroup", "file")


@dataclass(frozen=True)
class Rule:
    """What a suggestion changes.  kind: cast, categorical, enum, sort, compression, row_group, bloom or encoding."""

    kind: str
    path: tuple[str, ...] = ()
    ddl: str = ""
    rank: int = 0
    rows: int = 0
    encoding: str = ""
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Suggestion:
    id: str
    category: str
    severity: str
    column: str | None
    current: str
    suggested: str
    reason: str
    saves: int | None = None
    rule: Rule | None = field(default=None)  # None: for information only


def fits(low: float, high: float, bits: int, signed: bool) -> bool:
    return low >= -(2 ** (bits - 1)) and high <= 2 ** (bits - 1) - 1 if signed else low >= 0 and high <= 2**bits - 1


def tightest(low: float, high: float) -> LogicalType:
    """The narrowest integer for a range; at each width a signed one comes first."""
    for bits in (8, 16, 32):
        for signed in (True, False):
            if fits(low, high, bits, signed):
                return integer(bits, signed)
    return integer(64)


def narrower(t: LogicalType, low: float, high: float) -> LogicalType | None:
    """A narrower integer of the same sign that holds the range."""
    return next((integer(b, t.signed) for b in (8, 16, 32) if b < t.bits and fits(low, high, b, t.signed)), None)


def spark_ddl(t: LogicalType) -> str:
    """The Spark type that stores a suggested type; unsigned ones need the next wider."""
    if t.kind == "INT":
        bits = t.bits if t.signed else t.bits * 2
        return {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}.get(bits, "decimal(20,0)")
    return {"FLOAT": "float", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date", "DECIMAL": f"decimal({t.precision},{t.scale})"}.get(t.kind) or ("timestamp" if t.utc else "timestamp_ntz")


def low_cardinality(p: dict) -> bool:
    """Few values that repeat at least ten times each."""
    d, n = p.get("distinct") or 0, p.get("num_values") or 0
    return d > 0 and n > 0 and (d / n < 0.05 or d < 100) and n >= 10 * d


def type_suggestion(path: tuple[str, ...], t: LogicalType, p: dict, footer: dict | None = None, values: tuple[list, bool] | None = None) -> Suggestion | None:
    """The first of the type rules that holds for a column or struct leaf.

    footer: its column's rollup (encodings, uncompressed); values: its distinct values and whether they are cut off.
    """
    name, footer = ".".join(path), footer or {}

    def cast(to: LogicalType, severity: str, reason: str) -> Suggestion:
        return Suggestion(f"type:{name}", "type", severity, name, chip(t), chip(to), reason, rule=Rule("cast", path, spark_ddl(to)))

    def note(label: str, severity: str, reason: str, **more) -> Suggestion:
        return Suggestion(f"type:{name}", "type", severity, name, chip(t), label, reason, **more)

    n, low, high, top = p.get("num_values") or 0, p.get("num_min"), p.get("num_max"), p.get("abs_max")
    some = (p.get("distinct") or 0) > 0
    match t.kind:
        case "INT96":
            return cast(LogicalType("TIMESTAMP", unit="MICROS", utc=True), "high", "A legacy type; current readers expect microseconds.")
        case "INT" if n and low is not None:
            if to := narrower(t, low, high):
                return cast(to, "high" if t.bits >= 64 and to.bits <= 16 else "medium", f"All values lie in [{low:.0f}, {high:.0f}].")
        case "FLOAT" | "DOUBLE" if n:
            if p.get("int_valued") and top is not None and top < 2**63:
                return cast(tightest(low, high), "high", f"All values are whole numbers in [{low:.0f}, {high:.0f}].")
            if t.kind == "DOUBLE" and p.get("float_round_trips") and top is not None and top < 3.4e38:
                return cast(LogicalType("FLOAT"), "medium", "Half the bytes hold every value exactly.")
        case "STRING" | "BYTE_ARRAY" if len(path) == 1:
            if p.get("all_uuid") and some:
                return note("UUID", "medium", "All values are UUIDs: 16 bytes instead of 36.")
            if p.get("all_int") and some:
                to = tightest(p["int_min"], p["int_max"]) if p.get("int_min") is not None else integer(64)
                return cast(to, "high", "All values are whole numbers written as text.")
            if p.get("all_bool") and some:
                return cast(LogicalType("BOOLEAN"), "high", "All values are truth values written as text.")
            if p.get("all_timestamp") and some:
                to = LogicalType("DATE") if p.get("ts_midnight") else LogicalType("TIMESTAMP", unit="MICROS")
                return cast(to, "high", "All values are dates or times written as text.")
            if p.get("all_double") and some:
                return cast(LogicalType("DOUBLE"), "high", "All values are numbers written as text.")
            if p.get("all_json") and some:
                return note("JSON", "low", "All values look like JSON documents.")
            if t.kind == "STRING" and low_cardinality(p):
                done = "DICTIONARY" in (footer.get("encodings") or "").upper()
                listed = values is not None and values[0] and not values[1]
                saved = round((footer.get("uncompressed") or 0) * (1 - p["distinct"] / n) * 0.7)
                rule = Rule("enum", path, values=tuple(map(str, values[0]))) if listed else Rule("categorical", path)
                reason = f"{p['distinct']:,} values in {n:,} rows" + (", dictionary-encoded already." if done else ".")
                return note("ENUM" if listed else "CATEGORICAL", "low" if done else "medium", reason, saves=None if done or saved <= 0 else saved, rule=None if done else rule)
            if p.get("min_len") and p["min_len"] == p["max_len"] <= 64:
                return note(f"FIXED_LEN_BYTE_ARRAY({p['max_len']})", "low", "All values have the same length.")
        case "TIMESTAMP":
            if p.get("midnight"):
                return cast(LogicalType("DATE"), "high", "All values are at midnight.")
            micros = t.unit != "NANOS" or p.get("whole_micros") is True
            unit = "MILLIS" if micros and p.get("whole_millis") is True else "MICROS" if micros else t.unit
            order = ("MILLIS", "MICROS", "NANOS")
            if order.index(unit) < order.index(t.unit):
                return cast(LogicalType("TIMESTAMP", unit=unit, utc=t.utc), "medium" if t.unit == "NANOS" else "low", "Finer parts are never used.")
        case "DECIMAL" if top is not None:
            needed = max(1, math.ceil(math.log10(float(top) + 1))) + t.scale
            if needed < t.precision:
                return cast(LogicalType("DECIMAL", precision=needed, scale=t.scale), "low", f"No value needs more than {needed} digits.")
    return None


def compression_suggestion(name: str, footer: dict) -> Suggestion | None:
    """From a column's codecs and sizes."""
    codec, packed, plain = (footer.get("codecs") or "").upper(), footer.get("compressed") or 0, footer.get("uncompressed") or 0
    make = lambda severity, reason, saves=None: Suggestion(f"compression:{name}", "compression", severity, name, footer["codecs"], "ZSTD", reason, saves, Rule("compression"))
    if "UNCOMPRESSED" in codec:
        return make("high", f"{format_human(plain)} are stored as they are.", max(0, plain - round(plain / 3)))
    if "SNAPPY" in codec and plain > MIB and (plain / packed if packed else 1) < 3:
        return make("medium", f"{format_human(plain)} shrink to {format_human(packed)} only.", round(packed * 0.25))
    if "GZIP" in codec:
        return make("medium", "As small, and much faster to read.")
    return None


def encoding_suggestion(name: str, t: LogicalType, p: dict, footer: dict) -> Suggestion | None:
    """From a column's encodings, values and order."""
    used = (footer.get("encodings") or "").upper()
    make = lambda severity, to, reason, rule: Suggestion(f"encoding:{name}", "encoding", severity, name, footer.get("encodings") or "—", to, reason, rule=rule)
    d, n = p.get("distinct") or footer.get("distinct") or 0, p.get("num_values") or footer.get("num_values") or 0
    if t.kind == "BOOLEAN" and "RLE" not in used and p.get("true_count") is not None and p.get("non_null"):
        share = max(p["true_count"], p["non_null"] - p["true_count"]) / p["non_null"]
        if share >= 0.9:
            return make("low", "RLE", f"{share:.0%} of the values are the same.", Rule("encoding", (name,), encoding="RLE"))
    if t.kind in ("STRING", "BYTE_ARRAY", "ENUM") and "DICTIONARY" not in used and d and n and d / n < 0.5:
        return make("medium", "RLE_DICTIONARY", f"{d:,} values in {n:,} rows.", Rule("categorical", (name,)) if t.kind == "STRING" else None)
    if t.kind in ("INT", "FLOAT", "DOUBLE", "DECIMAL") and p.get("sorted") is True and "DELTA" not in used:
        return make("low", "DELTA_BINARY_PACKED", "Values never fall from row to row.", Rule("encoding", (name,), encoding="DELTA_BINARY_PACKED"))
    return None


def bloom_suggestion(name: str, t: LogicalType, p: dict, footer: dict, present: bool) -> Suggestion | None:
    d = p.get("distinct") or footer.get("distinct") or 0
    if present or t.kind in ("LIST", "MAP", "STRUCT") or d < 10_000:
        return None
    return Suggestion(f"bloom:{name}", "bloom", "low", name, "none", "bloom filter", f"{d:,} distinct values: look-ups of single ones can skip most row groups.", rule=Rule("bloom", (name,)))


def clamp_rows(rows: float) -> int:
    if not math.isfinite(rows) or rows <= 0:
        return GROUP_ROWS_DEFAULT
    return round(max(GROUP_ROWS_MIN, min(rows, GROUP_ROWS_MAX)) / GROUP_ROWS_STEP) * GROUP_ROWS_STEP


def target_rows(compressed: int | None, rows: int | None) -> int:
    """Rows of a group of GROUP_BYTES at the measured bytes per row."""
    return clamp_rows(GROUP_BYTES / (compressed / rows)) if compressed and rows else GROUP_ROWS_DEFAULT


@dataclass(frozen=True)
class Layout:
    """The row groups of a source in a few numbers."""

    groups: int
    rows: int
    total: int
    least: int
    most: int


def layout_of(groups: list[dict]) -> Layout:
    sizes = [g["compressed"] for g in groups]
    return Layout(len(sizes), sum(g["num_rows"] for g in groups), sum(sizes), min(sizes, default=0), max(sizes, default=0))


def row_group_suggestions(groups: list[dict] | Layout, rows: int) -> list[Suggestion]:
    """At most one remark on sizes (groups: num_rows and compressed), and always the layout as it is."""
    a = groups if isinstance(groups, Layout) else layout_of(groups)
    if not a.groups:
        return []
    mean, mean_rows = a.total / a.groups, a.rows / a.groups
    found = None
    if a.groups == 1 and a.total < 8 * MIB:
        pass
    elif a.groups > 1 and mean < 8 * MIB:
        found = "size:small", "high" if mean < MIB else "medium", f"Groups of {format_human(mean)} on average are too small."
    elif mean > 256 * MIB:
        found = "size:large", "high" if mean > 1024 * MIB else "medium", f"Groups of {format_human(mean)} on average are too large."
    elif a.groups > 1 and a.total >= 16 * MIB and 0 < mean_rows < GROUP_ROWS_MIN:
        found = "rows:few", "low", f"Groups of {mean_rows:,.0f} rows on average are too short."
    elif a.groups > 1 and a.least > 0 and a.most / a.least > 5:
        found = "size:uneven", "low", f"Groups range from {format_human(a.least)} to {format_human(a.most)}."
    layout = f"{a.groups:,} row groups, {a.rows:,} rows, {format_human(a.total)}"
    out = [Suggestion("rowgroup:layout", "rowgroup", "low", None, layout, "—", "The row groups that readers can skip.")]
    if found:
        out.insert(0, Suggestion(f"rowgroup:{found[0]}", "rowgroup", found[1], None, layout, f"{rows:,} rows a group", found[2], rule=Rule("row_group", rows=rows)))
    return out


def file_suggestions(format_version: str | None) -> list[Suggestion]:
    """Version 1 files gain from a rewrite.  Spark's writer leaves this number at 1, so its own files are not held to it."""
    if format_version is not None and float(format_version) == 1:
        return [Suggestion("file:format-version", "file", "low", None, str(format_version), "rewrite", "Newer encodings and page indexes need a newer version.")]
    return []


def ordered(suggestions: list[Suggestion]) -> list[Suggestion]:
    return sorted(suggestions, key=lambda s: (CATEGORIES.index(s.category), SEVERITIES.index(s.severity)))


def actionable(suggestions: list[Suggestion]) -> set[str]:
    """The ids that are selected at first: all that change something."""
    return {s.id for s in suggestions if s.rule}


def toggled(selected: set[str], ids: list[str]) -> set[str]:
    """One or a group of suggestions switched: off if all are on, else on."""
    return selected - set(ids) if set(ids) <= selected else selected | set(ids)
