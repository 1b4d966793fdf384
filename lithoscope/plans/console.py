"""The SQL console: Spark SQL over the catalog's views, with some of DuckDB's dialect understood.

``read_parquet('alias')`` is the alias's view; ``* EXCLUDE (a)`` is ``* EXCEPT (a)``; ``* REPLACE (e AS a)`` is ``* EXCEPT (a), e AS a``
(the column comes last); ``a // b`` is ``a DIV b``; ``USING SAMPLE n ROWS`` or ``n %`` at the end samples the statement's rows.
Strings, quoted names and comments are left as they are.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_READ = re.compile(r"read_parquet\s*\(\s*'((?:[^']|'')*)'\s*\)", re.IGNORECASE)
_KEPT = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/", re.DOTALL)
_SAMPLE = re.compile(r"\s+USING\s+SAMPLE\s+(?:RESERVOIR\s*\(\s*)?(\d+(?:\.\d+)?)\s*(%|PERCENT|ROWS)?\s*\)?\s*\Z", re.IGNORECASE)
_REPLACE = re.compile(r"\*\s*REPLACE\s*\(", re.IGNORECASE)
_EXCLUDE = re.compile(r"(\*\s*)EXCLUDE\b", re.IGNORECASE)
_EXCLUDED = re.compile(r"(\*\s*EXCEPT\s+)([A-Za-z_]\w*)(?!\w|\s*\()", re.IGNORECASE)


def _parts(inside: str) -> list[str]:
    """What lies between the commas outside of brackets."""
    out, depth = [""], 0
    for ch in inside:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def _replaced(sql: str) -> str:
    """``* REPLACE (e AS a, ...)`` as ``* EXCEPT (a, ...), e AS a, ...``."""
    while m := _REPLACE.search(sql):
        at, depth = m.end(), 1
        while at < len(sql) and depth:
            depth += (sql[at] == "(") - (sql[at] == ")")
            at += 1
        items = [p.strip() for p in _parts(sql[m.end() : at - 1])]
        names = [re.split(r"\s+AS\s+", p, flags=re.IGNORECASE)[-1] for p in items]
        sql = f"{sql[: m.start()]}* EXCEPT ({', '.join(names)}), {', '.join(items)}{sql[at:]}"
    return sql


def rewrite(sql: str) -> str:
    """The statement in Spark's dialect, without a closing semicolon."""
    text = _READ.sub(lambda m: "`" + m[1].replace("''", "'").replace("`", "``") + "`", sql.strip()).rstrip(";").rstrip()
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m[0])
        return f"\0{len(kept) - 1}\0"

    text = _KEPT.sub(keep, text)
    text = _replaced(_EXCLUDED.sub(r"\1(\2)", _EXCLUDE.sub(r"\1EXCEPT", text))).replace("//", " DIV ")
    sample = _SAMPLE.search(text)
    if sample:
        inner, n, unit = text[: sample.start()], sample[1], (sample[2] or "ROWS").upper()
        share = unit in ("%", "PERCENT")
        text = f"SELECT * FROM ({inner}) WHERE rand() < {n} / 100.0" if share else f"SELECT * FROM ({inner}) ORDER BY rand() LIMIT {n}"
    return re.sub("\0(\\d+)\0", lambda m: kept[int(m[1])], text)


def run_sql(spark: SparkSession, sql: str, args: dict | list | None = None) -> DataFrame:
    """The statement's rows, lazily; parameters are bound, never pasted."""
    text = rewrite(sql)
    return spark.sql(text, args=args) if args else spark.sql(text)


class Snippets:
    """Named statements, saved, overwritten and deleted by name; kept in a JSON file if one is given."""

    def __init__(self, path: str | None = None):
        self.path = Path(path) if path else None
        self.saved: dict[str, str] = json.loads(self.path.read_text()) if self.path and self.path.exists() else {}

    def _keep(self) -> None:
        if self.path:
            self.path.write_text(json.dumps(self.saved, indent=1))

    def save(self, name: str, sql: str) -> None:
        self.saved[name] = sql
        self._keep()

    def delete(self, name: str) -> None:
        self.saved.pop(name, None)
        self._keep()
