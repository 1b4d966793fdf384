"""Secret scan: fixed patterns, and assignment-aware lexing that scores literals by the names they reach.

The base kinds are three patterns, each matched leftmost and non-overlapping, of which too short ones drop
out.  The lexer (``lexing``) reads source and configuration syntax into name-literal pairs and propagates constants
through names; a literal is scored by its own shape and by the most sensitive name that it reaches.  It adds spans
of kind ``literal``; the base spans stay.  A literal of several strings that are joined has a span for each.

Spans are (kind, start, end) in code points, end exclusive: the whole match for base kinds, the literal's
inside for the lexer's.  Defined results: null and empty texts have no spans; repeated rows repeat theirs.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from . import common
from .lexing import VALUE_NAMES, Pair, options_of, pairs_of, propagated

# The base kinds, their patterns and the fewest characters that count.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS, ACCESS_CHARS = 12, 18

#: Parts of names and how strongly they tell that the value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "authkey": 0.9, "signingkey": 0.9, "encryptionkey": 0.9, "auth": 0.6,
    "bearer": 0.7, "salt": 0.5, "signature": 0.4, "key": 0.4,
}
#: Parts of names that tell the value is about a secret rather than one.
HARMLESS = {"name", "file", "path", "url", "uri", "id", "field", "label", "length", "type", "hint", "count", "policy", "prefix", "expiry", "ttl"}
PLACEHOLDERS = {"changeme", "example", "placeholder", "password", "secret", "none", "null", "undefined", "true", "false", "todo", "your", "test", "xxxx"}
#: Least score of a literal that is reported, and least characters of one.
LEAST_SCORE, LEAST_CHARS = 0.75, 8

#: No name is sensitive without one of these.
HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "auth", "bearer", "salt", "signature")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """How sensitive a name is, by its parts and pairs of parts."""
    parts = [p.lower() for p in _CAMEL.findall(name)]
    parts = [p[:-1] if p[:-1] in SENSITIVE else p for p in parts]  # plurals
    score = max([0.0, *(SENSITIVE.get(p, 0.0) for p in parts), *(SENSITIVE.get(a + b, 0.0) for a, b in zip(parts, parts[1:], strict=False))])
    return score * 0.3 if parts and parts[-1] in HARMLESS else score


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: length, entropy, classes of characters; placeholders do not."""
    low = value.lower()
    if len(value) < LEAST_CHARS or low in PLACEHOLDERS or re.search(r"\s", value) or len(set(value)) < 4 or low.startswith(("http://", "https://", "your", "<", "${", "{{")):
        return 0.0
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    classes = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.25 + 0.1 * min(bits, 4.5) + 0.1 * classes + (0.1 if len(value) >= 20 else 0.0))


def pair_score(p: Pair) -> float:
    """The sensitivity of a pair's names: of those around it only if its own says no more than that it is a value."""
    if p.name.rpartition(".")[2].lower() in VALUE_NAMES:
        return max([name_score(p.name), *map(name_score, p.around)])
    return name_score(p.name)


def literal_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals whose own shape and most sensitive reached name score together at least LEAST_SCORE."""
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    pairs = sorted(pairs_of(text) + options_of(text), key=lambda p: p.place)
    assigned = {p.name for p in pairs if not p.spaced}
    found = set()
    for p, reach in zip(pairs, propagated(pairs, pair_score), strict=True):
        if reach >= 0.5:
            for spans in p.literals:
                value = "".join(text[a:b] for a, b in spans)
                if p.spaced and not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)):
                    continue  # a word of prose
                if value not in assigned and math.sqrt(reach * literal_score(value)) >= LEAST_SCORE:
                    found.update(spans)
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of the three base kinds, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def shown(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of kind, start, end), n_assign, n_access, n_hex and base_sha256 for every row of docs."""
    import pyarrow as pa

    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        common.claim("secrets")
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                counts, digests, spans = ([], [], []), [], []
                for text in part.column(1).to_pylist():
                    base = base_spans(text or "")
                    extra = [(a, 3, b) for a, b in literal_spans(text or "")]
                    for k in range(3):
                        counts[k].append(sum(s[1] == k for s in base))
                    digests.append(hashlib.sha256(shown(base).encode()).hexdigest())
                    spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base + extra)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(spans, pa.list_(span)), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests)],
                    names=["doc_id", "spans", "n_assign", "n_access", "n_hex", "base_sha256"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string"
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, schema)
