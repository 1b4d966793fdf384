"""The raw footer of a Parquet file: Thrift's compact encoding, read into dictionaries by field number.

pyarrow shows leaves only and no Bloom filters; the footer itself has every node of the schema and both.
"""

from __future__ import annotations

import struct

MAGIC = b"PAR1"
# Field numbers of the format's structures.
FILE_SCHEMA, FILE_ROW_GROUPS, GROUP_COLUMNS, CHUNK_META, META_BLOOM = 2, 4, 1, 3, 14
NODE_TYPE, NODE_LENGTH, NODE_REPETITION, NODE_NAME, NODE_CHILDREN, NODE_CONVERTED, NODE_SCALE, NODE_PRECISION, NODE_FIELD_ID = range(1, 10)
# The format's enumerations, in order.
TYPES = ("BOOLEAN", "INT32", "INT64", "INT96", "FLOAT", "DOUBLE", "BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY")
REPETITIONS = ("REQUIRED", "OPTIONAL", "REPEATED")
CONVERTED = (
    "UTF8", "MAP", "MAP_KEY_VALUE", "LIST", "ENUM", "DECIMAL", "DATE", "TIME_MILLIS", "TIME_MICROS", "TIMESTAMP_MILLIS", "TIMESTAMP_MICROS",
    "UINT_8", "UINT_16", "UINT_32", "UINT_64", "INT_8", "INT_16", "INT_32", "INT_64", "JSON", "BSON", "INTERVAL",
)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def varint(self) -> int:
        n = shift = 0
        while True:
            b = self.byte()
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    def number(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int):
        match kind:
            case 1 | 2:  # in lists a byte of its own; in structures the type tells
                return self.byte() == 1
            case 3:
                return struct.unpack("b", bytes([self.byte()]))[0]
            case 4 | 5 | 6:
                return self.number()
            case 7:
                self.at += 8
                return struct.unpack_from("<d", self.data, self.at - 8)[0]
            case 8:
                n = self.varint()
                self.at += n
                return self.data[self.at - n : self.at]
            case 9 | 10:
                head = self.byte()
                n = head >> 4
                n = self.varint() if n == 15 else n
                return [self.value(head & 15) for _ in range(n)]
            case 11:
                n = self.varint()
                kinds = self.byte() if n else 0
                return {self.value(kinds >> 4): self.value(kinds & 15) for _ in range(n)}
            case 12:
                return self.fields()
        raise ValueError(f"unknown type {kind} in a footer")

    def fields(self) -> dict:
        out, number = {}, 0
        while head := self.byte():
            number = number + (head >> 4) if head >> 4 else self.number()
            kind = head & 15
            out[number] = kind == 1 if kind in (1, 2) else self.value(kind)
        return out


def decoded(footer: bytes) -> dict:
    """The file's metadata by field number."""
    return _Reader(footer).fields()


def nodes(meta: dict):
    """(path, physical, length, repetition, children, converted, precision, scale, field id, logical) of every node, the root first."""
    elements = iter(meta[FILE_SCHEMA])

    def walk(above: list[str], root: bool):
        e = next(elements)
        name = e[NODE_NAME].decode(errors="replace")
        path = [] if root else [*above, name]
        known = lambda names, k: names[e[k]] if k in e and e[k] < len(names) else None
        yield (path, name, known(TYPES, NODE_TYPE), e.get(NODE_LENGTH), known(REPETITIONS, NODE_REPETITION), e.get(NODE_CHILDREN), known(CONVERTED, NODE_CONVERTED), e.get(NODE_PRECISION), e.get(NODE_SCALE), e.get(NODE_FIELD_ID))
        for _ in range(e.get(NODE_CHILDREN) or 0):
            yield from walk(path, False)

    yield from walk([], True)


def blooms(meta: dict) -> list[list[bool]]:
    """For each row group and leaf, whether it has a Bloom filter."""
    return [[META_BLOOM in c.get(CHUNK_META, {}) for c in g[GROUP_COLUMNS]] for g in meta.get(FILE_ROW_GROUPS, [])]
