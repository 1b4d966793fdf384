"""Token counts by batch encoding in Arrow functions that return lengths only.

Texts are cut at white space, where the tokenizer never joins two sides, and long runs without any between letters
and marks, so a long text needs no long encoding unless it is one word; the distinct pieces of a slice of rows are encoded by the library in batches of equal bytes, and
only their lengths are kept.  Row slices are balanced by bytes, not rows.

Defined results: null and empty texts have no bytes and no tokens; repeated rows repeat their
counts; rows without an identifier are counted like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import common
from .tokenizing import encode_pieces, split_at_spaces, split_before_spaces, split_long

#: Distinct pieces whose lengths a worker keeps.
CACHED = 250_000
#: Bytes of text that are cut and counted together.
SLICE_BYTES = 1 << 20

_lengths: dict[tuple, dict[str, int]] = {}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", drops_spaces: bool = True) -> DataFrame:
    """doc_id, n_bytes and n_tokens for every row; drops_spaces: whether the tokenizer ignores white space."""
    import pyarrow as pa
    import pyarrow.compute as pc

    cut = split_at_spaces if drops_spaces else split_before_spaces

    def run(batches):
        known = _lengths.setdefault((path, drops_spaces), {})
        common.claim("token_counts", known.clear)
        for batch in batches:
            for a, b in common.slices_by_bytes(batch.column(1), SLICE_BYTES):
                texts = batch.column(1).slice(a, b - a)
                pieces = [split_long(cut(t or "")) for t in texts.to_pylist()]
                new = list(set().union(*pieces).difference(known))
                known.update(zip(new, map(len, encode_pieces(path, new)), strict=True))
                counts = [sum(map(known.__getitem__, p)) for p in pieces]
                if len(known) > CACHED:
                    known.clear()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
