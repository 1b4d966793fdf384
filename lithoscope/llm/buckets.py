"""Bucket identifiers of suffixes: refinement by those at later offsets, and the least of neighbours."""

from __future__ import annotations

import numpy as np

from . import common

#: The low bits of an identifier that hold its place, and places that are taken together.
_PLACE, _TOGETHER = np.uint64((1 << 24) - 1), 1 << 23


def refine(ids: np.ndarray, depth: int, times: int) -> np.ndarray:
    """Bucket identifiers at ``times`` x depth from those at depth: a later offset's are combined with each suffix's own."""
    n = max(0, len(ids) - depth * (times - 1))
    out = ids[:n].copy()
    for k in range(1, times):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += ids[k * depth : k * depth + n]
    return common.mix(out)


def least_in_reach(q_ids: np.ndarray, reach: int) -> np.ndarray:
    """For each place, where the least of the next ``reach`` identifiers is (the leftmost of equals)."""
    n = len(q_ids)
    if n > _TOGETHER + reach:
        parts = range(0, n - reach + 1, _TOGETHER)
        return np.concatenate([least_in_reach(q_ids[at : at + _TOGETHER + reach - 1], reach) + at for at in parts])
    blocks = -(-n // reach)
    keyed = np.full(blocks * reach, np.iinfo(np.uint64).max, np.uint64)
    keyed[:n] = q_ids & ~_PLACE
    keyed[:n] |= np.arange(n, dtype=np.uint64)
    grid = keyed.reshape(blocks, reach)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - reach + 1
    return (np.minimum(behind[:m], ahead[reach - 1 : reach - 1 + m]) & _PLACE).astype(np.int64)
