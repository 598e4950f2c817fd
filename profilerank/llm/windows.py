"""Repeated windows by anchors: what a phrase-based and a byte-based search share.

The anchor of a window is the gram with the smallest hash among its grams.  Equal windows
have equal anchors at the same place, so they meet under the anchor's hash, and
only documents whose anchors recur are looked at again.  Neighbouring windows mostly
share their anchor; such a run of windows is one row.
"""

from __future__ import annotations

import numpy as np

_POSITION_BITS = 20
_MASK = np.uint64((1 << _POSITION_BITS) - 1)


def _argmin_block(values: np.ndarray, width: int) -> np.ndarray:
    keys = (values.view(np.uint64) & ~_MASK) | np.arange(len(values), dtype=np.uint64)
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(keys)] = keys
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(keys) - width + 1
    return (np.minimum(behind[:n], ahead[width - 1:width - 1 + n]) & _MASK).astype(np.int64)


def sliding_argmin(values: np.ndarray, width: int, block: int = 1 << 19) -> np.ndarray:
    """Place of the smallest of each ``width`` neighbouring values; the first of equal ones."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    return np.concatenate([at + _argmin_block(values[at:at + min(block, n - at) + width - 1], width)
                           for at in range(0, n, block)])


def runs(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run with the same anchor."""
    first = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]]) if len(anchors) else np.empty(0, np.int64)
    return first, np.diff(np.r_[first, len(anchors)])


def union_mask(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the half-open spans."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0
