"""64-bit hashes of many byte ranges of one buffer, from prefix sums.

The hash of a range is sum(T[byte] * P**i) mod 2**64 with a random table T,
made independent of its place by the inverse powers and then mixed.  Any
number of overlapping ranges costs one pass over the buffer.
"""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_SEED = 20240229
_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _TABLES.get("pow")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        _TABLES["pow"] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _P, np.uint64)], dtype=np.uint64)
        _TABLES["inv"] = np.cumprod(
            np.r_[np.uint64(1), np.full(size - 1, pow(_P, -1, 1 << 64), np.uint64)], dtype=np.uint64)
    return _TABLES["pow"], _TABLES["inv"]


def _table() -> np.ndarray:
    if "bytes" not in _TABLES:
        _TABLES["bytes"] = np.random.default_rng(_SEED).integers(1, 1 << 64, 256, dtype=np.uint64)
    return _TABLES["bytes"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class RangeHashes:
    """Prefix sums of one buffer; ``of(starts, ends)`` hashes its ranges."""

    def __init__(self, buffer: bytes | memoryview | np.ndarray):
        a = buffer if isinstance(buffer, np.ndarray) else np.frombuffer(buffer, np.uint8)
        power, self._inverse = _powers(len(a) + 1)
        self._sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_table()[a] * power[:len(a)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes as int64.  Ranges of equal length and bytes have equal hashes."""
        h = (self._sums[ends] - self._sums[starts]) * self._inverse[starts]
        return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))).view(np.int64)


def word_bounds(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in ``b" ".join(words)``."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return ends - lengths, ends


def gram_hashes(words: list[bytes], n: int, block: int = 1 << 17) -> np.ndarray:
    """Hashes of all runs of ``n`` words; blocks bound the memory of a very long text."""
    if len(words) < n:
        return np.empty(0, np.int64)
    parts = []
    for at in range(0, len(words) - n + 1, block):
        some = words[at:at + block + n - 1]
        starts, ends = word_bounds(some)
        parts.append(RangeHashes(b" ".join(some)).of(starts[:len(some) - n + 1], ends[n - 1:]))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)
