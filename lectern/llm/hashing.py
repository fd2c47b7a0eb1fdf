"""Vectorised 64-bit hashes of many stretches of one byte buffer."""

from __future__ import annotations

import numpy as np

PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(PRIME, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of PRIME and of its inverse, at least n of each."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        _powers[size] = tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, p, np.uint64)))) for p in (PRIME, _INVERSE))
    return _powers[size]


def stretches(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:stop]: differences of a running sum, shifted to one place, with the length."""
    up, down = _power(len(buf) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)])))
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))
