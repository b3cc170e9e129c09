"""Hashes of code sequences, bytes or words, in numpy."""

from __future__ import annotations

import numpy as np


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser over uint64."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BYTE_CODES = np.random.default_rng(0x5EED).integers(0, 2**64, 256, np.uint64, endpoint=False)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse for i < n, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        for k, b in enumerate((BASE, INVERSE)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Prefix:
    """Polynomial hashes of any range of a code sequence, from one running sum."""

    def __init__(self, codes: np.ndarray):
        self.up, self.down = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.up[: len(codes)], out=self.sums[1:])

    def all(self, k: int) -> np.ndarray:
        """Of every k consecutive codes."""
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k : k + n] - self.sums[:n]) * self.down[:n])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))
