"""Hashes of ranges of a sequence, and places of least values in sliding windows."""

from __future__ import annotations

import numpy as np

from lexiline.llm.common import mixed

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Ranges:
    """Hashes of any ranges of a sequence of word hashes."""

    def __init__(self, h: np.ndarray):
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(h * powers(BASE, len(h))[: len(h)], dtype=np.uint64)])
        self.inverse = powers(INVERSE, len(h))

    def of(self, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mixed((self.sums[first + length] - self.sums[first]) * self.inverse[first] + length.astype(np.uint64))


def least_places(g: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` values the place of the least (the first of equal ones)."""
    at, have = np.arange(len(g)), 1
    while have < span:
        step = min(have, span - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(g[left] <= g[right], left, right)
        have += step
    return at
