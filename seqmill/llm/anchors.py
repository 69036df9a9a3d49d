"""Winnowed anchors: positions that any two equal windows choose alike."""

from __future__ import annotations

import numpy as np

from seqmill.llm.common import _BASE, mix, powers

_INVERSE = np.array([pow(int(b), -1, 2**64) for b in _BASE], dtype=np.uint64)


class Ranges:
    """Hash of any range of a sequence of 64-bit values, from prefix sums modulo 2^64."""

    def __init__(self, values: np.ndarray, which: int = 0) -> None:
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(n, which), out=self.sums[1:])
        back = np.full(n + 1, _INVERSE[which], np.uint64)
        back[0] = 1
        self.back = np.cumprod(back, dtype=np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k : k + n] - self.sums[:n]) * self.back[:n])


def winnow(ranges: Ranges, rows: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share an anchor: anchor position, first and last window start, anchor hash.

    Every window of ``length`` values within one row chooses its k-gram of smallest hash, the
    leftmost on ties, so equal windows anywhere choose the same k-gram at the same offset.
    """
    none = np.zeros(0, np.int64)
    n = len(rows) - length + 1
    if n <= 0:
        return none, none, none, none.astype(np.uint64)
    grams = ranges.grams(k)
    bits = np.uint64(int(len(rows)).bit_length())
    low = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
    w, span = length - k + 1, 1
    while span < w:
        step = min(span, w - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    starts = np.flatnonzero(rows[:n] == rows[length - 1 :])
    anchor = (low[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(starts)])) - 1 if len(first) else first
    return anchor[first], starts[first], starts[last], grams[anchor[first]]
