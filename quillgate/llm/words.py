"""Vectorised hashing of words and shingles over UTF-8 buffers.

A word is a run of bytes outside [\\x20\\x09-\\x0D], with A-Z lowered. Its 64-bit hash is a polynomial in an odd
base over random byte values, finished with a bijective mixer, so equal words hash alike in every task.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers with full avalanche."""
    x = x ^ U(salt)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
    values[65:91] = values[97:123]
    values[_SPACE] = 0
    return values


_VALUES = _byte_values()
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        for base in (_BASE, inverse):
            steps = np.full(max(n, _SEGMENT), base, U)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=U))
        _powers = (tables[0], tables[1])
    return _powers


def _hash_segment(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of one buffer; no word crosses a position in `edges`."""
    n = len(data)
    space = _SPACE[data]
    after_space = np.empty(n, bool)
    after_space[0] = True
    after_space[1:] = space[:-1]
    after_space[edges[edges < n]] = True
    starts = np.flatnonzero(after_space & ~space)
    if not len(starts):
        return np.zeros(0, U), starts
    power, inverse = _power_tables(n)
    values = _VALUES[data]
    values *= power[:n]
    return mix(np.add.reduceat(values, starts) * inverse[starts]), starts


def _cut(data: np.ndarray, offsets: np.ndarray, lo: int) -> int:
    """The end of the segment that starts at lo: after a whitespace byte or at a row's edge, so no word is split."""
    n = len(data)
    hi = min(n, lo + _SEGMENT)
    if hi == n:
        return n
    spaces = np.flatnonzero(_SPACE[data[lo:hi]])
    end = max(int(offsets[np.searchsorted(offsets, hi, "right") - 1]), lo + int(spaces[-1]) + 1 if len(spaces) else lo)
    while end <= lo:  # one word longer than a segment
        if hi == n:
            return n
        after = min(n, hi + _SEGMENT)
        spaces = np.flatnonzero(_SPACE[data[hi:after]])
        edge = int(offsets[np.searchsorted(offsets, hi, "left")])
        found = [x for x in ([hi + int(spaces[0]) + 1] if len(spaces) else []) + [edge] if x <= after]
        end, hi = min(found, default=lo), after
    return end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets of each row's words) for rows given by byte offsets."""
    hashes, starts, lo, n = [], [], 0, len(data)
    while lo < n:
        hi = _cut(data, offsets, lo)
        h, s = _hash_segment(data[lo:hi], offsets[(offsets >= lo) & (offsets < hi)] - lo)
        hashes.append(h)
        starts.append(s + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int = 5):
    """Yield each row's sorted distinct shingle hashes; fewer than `width` words make one shingle, none make none."""
    weights = [U(pow(_BASE, 2 * k + 3, 1 << 64) | 1) for k in range(width)]
    n = len(words)
    if n >= width:
        total = np.zeros(n - width + 1, U)
        for k in range(width):
            total += words[k : n - width + 1 + k] * weights[k]
        total = mix(total, 0x5851F42D4C957F2D)
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= width:
            yield np.unique(total[a : b - width + 1])
        elif b > a:
            short = U(0)
            with np.errstate(over="ignore"):
                for k in range(b - a):
                    short = short + words[a + k] * weights[k]
            yield mix(np.array([short], U), 0x14057B7EF767814F + int(b - a))
        else:
            yield np.zeros(0, U)
