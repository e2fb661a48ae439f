"""Vectorised text kernels over Arrow string columns."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: UTF-8 bytes that a kernel takes at once, unless one text alone has more.
SLICE = 500_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finish of 64-bit values: every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its values; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs ``[i, j)`` of values with at most ``limit`` bytes together, or of one value."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = j


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random value per byte, A-Z as a-z; and which bytes are white space."""
    values = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
    values[65:91] = values[97:123]
    space = np.zeros(256, bool)
    space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return values, space


@functools.lru_cache(maxsize=1)
def _largest() -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << 20)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def prefix_sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the values times powers of the base before each place, and powers of the base's inverse."""
    up, down = _largest() if len(values) < 1 << 20 else _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return total, down


def hashes_of(total: np.ndarray, down: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans from ``prefix_sums``."""
    return mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * _M2)


def span_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of a sequence of 64-bit values: equal spans, equal hashes."""
    return hashes_of(*prefix_sums(values), begin, end)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each value, A-Z in lower case, and where each value's words begin."""
    values, space = _tables()
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    at = offsets - base
    word = ~space[part]
    starts_value = np.zeros(len(part) + 1, bool)
    starts_value[at] = True
    before = np.empty(len(part), bool)
    before[:1] = False
    before[1:] = word[:-1]
    begin = np.flatnonzero(word & (~before | starts_value[:-1]))
    after = np.empty(len(part), bool)
    after[-1:] = False
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | starts_value[1:])) + 1
    return span_hashes(values[part], begin, end), np.searchsorted(begin, at)


#: Multipliers of the words of a shingle, by place.
_PLACES = np.random.default_rng(12).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each value the sorted distinct hashes of its ``k``-word shingles.

    With fewer words, the whole sequence is the one shingle; without words the
    set is empty.
    """
    words, at = word_hashes(data, offsets)
    n = max(0, len(words) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for place in range(k):
        rolled += words[place : place + n] * _PLACES[place]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            keep = np.empty(len(s), bool)
            keep[:1] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            short = (words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mixed(short + np.full(1, b - a, np.uint64) * _M1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def each_set(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """``shingle_sets`` of a whole column, in slices."""
    data, offsets = utf8(column)
    for i, j in slices(offsets):
        yield from shingle_sets(data, offsets[i : j + 1], k)
