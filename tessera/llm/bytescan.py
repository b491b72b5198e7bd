"""Vectorised word scanning and hashing over Arrow binary columns.

Every text operator of this subpackage looks at UTF-8 bytes, a bounded chunk
at a time: whole texts, but never more than ``CHUNK_BYTES`` of them at once
(a single longer text is its own chunk). Words are 64-bit hashes; whoever
needs exactness beyond 64 bits verifies on the bytes or adds the second lane.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` on bytes: digits, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: ``[^\x20\x09-\x0D]`` on bytes.
BLACK = np.ones(256, dtype=bool)
BLACK[9:14] = BLACK[32] = False


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + _U(seed)) | _U(1)


#: Values of the first places of a span, one row of 256 per place and lane (see :func:`place_values`).
_NEAR = 64
_TABLE = [mix(np.arange((_NEAR + 1) * 256, dtype=np.uint64) * _BASE + _U(lane + 1)) for lane in range(2)]
_STEP = _U(0xD1B54A32D192ED03)


def place_values(units: np.ndarray, place: np.ndarray, lane: int = 0) -> np.ndarray:
    """A random 64-bit number for each (unit, place in its span): no sum of them is
    a polynomial, so no family of spans (say complementary ones) collides by its form."""
    if units.dtype != np.uint8:
        return mix(mix(units.astype(np.uint64) + _U(lane + 1)) + place.astype(np.uint64) * _STEP)
    near = np.minimum(place, _NEAR)
    near <<= 8
    near |= units
    out = _TABLE[lane][near]
    if near.max(initial=0) >= _NEAR << 8:
        far = np.flatnonzero(near >= _NEAR << 8)
        out[far] = mix((place[far].astype(np.uint64) << _U(8) | units[far]) * _BASE + _U(lane + 1))
    return out


def span_hashes(units: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of ``units`` (bytes, code points or word hashes): the
    values of its units at their places in the span, summed and mixed with the length.
    Starts must ascend and spans not overlap. ``lane`` 1 is a second, independent hash."""
    n = len(units)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    begin = np.concatenate([[0], start, [n]]).astype(np.int32)  # Arrow's own bound
    place = np.arange(n, dtype=np.int32)
    place -= np.repeat(begin[:-1], np.diff(begin))
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(place_values(units, place, lane), out=total[1:])
    return mix(total[end] - total[start] + (end - start).astype(np.uint64) * _STEP)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``limit`` bytes (or one row)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of a chunk: ``start``/``end`` byte positions, ``doc`` row numbers,
    ``first`` (word number at which each row starts, one more entry than rows)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> None:
        self.data = LOWER[data]
        n = len(data)
        inside = table[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            before &= ~edge[:n]
            after &= ~edge[1:]
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.start, self.end, lane)

    def text(self, i: int, j: int) -> bytes:
        """Words ``i`` to ``j`` (exclusive), joined by single spaces."""
        body = self.data
        return b" ".join(body[s:e].tobytes() for s, e in zip(self.start[i:j].tolist(), self.end[i:j].tolist(), strict=True))


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Order-sensitive hash of every run of ``size`` word hashes (run ``i`` starts at word ``i``)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j, c in enumerate(odd_constants(size, 1000 + seed)):
        total += words[j : j + n] * c
    return mix(total + _U(size))


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments given by ``first`` (one entry more than segments)."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), dtype=values.dtype), np.cumsum(values, axis=0, dtype=values.dtype)])
    return total[first[1:]] - total[first[:-1]]
