"""NumPy helpers over Arrow text columns, used inside tasks.

Texts of a batch stay one byte buffer with offsets.  Callers walk it in pieces of a bounded
number of bytes, so the memory of a task does not depend on the number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
PIECE_BYTES = 1 << 17


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column; null counts as empty."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(where, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts of about ``limit`` bytes."""
    data, offsets = buffer_of(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (shifts and multiplications that spread every bit)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; up to 2**20 of them are kept between calls."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 18), base, U64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if n <= 1 << 20:
            _POWERS[base] = known
    return known[:n]


class PrefixHash:
    """Hashes of any spans of a byte buffer from one prefix sum."""

    def __init__(self, data: np.ndarray, salt: int = 0):
        n = len(data)
        letters = mix(np.arange(1, 257, dtype=U64) * U64(0x632BE59BD9B4E019) + U64(salt))
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(letters[data] * powers(BASE, n), out=self.sums[1:])
        self.back = powers(BASE_INVERSE, n + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of bytes start..end-1; equal bytes give equal hashes wherever they stand."""
        h = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def windows(self, k: int) -> np.ndarray:
        """Mixed hash of the k bytes that start at each position."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[k:] - self.sums[:n]) * self.back[:n] + U64((k * 0xD6E8FEB86659FD93) % 2**64))


#: Low bits of a hash that give way to a position, so that one minimum finds value and place.
PLACE_BITS = 20


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the minimum of every window of w values, the rightmost where values tie.

    Values are compared by their upper 44 bits.
    """
    n, half = len(h) - w + 1, 1 << (PLACE_BITS - 1)
    if n <= 0:
        return np.zeros(0, np.int64)
    if w > half:
        raise ValueError(f"windows of at most {half} values")
    out = np.empty(n, np.int64)
    mask = U64((1 << PLACE_BITS) - 1)
    for first in range(0, n, half):
        part = h[first : first + half + w - 1]
        low, span = (part & ~mask) | (mask - np.arange(len(part), dtype=U64)), 1
        while span * 2 <= w:  # minima of spans of 1, 2, 4 ... values
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        size = min(half, n - first)
        low = np.minimum(low[:size], low[w - span : w - span + size])
        out[first : first + size] = (mask - (low & mask)).astype(np.int64) + first
    return out


def lower_table() -> np.ndarray:
    """Byte table that lower-cases A-Z."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


#: Bytes 0x20 and 0x09 to 0x0D separate words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word of a buffer; words do not cross texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = heads[1:] - 1
    last[tails[tails >= 0]] = inside[tails[tails >= 0]]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
