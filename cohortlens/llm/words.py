"""Words of an Arrow text column as 64-bit numbers, found and hashed with numpy.

Works on the UTF-8 bytes of the column, so no Python string is made. Memory is bounded
by the bytes of a slice (``SLICE_BYTES``, or one text where that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
HASH_BYTES = 1 << 17
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_numbers(n: int, seed: int) -> np.ndarray:
    first = np.uint64(seed * 0x632BE59BD9B4E019 % (1 << 64))
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * MULTIPLIER + first)


#: Letters A-Z hash like a-z.
BYTE_VALUES = random_numbers(256, 1)
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Word bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~SPACES
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = 0xD1342543DE82EF95
_POW: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = HASH_BYTES
    while size < n:
        size *= 2
    if size > HASH_BYTES:
        return _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    if not _POW:
        _POW["up"], _POW["down"] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _POW["up"], _POW["down"]


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit number for each byte range, equal for equal bytes up to the case of A-Z."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, low + HASH_BYTES, "right")))
        s, e = starts[at:stop] - low, ends[at:stop] - low
        part = BYTE_VALUES[data[low : low + e[-1]]]
        up, down = _tables(len(part) + 1)
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part * up[: len(part)], out=sums[1:])
        value = (sums[e] - sums[s]) * down[s]
        out[at:stop] = mixed(value ^ ((e - s).astype(np.uint64) * MULTIPLIER))
        at = stop
    return out


class Words(NamedTuple):
    """Words of rows ``first`` to ``first + len(counts)`` of a column."""

    first: int
    data: np.ndarray  # bytes of these rows
    offsets: np.ndarray  # of each row in data, and the end
    starts: np.ndarray  # of each word in data
    ends: np.ndarray
    counts: np.ndarray  # words of each row

    def bounds(self) -> np.ndarray:
        """Of each row in the list of words, and the end."""
        return np.concatenate(([0], np.cumsum(self.counts)))


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = column.offset
    off = np.frombuffer(offsets, kind)[at : at + len(column) + 1] if len(column) else np.zeros(1, kind)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), off.astype(np.int64)


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    at, n = 0, len(off) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, stop
        at = stop


def words_of(column: pa.Array, word_bytes: np.ndarray, most: int = SLICE_BYTES) -> Iterator[Words]:
    data, off = byte_rows(column)
    for first, stop in slices(off, most):
        part, own = data[off[first] : off[stop]], off[first : stop + 1] - off[first]
        inside = word_bytes[part]
        before, after = np.zeros(len(part), bool), np.zeros(len(part), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = own[1:-1][own[1:-1] < len(part)]
        before[edges] = False
        edges = own[1:-1][own[1:-1] > 0] - 1
        after[edges] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        counts = np.diff(np.searchsorted(starts, own))
        yield Words(first, part, own, starts, ends, counts)
