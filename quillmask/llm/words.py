"""Words of Arrow text columns, found and hashed for whole batches with numpy.

A word is a longest run of code points outside U+0020 and U+0009 to U+000D. Those six are single bytes in UTF-8 and never
part of another character, so words can be cut on bytes. A batch is worked on in pieces of about PIECE bytes, whole
documents each, so that memory follows the piece (or the longest document) and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Places of a byte within a block, each with its own table of random numbers.
_PLACES = 32
_tables: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every bit of a 64-bit number over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(which: int) -> np.ndarray:
    """256 random numbers for each place of a block."""
    if which not in _tables:
        n = np.arange(_PLACES * 256, dtype=np.uint64)
        _tables[which] = mix(mix(n + np.uint64(0x9E3779B97F4A7C15 + which)) + np.uint64(which))
    return _tables[which]


def range_hash(data: np.ndarray, start: np.ndarray, stop: np.ndarray, which: int) -> np.ndarray:
    """Hashes of data[start:stop] for ascending ranges that do not overlap: tabulation hashing. Every byte stands for a random
    number that depends on its place, blocks of 32 bytes are added up and mixed by their number, so no pattern of bytes has
    the same hash as another one by its structure (polynomials modulo 2^64 collide on Thue-Morse words)."""
    size = stop - start
    if not len(start):
        return np.zeros(0, np.uint64)
    owner = np.repeat(start, np.diff(np.append(start, len(data))))
    place = (np.arange(start[0], len(data)) - owner) & (_PLACES - 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_table(which)[(place << 8) + data[start[0] :]], out=run[start[0] + 1 :])
    blocks = np.maximum(-(-size // _PLACES), 1)
    first = np.cumsum(blocks) - blocks
    nth = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    a = np.repeat(start, blocks) + nth * _PLACES
    b = np.minimum(a + _PLACES, np.repeat(stop, blocks))
    total = np.add.reduceat(mix(run[b] - run[a] + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), first)
    return mix(total + mix(size.astype(np.uint64) + np.uint64(0xC2B2AE3D27D4EB4F)))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b + np.uint64(0xA0761D6478BD642F)))


def window_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of values[i : i + k] for every i, put together from runs of 1, 2, 4, ... values."""
    n, wide, size, out, have = len(values), values, 1, None, 0
    if n < k:
        return np.zeros(0, np.uint64)
    while True:
        if k & size:
            m = n - have - size + 1
            out = wide[:m] if out is None else _pair(out[:m], wide[have : have + m])
            have += size
        if 2 * size > k:
            return out[: n - k + 1]
        wide = _pair(wide[: len(wide) - size], wide[size:])
        size *= 2


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return pc.fill_null(column.cast(pa.large_string()), "")


def offsets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a large_string array."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many bytes."""
    _, off = offsets_of(column)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class Words:
    """Words of a few documents: start and stop byte, document, and the first word of each document."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.n = len(column)
        self.data, self.off = offsets_of(column)
        if lower:
            self.data = _LOWER[self.data]
        inside = ~_SPACE[self.data]
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        edge = self.off[1:-1]
        before[edge[edge < len(inside)]] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        last = self.off[1:-1] - 1
        after[last[(last >= 0) & (last < len(inside))]] = False
        self.stop = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(self.off, self.start, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(self.n + 1))

    def hashes(self, which: int = 0) -> np.ndarray:
        return range_hash(self.data, self.start, self.stop, which)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all k-word windows that lie within one document."""
        if len(hashes) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: len(hashes) - k + 1] == self.doc[k - 1 :])
        return at, window_hash(hashes, k)[at]
