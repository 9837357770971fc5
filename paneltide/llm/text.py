"""Vectorised scanning of Arrow text batches: words, rolling hashes, groups of rows of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix, element by element."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, and a random value for each byte."""
    up, down = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
    for out, base in ((up, _BASE), (down, pow(_BASE, -1, 1 << 64))):
        out[:] = np.uint64(base)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return up, down, mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _powers(1 << max(20, int(n).bit_length()))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows in a row, and the n + 1 offsets of the rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.binary()):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if column.type == pa.string() else b"")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in slices of at most `limit` bytes of text or one row: it bounds what a task holds."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at, off = 0, utf8(batch.column(column))[1]
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


class Rolling:
    """Prefix hashes of a byte array: the hash of any substring in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down, values = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word, a longest run of bytes for which `inside` (of 256) holds; rows end words."""
    solid = inside[data]
    first = off[:-1][np.diff(off) > 0]
    before = np.empty_like(solid)
    before[:1], before[1:] = False, solid[:-1]
    before[first] = False
    after = np.empty_like(solid)
    after[-1:], after[:-1] = False, solid[1:]
    after[first[1:] - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, code point and number of bytes of each character of valid UTF-8 beyond ASCII."""
    at = np.flatnonzero(data >= 0xC0)
    near = lambda k: data[np.minimum(at + k, len(data) - 1)].astype(np.int32) & 63
    b, c1, c2, c3 = data[at].astype(np.int32), near(1), near(2), near(3)
    size = 2 + (b >= 0xE0) + (b >= 0xF0)
    return at, np.where(size == 2, (b & 31) << 6 | c1, np.where(size == 3, (b & 15) << 12 | c1 << 6 | c2, (b & 7) << 18 | c1 << 12 | c2 << 6 | c3)), size


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from first[i] on, size[i] of them, for each i in a row."""
    return np.arange(int(size.sum())) + np.repeat(first - np.cumsum(size) + size, size)


def per_row(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets (n + 1) of each row in an array whose element i belongs to rows[i], rows rising."""
    return np.searchsorted(rows, np.arange(n + 1), side="left")
