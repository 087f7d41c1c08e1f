"""Texts of a record batch as numpy arrays: bytes, words, shingles and their 64-bit names.

A batch is worked on in runs of bounded size, so the memory of a task does not
depend on how many rows a batch has. Names are polynomial hashes read off one
running sum, so the name of any span costs two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words are runs of anything but ASCII white space.
BLANK_SEPARATED = ~_SPACE
#: Words are runs of ASCII letters and digits and of bytes beyond ASCII.
ALPHANUMERIC = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=np.uint64)


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    values = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(values.type):
        return np.empty(0, np.uint8), np.zeros(len(values) + 1, np.int64)
    if values.null_count:
        values = pc.fill_null(values, pa.scalar("", values.type))
    values = values.cast(pa.large_string())
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def texts(batch: pa.RecordBatch, name: str, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, bytes and offsets of each run of the column."""
    data, offsets = column(batch, name)
    for i, j in runs(offsets, limit):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 2**64)
    grow = [np.full(n, b, np.uint64) for b in (_BASE, inverse)]
    for g in grow:
        g[0] = 1
        np.cumprod(g, out=g)
    return grow[0], grow[1]


class Names:
    """64-bit names of spans of `data`."""

    def __init__(self, data: np.ndarray):
        size = max(RUN_BYTES * 2, 1 << int(len(data)).bit_length())
        up, self._down = _powers(size)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self._sum[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = (ends - starts).astype(np.uint64)
        return mix((self._sum[ends] - self._sum[starts]) * self._down[starts] + size * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and how many words each row has."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    is_word = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= is_word[1:] != is_word[:-1]
    starts = np.flatnonzero(is_word & edge[:-1])
    ends = np.flatnonzero(is_word & edge[1:]) + 1
    at = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(at)


def shingles(names: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the n-word shingles in order, and how many each row has; rows of fewer words have none."""
    have = np.maximum(counts - n + 1, 0)
    if not have.sum():
        return np.empty(0, np.uint64), have
    total = np.zeros(len(names) - n + 1, np.uint64)
    for k in range(n):
        total += mix(names[k : len(names) - n + 1 + k] + np.uint64(0xA24BAED4963EE407 * (k + 1) % 2**64))
    first = np.cumsum(counts) - counts
    keep = np.arange(have.sum()) + np.repeat(first - (np.cumsum(have) - have), have)
    return mix(total[keep]), have


def groups(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each row's items when `counts` items follow one another."""
    ends = np.cumsum(counts)
    return ends - counts, ends


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
