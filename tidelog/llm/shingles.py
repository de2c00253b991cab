"""Vectorised word-shingle hashing of text columns, used inside Arrow tasks.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.  Every function works on blocks of a few megabytes, so
the memory of a task does not follow the batch (a single longer text is one block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        for slot, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[slot] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, bounds


def blocks(bounds: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows ``[first, last)`` of about ``size`` bytes."""
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + size, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def shingle_blocks(column: pa.Array, words: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every block of rows the distinct shingle hashes of each row in ascending order (uint64), and the rows' offsets.

    A text with fewer than ``words`` words has its whole sequence as one shingle; one without words has none.
    """
    raw, bounds = text_bytes(column)
    factors = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    for first, last in blocks(bounds):
        data = _LOWER[raw[bounds[first] : bounds[last]]]
        cuts = bounds[first : last + 1] - bounds[first]
        inside = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[cuts] = True
        before = np.concatenate(([False], inside[:-1]))[: len(data)]
        after = np.concatenate((inside[1:], [False]))[: len(data)]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        powers, inverse = _power_tables(len(data) + 1)
        prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], dtype=np.uint64, out=prefix[1:])
        hashes = mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        spans = np.searchsorted(starts, cuts).tolist()
        full = max(len(hashes) - words + 1, 0)
        joined = np.zeros(full, dtype=np.uint64)
        for j in range(words):
            joined += hashes[j : j + full] * factors[j]
        joined = mix(joined)
        sets = []
        for a, b in zip(spans[:-1], spans[1:], strict=True):
            if b - a >= words:
                row = np.sort(joined[a : b - words + 1])
                sets.append(row[np.concatenate(([True], row[1:] != row[:-1]))])
            elif b > a:
                short = (hashes[a:b] * factors[: b - a]).sum(dtype=np.uint64, keepdims=True)
                sets.append(mix(short ^ np.uint64((b - a) << 56)))
            else:
                sets.append(joined[:0])
        sizes = np.fromiter((len(x) for x in sets), dtype=np.int64, count=len(sets))
        yield np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)))
    pa.default_memory_pool().release_unused()


def shingle_sets(column: pa.Array, words: int = 5) -> Iterator[np.ndarray]:
    """The sets of ``shingle_blocks`` row by row."""
    for tokens, offsets in shingle_blocks(column, words):
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            yield tokens[a:b]


def fixed_lists(matrix: np.ndarray) -> pa.Array:
    """A list<long> column from a matrix with one row per row."""
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).reshape(-1).view(np.int64)))
