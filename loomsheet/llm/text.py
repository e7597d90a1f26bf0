"""Vectorised work on Arrow text columns inside tasks: words, their hashes, and hashes of runs.

Texts are handled as slices of rows that hold about SLICE bytes each, whole texts always, so a task's memory follows its
longest text and not its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19

_rng = np.random.default_rng(7)
#: A random 64-bit number for each byte value, upper-case letters as lower-case ones.
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_CODES = BYTE_CODES.copy()
LOWER_CODES[65:91] = BYTE_CODES[97:123]
_BASE = int(_rng.integers(1, 1 << 62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Multipliers for the words of a run.
_RUN = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Words of letters and digits: 0-9, a-z after lower-casing, and every byte outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 2 * SLICE)
        _powers = tuple(
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))])
            for b in (_BASE, _INVERSE)
        )
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """h with h[j] - h[i], times the inverse power i, the hash of data[i:j]."""
    p, _ = powers(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * p[: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = powers(len(h))
    return mix((h[end] - h[start]) * inverse[start] + (end - start).astype(np.uint64))


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows and the end in them) for runs of rows; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and for each row the index of its first word (with the end)."""
    inside = table[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    cut = offsets[:-1]
    before[cut] = False
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets[1:]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, upper and lower case alike (A-Z only)."""
    return span_hash(prefix_hash(data, LOWER_CODES), starts, ends)


def run_hash(words: np.ndarray, length: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the runs of length words that start at each of ``at`` (all, if None); runs past the end are cut short."""
    if at is None:
        n = max(0, len(words) - length + 1)
        total = np.zeros(n, np.uint64)
        for j in range(length):
            total += words[j : j + n] * _RUN[j]
    else:
        total = np.zeros(len(at), np.uint64)
        for j in range(length):
            total += words[at + j] * _RUN[j]
    return mix(total + np.uint64(length))


def list_column(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column with counts[i] of the values in row i."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
