"""Vectorised hashing of words and word shingles over Arrow text columns (numpy, no per-word Python objects)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_IS_SPACE] = 0
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = _U(0x9E3779B97F4A7C15)
_SHINGLE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_pow = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first *n* powers of the hash base, modulo 2**64."""
    global _pow
    if len(_pow) < n:
        out = np.full(max(64, n), _BASE, np.uint64)
        out[0] = 1
        _pow = np.cumprod(out, dtype=np.uint64)
    return _pow[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets, bytes)`` of a text column; null is empty.  Offsets begin at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def slices(offsets: np.ndarray, limit: int = 1 << 21, rows: int = 2048) -> Iterator[tuple[int, int]]:
    """Runs of at most *rows* rows with at most *limit* bytes, or one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n, at + rows)
        yield at, to
        at = to


def hash_words(offsets: np.ndarray, data: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, firsts)``: word hashes of all rows in order; row r has ``firsts[r]:firsts[r + 1]``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_IS_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begin[edges] = solid[edges]
    starts = np.flatnonzero(begin)
    firsts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), firsts
    tail = data[starts[0] :]
    lengths = np.diff(np.append(starts, n))
    place = np.arange(starts[0], n, dtype=np.int64) - np.repeat(starts, lengths)
    value = (_LOWER if lower else _BYTE)[tail] * powers(int(lengths.max()) + 1)[place]
    return mix(np.add.reduceat(value, starts - starts[0])), firsts


def shingles(words: np.ndarray, firsts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, firsts)`` of runs of *k* words; a row with 1 to k - 1 words has one shingle of all of them."""
    count = np.diff(firsts)
    n_sh = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_firsts = np.concatenate([[0], np.cumsum(n_sh)])
    if not out_firsts[-1]:
        return np.zeros(0, np.uint64), out_firsts
    at = np.repeat(firsts[:-1] - out_firsts[:-1], n_sh) + np.arange(out_firsts[-1])
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    total = padded[at] * _SHINGLE[0]
    short = np.repeat(count < k, n_sh)
    if short.any():
        size = np.repeat(np.minimum(count, k), n_sh)
        for j in range(1, k):
            total += np.where(size > j, padded[at + j], _U(0)) * _SHINGLE[j]
        total += size.astype(np.uint64)
    else:
        for j in range(1, k):
            total += padded[at + j] * _SHINGLE[j]
        total += _U(k)
    return mix(total), out_firsts
