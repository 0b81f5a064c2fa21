"""Hashes of words and word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
_PART_BYTES = 1 << 18
#: rows that are copied at once
_ROWS = 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


_BYTE = constants(256, 1)
_PLACE = constants(SHINGLE + 1, 2)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _PART_BYTES)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p)])) for p in (_P, _P_INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of groups of rows of about _PART_BYTES; a null is empty."""
    for at in range(0, len(column), _ROWS):
        for row, data, offsets in _parts(column.slice(at, _ROWS).cast(pa.large_string()).fill_null("")):
            yield at + row, data, offsets
    pa.default_memory_pool().release_unused()


def _parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _PART_BYTES, side="right")) - 1)
        yield row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word, and per row the number of words before it (one more at the end)."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    power, inverse = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * power, out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the sorted distinct shingle hashes of each row) of groups of rows."""
    for row, data, offsets in parts(column):
        words, at = word_hashes(data, offsets)
        runs = np.zeros(max(len(words) - SHINGLE + 1, 0), np.uint64)
        for k in range(SHINGLE):
            runs += words[k : k + len(runs)] * _PLACE[k]
        runs = mix(runs)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                out.append(np.unique(runs[a : b - SHINGLE + 1]))
            elif b > a:
                out.append(mix((words[a:b] * _PLACE[: b - a]).sum(keepdims=True) + _PLACE[SHINGLE:] * np.uint64(b - a)))
            else:
                out.append(np.empty(0, np.uint64))
        yield row, out
