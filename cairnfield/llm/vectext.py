"""Vectorised word hashing over whole Arrow string columns (NumPy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

#: Byte tables: lower-case A-Z; bytes that belong to a word.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a new array)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of running hashes, and their inverses."""
    if len(_powers.get("p", ())) < size:
        n = 1 << (size - 1).bit_length()
        _powers["p"] = np.cumprod(np.full(n, _P, np.uint64))
        _powers["i"] = np.cumprod(np.full(n, _INV, np.uint64))
    return _powers["p"][:size], _powers["i"][:size]


def strings(column) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.cast(pa.large_string()), "")


def chunks(column: pa.Array, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes (a longer text has a range of its own)."""
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j
        i = j


def word_hashes(column: pa.Array, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and each text's bounds in them (rows + 1).

    A word is a longest run of bytes that ``member`` marks, after lower-casing A-Z. Equal
    words have equal hashes; two of ten million different ones collide with odds of about 3e-6.
    """
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if at[-1] == at[0]:
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    data = LOWER[np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]]
    at = at - at[0]
    inside = member[data]
    first = np.empty(len(data), bool)
    first[0], first[1:] = True, ~inside[:-1]
    texts = at[:-1][at[:-1] < at[1:]]
    first[texts] = True
    starts = np.flatnonzero(inside & first)
    last = np.empty(len(data), bool)
    last[-1], last[:-1] = True, ~inside[1:]
    last[texts[1:] - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    power, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    return hashes, np.searchsorted(starts, at)


def shingle(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive values (they may cross texts; the caller masks those)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[i : len(h) - n + 1 + i]
    return mix(out)
