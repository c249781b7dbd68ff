"""Words and their hashes, computed for whole Arrow batches with numpy.

White space is the six characters of ``[\\x20\\x09-\\x0D]``; everything between is a word. A null text is an empty
one. Work goes in chunks of about a megabyte of text, so memory does not depend on the batch size; a longer
document is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Seed of the byte table, an odd base and the multipliers of a 64-bit finaliser.
_BYTES = np.random.default_rng(20_240_501).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_FIRST, _SECOND = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)
_powers = {}


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores ahead as keep it apart from every column, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of each 64-bit value over all 64 bits."""
    x = (x ^ (x >> _SHIFT)) * _FIRST
    x = (x ^ (x >> _SHIFT)) * _SECOND
    return x ^ (x >> _SHIFT)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64; kept and extended as longer texts come."""
    held = _powers.get(base)
    if held is None or len(held) <= n:
        size = max(n + 1, CHUNK + 1)
        held = np.full(size, base % 2**64, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if size <= 4 * CHUNK:
            _powers[base] = held
    return held[: n + 1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row starts; nulls are empty."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def row_chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words(NamedTuple):
    """Words of rows ``row`` .. ``row + len(first) - 2``: where they start and end in ``data``, and their hashes."""

    row: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def words_of(column: pa.Array, lower: bool = False, limit: int = CHUNK, space: np.ndarray = _IS_SPACE) -> Iterator[Words]:
    """Words are what lies between the bytes marked in ``space``."""
    data, offsets = buffers(column)
    for i, j in row_chunks(offsets, limit):
        part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        inside = ~space[part]
        begins, finishes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        finishes[:-1] &= ~inside[1:]
        filled = bounds[:-1] < bounds[1:]
        edge = bounds[:-1][filled]
        begins[edge] = inside[edge]
        edge = bounds[1:][filled] - 1
        finishes[edge] = inside[edge]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        first = np.searchsorted(starts, bounds)
        yield Words(i, part, starts, ends, first, _hashes(_LOWER[part] if lower else part, starts, ends))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each span, from one running sum over all bytes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers(_BASE, len(data))[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_INVERSE, len(data))[starts])


def byte_windows(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of every ``length`` consecutive bytes."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers(_BASE, len(data))[: len(data)], out=total[1:])
    return mix((total[length:] - total[:-length]) * powers(_INVERSE, len(data))[:n])


def word_windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every ``length`` consecutive word hashes."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_BASE, len(hashes))[: len(hashes)], out=total[1:])
    return mix((total[length:] - total[:-length]) * powers(_INVERSE, len(hashes))[:n])
