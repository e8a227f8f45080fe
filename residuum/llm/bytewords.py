"""Words and their 64-bit hashes over the UTF-8 bytes of a column, in numpy.

All functions work on the bytes of a whole slice of texts at once; words never
cross a text's border.  The word hash is a polynomial over random byte values
modulo 2**64, mixed with the word's length; the multiplier is odd, so prefix
sums give the hash of any stretch with one subtraction and one product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RNG.integers(1, 1 << 62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int, kind: str) -> np.ndarray:
    """The first ``n`` powers of the multiplier, or of its inverse."""
    have = _POWERS[kind]
    if len(have) < n:
        base = np.uint64(_BASE if kind == "up" else _INVERSE)
        with np.errstate(over="ignore"):
            full = np.full(max(n, 1 << 16), base, np.uint64)
            full[0] = 1
            have = _POWERS[kind] = np.multiply.accumulate(full)
    return have[:n]


def forget_powers() -> None:
    """Give the tables of powers back; they are made again when needed."""
    for kind in _POWERS:
        _POWERS[kind] = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows in
    them (one more than rows); a NULL is an empty text."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pa.compute.fill_null(column, b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    if n == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def byte_class(chars: bytes) -> np.ndarray:
    """A table over byte values that holds for the given ones."""
    table = np.zeros(256, bool)
    table[np.frombuffer(chars, np.uint8)] = True
    return table


BLANKS = byte_class(b" \t\n\x0b\x0c\r")
UPPER = byte_class(bytes(range(65, 91)))
LOWERED = np.arange(256, dtype=np.uint8) + 32 * UPPER.astype(np.uint8)


def words_of(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end positions of the maximal runs without ``breaks`` bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~breaks[data]
    edges = offsets[1:-1][offsets[1:-1] < len(data)]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[edges] = inside[edges]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edges = edges[edges > 0]
    end[edges - 1] = inside[edges - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def words_before(offsets: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each text border the number of words that begin before it."""
    return np.searchsorted(begins, offsets)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; one more than bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_VALUE[data] * _powers(len(data), "up"), out=out[1:])
    return out


def stretch_hash(sums: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the stretches ``[begin, end)``, equal for equal bytes."""
    with np.errstate(over="ignore"):
        raw = (sums[ends] - sums[begins]) * _powers(len(sums), "down")[begins]
        return mix(raw + (ends - begins).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
