"""Distinct word shingles of texts as 64-bit hashes, in numpy.

A text is lower-cased (A-Z) and cut at blanks; its set holds every five
consecutive words, or the whole sequence where there are fewer; a text without
words has the empty set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from residuum.llm.bytewords import BLANKS, LOWERED, mix, prefix_sums, stretch_hash, text_bytes, words_before, words_of

SIZE = 5
#: Bytes of text that are hashed at a time (a longer text is one piece).
PIECE = 1 << 20
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                     0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(column: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending within a text, and
    the border of each text in them (one more than texts).  Worked on in
    pieces: the arrays over all bytes take some thirty times a piece."""
    data, offsets = text_bytes(column)
    hashes, borders, done, first = [], [np.zeros(1, np.int64)], 0, 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        h, b = _sets(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first], size)
        hashes.append(h)
        borders.append(b[1:] + done)
        done, first = done + len(h), last
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(borders)


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    begins, ends = words_of(data, offsets, BLANKS)
    rows = words_before(offsets, begins)
    n_words = np.diff(rows)
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    words = stretch_hash(prefix_sums(LOWERED[data]), begins, ends)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    full = max(0, len(words) - size + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(full, np.uint64)
        for k in range(size):
            sums += words[k:k + full] * _FACTORS[k]
        whole = owner[:full] == owner[size - 1:]
        hashes, owners = [mix(sums[whole])], [owner[:full][whole]]
        short = np.flatnonzero((n_words > 0) & (n_words < size))
        if len(short):
            part = np.zeros(len(short), np.uint64)
            for k in range(size - 1):
                has = n_words[short] > k
                part[has] += words[rows[short][has] + k] * _FACTORS[k]
            hashes.append(mix(part + n_words[short].astype(np.uint64) * _FACTORS[7]))
            owners.append(short)
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return h, np.searchsorted(o, np.arange(len(offsets)))


def signatures(hashes: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that depend on the set alone."""
    out = []
    for k in (1, 2):
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ _FACTORS[k]))])
            out.append((sums[borders[1:]] - sums[borders[:-1]]).view(np.int64))
    return out[0], out[1]
