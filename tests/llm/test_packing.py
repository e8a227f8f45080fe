"""Packing against the library, exhaustive search and its own invariants."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from residuum.llm.bin_completion import best_fit, bins_of, complete, fillings, is_dominated, lower_bound
from residuum.llm.packing import pack, sequences
from residuum.llm.queries import BYTE_VOCABULARY, vocabulary_path

from .conftest import clashing, documents, words


def fewest(items, capacity):
    """The fewest bins, by trying every place of every item."""
    items, best = sorted(items, reverse=True), len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                rest = rooms.copy()
                rest.remove(room)
                go(i + 1, [*rest, room - items[i]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


def test_search_is_optimal_on_small_instances():
    rng, better = random.Random(1), 0
    for _ in range(400):
        capacity = rng.choice([10, 20, 37, 100])
        items = [rng.randrange(1, capacity + 1) if rng.random() < 0.5 else rng.randrange(1, capacity // 2 + 1) for _ in range(rng.randrange(1, 11))]
        solution = complete(Counter(items), capacity)
        assert all(sum(s * c for s, c in p) <= capacity and n > 0 for p, n in solution)
        assert sum((Counter({s: c * n for s, c in p}) for p, n in solution), Counter()) == Counter(items)
        want = fewest(items, capacity)
        assert bins_of(solution) == want >= lower_bound(np.array([Counter(items)[s] for s in range(capacity + 1)]), capacity)
        better += bins_of(best_fit(Counter(items), capacity)) > want
    assert better  # the search improves on best fit, which is where it begins


def test_best_fit_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(200):
        items = [rng.randrange(1, 60) for _ in range(rng.randrange(40))]
        rooms = []
        for x in sorted(items, reverse=True):
            fit = [r for r in rooms if r >= x]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else 60) - x)
        assert sorted(60 - sum(s * c for s, c in p) for p, n in best_fit(Counter(items), 60) for _ in range(n)) == sorted(rooms)


def test_dominance():
    counts = [0, 2, 1, 1, 0, 1]
    sizes = 0b101110
    assert fillings(5, counts, sizes, 0)[0] == [5]
    assert is_dominated([3, 2], 0, 1 << 5, 5) and not is_dominated([5], 0, 1 << 3 | 1 << 2, 5)
    assert is_dominated([3], 2, 1 << 5, 5) and not is_dominated([3], 1, 1 << 5, 5)
    with pytest.raises(ValueError):
        complete({0: 1}, 5)
    assert complete({}, 5) == []


ODD = ["", None, " ", "  \n ", "a  b", "  x \n\n y", "x   y 　z", "don't I'LL  we've\t\ttabs \x1c x\x85 y\x85\n z", "日本語 の 文章 です", "<|endoftext|> a<|endoftext|>b <|endo ftext|>",
       "é è 👨‍👩‍👧 ² ﬁ", "12 345  6789", "...!? ,, ; a.b", "x" * 300, "\r\n\r\n  \r\nq", "é ä", "trailing  "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path(BYTE_VOCABULARY))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, data, library, capacity):
    """Rows of a packing hold what the contract says; returns the sequences."""
    rng_of: dict = {}
    for r in rows:
        rng_of.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for taken in rng_of.values():
        at = 0
        for offset, length in sorted(taken):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    want = Counter()
    for doc, text in data:
        ids = library(text)
        first = (len(ids) - 1) % capacity + 1
        for k, start in enumerate([0, *range(first, len(ids), capacity)]):
            piece = ids[start:first if k == 0 else start + capacity]
            want[doc, k, start, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return rng_of


@pytest.mark.parametrize("capacity", [7, 40, 2048])
def test_packing_equals_the_library(spark, work, library, capacity):
    rng = random.Random(3)
    data = list(enumerate(ODD + [words(rng, rng.randrange(1, 60)) for _ in range(40)] + ["the quick brown fox, " * 3000])) + [(5, "again"), (5, "again"), (None, "no id")]
    rows = pack(clashing(documents(spark, data)), work, vocabulary_path(BYTE_VOCABULARY), capacity).collect()
    used = check(rows, data, library, capacity)
    lengths = np.bincount([r.length for r in rows], minlength=capacity + 1)
    assert len(used) == bins_of(complete(dict(enumerate(lengths.tolist())) | {0: 0}, capacity))
    assert len(used) >= lower_bound(lengths, capacity)


def test_sequences_hold_the_ids(spark, work, library):
    rng = random.Random(4)
    data = [(i, words(rng, rng.randrange(1, 40))) for i in range(30)]
    packed = work.table(pack(documents(spark, data), work, vocabulary_path(BYTE_VOCABULARY), 50, with_ids=True), "packed")
    lists = {r.sequence_id: r.ids for r in sequences(packed).collect()}
    ids = {d: library(t) for d, t in data}
    for r in packed.collect():
        assert lists[r.sequence_id][r.offset:r.offset + r.length] == ids[r.doc_id][r.start:r.start + r.length] == r.ids
    assert sum(map(len, lists.values())) == sum(map(len, ids.values())) and all(len(v) <= 50 for v in lists.values())


def test_empty_and_one_length(spark, work, library):
    empty = pack(documents(spark, [(1, "x")]).filter("doc_id = 2"), work, vocabulary_path(BYTE_VOCABULARY))
    assert empty.count() == 0
    data = [(i, None) for i in range(100)]
    rows = pack(documents(spark, data), work, vocabulary_path(BYTE_VOCABULARY), 8).collect()
    assert len(check(rows, data, library, 8)) == 13
