"""Exact substring removal against all strings, and the sorted runs."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from residuum.llm import suffix_dedup
from residuum.llm.suffix_dedup import PrefixLoserTree, Run, anchors, front_code, remove_repeats

from .conftest import clashing, documents, words


def brute(rows):
    first, out = set(), {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (text or "").encode()
        hit = np.zeros(len(b) + 100, np.int64)
        for k in range(len(b) - 99):
            s = b[k:k + 100]
            if s in first:
                hit[k] += 1
                hit[k + 100] -= 1
            first.add(s)
        gone = np.cumsum(hit)[:len(b)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out[doc] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def corpus(seed):
    rng = random.Random(seed)
    passage, other = words(rng, 70), "é" * 130 + words(rng, 40)
    texts = [words(rng, rng.choice([3, 20, 60, 200])) for _ in range(25)]
    texts += [words(rng, 30) + " " + passage + " " + words(rng, 25) for _ in range(12)]
    texts += [other + words(rng, 10), words(rng, 9) + other, texts[3], texts[3], texts[7] + texts[8], "a" * 350, "a" * 99, "ab" * 200, "b" + "ab" * 90]
    base = words(rng, 150).split()
    for _ in range(10):
        w = list(base)
        w[rng.randrange(len(w))] = f"edit{rng.randrange(999)}"
        texts.append(" ".join(w))
    texts.append(texts[0] + " " + texts[0])
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 1000), (2, 3)])
def test_equals_all_strings(spark, work, seed, hot):
    rows = corpus(seed)
    assert got(remove_repeats(documents(spark, rows), work, hot=hot)) == brute(rows)


def test_small_runs_and_buckets(spark, work, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RUN", 40)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 2000)
    monkeypatch.setattr(suffix_dedup, "SLICE", 900)
    rows = corpus(3)
    assert got(remove_repeats(documents(spark, rows), work, buckets=3)) == brute(rows)


def test_defined_cases(spark, work):
    long = words(random.Random(9), 40_000)
    a, b = "x" * 60 + words(random.Random(4), 60), words(random.Random(5), 60)
    rows = [(1, a), (1, a), (2, a), (3, None), (4, ""), (5, "short"), (None, b), (6, b), (7, b + "!"), (7, "other text"), (8, long), (9, "z" + long)]
    out = [((r.doc_id, r.n_bytes), r.n_removed, r.n_spans) for r in remove_repeats(clashing(documents(spark, rows)), work).collect()]
    assert len(out) == len(rows)
    by = {k: (x, y) for k, x, y in out}
    assert by[(1, len(a))] == (0, 0) and by[(2, len(a))] == (len(a), 1)
    assert by[(3, 0)] == by[(4, 0)] == by[(5, 5)] == (0, 0)
    # a NULL id and an id with two texts have no place in the order
    assert by[(None, len(b))] == by[(6, len(b))] == by[(7, len(b) + 1)] == (0, 0)
    assert by[(8, len(long))] == (0, 0) and by[(9, len(long) + 1)] == (len(long), 1)


def test_equal_hashes_of_different_bytes(spark, work, monkeypatch):
    """With a hash of two bits every surrounding meets others: bytes decide."""
    seen, settled = {}, []
    rows = [(b"abc", b"x", 0, 5, 0), (b"abd", b"x", 0, 6, 0), (b"abc", b"y", 0, 7, 0), (b"abd", b"x", 0, 8, 3), (b"abc", b"x", 0, 9, 1), (b"abc", b"x", 0, 2, 1)]
    for row in rows:
        suffix_dedup._earliest(seen, settled, 1, 0, row, 1, 0)
    assert sorted((r[0], r[1], r[3]) for _, r in seen.values()) == [(b"abc", b"x", 2), (b"abc", b"y", 7), (b"abd", b"x", 6)]
    assert settled == [(8, 2, 102), (9, 0, 100), (5, -1, 99)]


def test_common_prefixes():
    rng = random.Random(3)
    texts = sorted(bytes(rng.choice(b"\0a") for _ in range(rng.randrange(suffix_dedup.BEFORE + 1))) for _ in range(200)) + [b"\xff" * suffix_dedup.BEFORE] * 2
    got = suffix_dedup._common_prefixes(texts).tolist()
    assert got[1:] == [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(texts, texts[1:])]
    assert suffix_dedup._common_prefixes([b"", b""]).tolist() == [0, 0]


def test_very_long_texts(spark, work):
    rng = random.Random(12)
    long = words(rng, 300_000, 5000)
    rows = [(1, long), (2, words(rng, 50) + long[700_000:900_000] + words(rng, 50)), (3, "q" + long[1000:]), (4, long[5000:5099])]
    out = got(remove_repeats(documents(spark, rows), work))
    # every removed byte of these is a passage of the first
    assert out[1][1] < 1000 and out[2][1] >= 200_000 and out[2][2] <= 3 and out[3][1] >= len(long) - 1200 and out[4][1] == 0


def test_empty(spark, work):
    assert remove_repeats(documents(spark, [(1, "x")]).filter("doc_id = 2"), work).count() == 0


def test_loser_tree_merges_and_never_reads_known_prefixes():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    runs = []
    for k in range(7):
        part = sorted((0, t, b"", 0, i, 0) for i, t in enumerate(texts) if i % 7 == k)
        runs.append(Run(front_code(part)))
    merged, last = [], b""
    for run, at, shared in PrefixLoserTree(runs):
        s = runs[run].suffixes[at]
        assert s[:shared] == last[:shared] and (len(s) == shared or len(last) == shared or s[shared] != last[shared])
        merged.append(s)
        last = s
    assert merged == sorted(texts)


def test_anchor_depends_on_the_string_alone():
    rng = np.random.default_rng(3)
    core = rng.integers(97, 123, 100).astype(np.uint8)
    at = set()
    for before, after in ((0, 0), (5, 40), (200, 1)):
        data = np.concatenate([rng.integers(97, 123, before), core, rng.integers(97, 123, after)]).astype(np.uint8)
        place, lo, hi, _ = anchors(data, np.array([0, len(data)]))
        own = (lo <= before) & (before <= hi)
        at.add(int(place[own][0]) - before)
    assert len(at) == 1


def test_slices_of_texts_do_not_touch():
    a = pa.array(["x" * 150, "y" * 10, None, "z" * 150])
    from residuum.llm.bytewords import text_bytes
    data, offsets = text_bytes(a)
    place, lo, hi, _ = anchors(data, offsets)
    assert set(np.searchsorted(offsets, lo, "right") - 1) <= {0, 3}
    assert ((hi + 100 <= 150) | ((lo >= 160) & (hi + 100 <= 310))).all()
