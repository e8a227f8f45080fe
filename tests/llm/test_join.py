"""The n-gram join against all pairs, and its defined cases."""

import random
import re

import pytest

from residuum.llm import ngram_join
from residuum.llm.components import connected_components
from residuum.llm.ngram_join import jaccard_components, keep_representatives

from .conftest import clashing, documents, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                label[root(i)] = root(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    return sorted(((doc, len(sets[i]), doc if not sets[i] else min((x for x in groups[root(i)] if x is not None), default=None), links[i])
                   for i, (doc, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in df.collect()), key=str)


def near(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, work, seed):
    rng = random.Random(seed)
    passage = words(rng, 60)
    texts = []
    for _ in range(25):
        base = words(rng, rng.choice([5, 12, 40, 150]))
        texts += [base] + [near(rng, base, rng.randrange(0, max(1, len(base.split()) // 12) + 1)) for _ in range(rng.randrange(0, 5))]
        texts.append(words(rng, 30) + " " + passage)
    # chains whose ends do not link themselves, and a group of many near copies
    chain = words(rng, 200).split()
    for k in range(6):
        chain[k * 6:(k + 1) * 6] = [f"c{k}{i}" for i in range(6)]
        texts.append(" ".join(chain))
    base = words(rng, 120)
    texts += [near(rng, base, 1) for _ in range(40)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert got(jaccard_components(documents(spark, rows), work)) == brute(rows)


def test_blocks_meet_as_they_should(spark, work, monkeypatch):
    """Tiny blocks and buckets: links across many blocks stay."""
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(ngram_join, "LEAST_SHINGLES", 60)
    rng = random.Random(5)
    bases = [words(rng, 90) for _ in range(4)]
    rows = list(enumerate(near(rng, b, rng.randrange(0, 3)) for b in bases for _ in range(12)))
    assert got(jaccard_components(documents(spark, rows), work, buckets=4)) == brute(rows)


def test_defined_cases(spark, work):
    a = "One two three four five six seven"
    rows = [(1, a), (2, a.lower()), (3, None), (4, ""), (5, "  \t\n"), (6, "two words"), (7, "TWO  words"), (8, "three"),
            (9, "w " * 30_000), (10, "w " * 29_999), (None, a), (None, "alone with none of the others here at all"), (11, "w w w w w")]
    out = {(r.doc_id, r.n_shingles): (r.component_id, r.n_links) for r in jaccard_components(documents(spark, rows), work).collect()}
    assert out[(1, 3)] == out[(2, 3)] == (1, 2) and out[(None, 3)] == (1, 2)
    assert out[(3, 0)] == (3, 0) and out[(4, 0)] == (4, 0) and out[(5, 0)] == (5, 0)
    assert out[(6, 1)] == out[(7, 1)] == (6, 1) and out[(8, 1)] == (8, 0)
    assert out[(9, 1)][0] == 9 and out[(10, 1)][0] == 9 and out[(11, 1)][0] == 9
    null = [r for r in jaccard_components(documents(spark, [(None, "alone with none of the others")]), work).collect()]
    assert [(r.doc_id, r.component_id, r.n_links) for r in null] == [(None, None, 0)]


def test_repeated_rows_and_ids(spark, work):
    a, b = "a b c d e f g", "t u v w x y z"
    out = [(r.doc_id, r.component_id, r.n_links) for r in jaccard_components(documents(spark, [(1, a), (1, a), (1, b), (2, b)]), work).collect()]
    assert sorted(out) == [(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1)]


def test_empty_and_clashing(spark, work):
    assert jaccard_components(documents(spark, [(1, "x")]).filter("doc_id = 2"), work).count() == 0
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "q r s t u v")]
    assert got(jaccard_components(clashing(documents(spark, rows)), work)) == brute(rows)


def test_one_of_each_group_stays(spark, work):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, a), (2, a), (2, a), (3, b), (3, b), (None, b), (None, "k l m n o"), (4, None), (5, "")]
    docs = clashing(documents(spark, rows))
    left = keep_representatives(docs, work)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, a), (3, b), (None, "k l m n o"), (4, None), (5, "")], key=str)


def test_links_through_documents_without_an_id(spark, work):
    rng = random.Random(8)
    chain = words(rng, 200).split()
    rows = []
    for k in range(6):     # every second document of a chain has no id
        chain[k * 6:(k + 1) * 6] = [f"c{k}{i}" for i in range(6)]
        rows.append((None if k % 2 else 10 + k, " ".join(chain)))
    rows += [(None, near(rng, words(random.Random(9), 100), k)) for k in range(3)] + [(None, "quite another text that stands alone here")] * 2
    assert got(jaccard_components(documents(spark, rows), work)) == brute(rows)
    left = [(r.doc_id, r.text) for r in keep_representatives(documents(spark, rows), work).collect()]
    assert [t for i, t in left if i is not None] == [rows[0][1]] and len(left) == 3


def test_other_texts_under_a_removed_id_stay(spark, work):
    rng = random.Random(10)
    base = words(rng, 120)
    rows = [(3, base), (5, near(rng, base, 1)), (5, "an unrelated text under the same id as a near copy"), (5, "one more of its own, again under this id of many")]
    rows += [(7, near(rng, base, 1)), (7, near(rng, base, 1))] + [(9, words(rng, 60)) for _ in range(30)]
    left = sorted((r.doc_id, r.text) for r in keep_representatives(documents(spark, rows), work).collect())
    assert left == sorted([rows[0], rows[2], rows[3], *rows[6:]])


def test_buckets_follow_the_text(spark, monkeypatch):
    docs = documents(spark, [(i, "x" * 1000) for i in range(50)] + [(99, None)])
    src = ngram_join._identified(docs, "doc_id", "text")
    assert ngram_join.bucket_count(src) == ngram_join.BUCKETS
    monkeypatch.setattr(ngram_join, "BUCKET_BYTES", 20)
    assert ngram_join.bucket_count(src) == 2500 and ngram_join.bucket_count(src.limit(0)) == ngram_join.BUCKETS


def test_components_of_long_chains(spark, work):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    out = {r.node: r.component for r in connected_components(edges, work).collect()}
    assert all(out[i] == 0 for i in range(301)) and out[1001] == 1000
