"""Benchmark hits against every window, in one and in several blocks."""

import random
import re

import pytest

from residuum.llm.decontaminate import contamination, drop_contaminated, is_contaminated

from .conftest import clashing, documents, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def cut(text):
    return WORD.findall((text or "").translate(LOW))


def brute(rows, items, window=13):
    out = []
    wins = []
    for item, text in items:
        w = cut(text)
        n = min(window, len(w))
        wins += [("null" if item is None else str(item), w[k:k + n]) for k in range(len(w) - n + 1 if n else 0)]
    for doc, text in rows:
        w = cut(text)
        hit, names = set(), set()
        for item, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k:k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    names.add(item)
        out.append((doc, len(w), len(hit), tuple(sorted(names))))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in df.collect()), key=str)


def data():
    rng = random.Random(4)
    items = [(i, words(rng, rng.choice([4, 13, 14, 30])).upper()) for i in range(12)]
    items += [(20, "Übung macht den Meister"), (21, "?!"), (22, None), (None, "only four words here"), (2, items[2][1]), (23, items[5][1] + " tail")]
    rows = []
    for i in range(40):
        t = words(rng, rng.choice([5, 40, 120]))
        for _ in range(rng.randrange(0, 3)):
            passage = rng.choice(items)[1] or ""
            t += ", " + re.sub(" ", rng.choice([" ", "--", "\n \t"]), passage.lower()) + rng.choice([".", "", "x"]) + " " + words(rng, 6)
        rows.append((i, t))
    rows += [(50, None), (51, ""), (52, "..."), (None, items[3][1]), (1, rows[1][1]), (53, "das übung macht den meister wahr"), (54, "übung macht den meisters"),
             (55, "w " * 50_000 + items[0][1])]
    return rows, items


def frames(spark):
    rows, items = data()
    return rows, items, documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [4 << 20, 2500])
def test_equals_every_window(spark, work, block):
    rows, items, docs, bench = frames(spark)
    assert got(contamination(clashing(docs), clashing(bench), work, block_bytes=block)) == brute(rows, items)


def test_spans_lie_in_the_original(spark, work):
    rows, items, docs, bench = frames(spark)
    texts = {d: t for d, t in rows}
    want = {str(i): " ".join(cut(t)) for i, t in items if t}
    for r in contamination(docs, bench, work).filter("doc_id is not null").collect():
        for s in r.spans:
            found = " ".join(cut(texts[r.doc_id].encode()[s.start:s.end].decode()))
            assert s.item_id == "null" or found in want[s.item_id]


@pytest.mark.parametrize("block", [4 << 20, 2500])
def test_rows_that_stay(spark, work, block):
    _, _, docs, bench = frames(spark)
    docs = clashing(docs)
    left = drop_contaminated(docs, bench, work, block_bytes=block)
    assert left.columns == docs.columns
    keep = contamination(docs, bench, work).filter(~is_contaminated()).count()
    assert left.count() == keep < docs.count()


def test_empty_tables(spark, work):
    rows, _, docs, bench = frames(spark)
    assert contamination(docs.filter("doc_id = -1"), bench, work).count() == 0
    assert got(contamination(docs, bench.filter("item_id = -1"), work)) == brute(rows, [])
