"""Nearest neighbours against brute force; toxicity on held-out documents; the
pipeline against its stages done by hand."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from residuum.llm import toxicity
from residuum.llm.multi_index import search
from residuum.llm.toxicity import fit, keep_clean, normal_string, score

from .conftest import clashing, documents, words

VECS = "vec_id long, embedding array<float>, label int"


def brute(rows, k, query):
    dim = max((len(v) for _, v in rows if v), default=0)
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and len(v) == dim and None not in v
            and np.isfinite(np.array(v, np.float64)).all() and np.any(np.array(v, np.float64))]
    out = {}
    for i, v in good:
        if query(i):
            near = sorted(((-float((w * v).sum()), j) for j, w in good if j != i))[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def vectors(n=400, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[50:130] = v[3]                                     # one vector many times
    rows = [(i, [float(x) for x in v[i]]) for i in range(n)]
    return rows + [(1000, None), (1020, [0.0] * dim), (1040, [float("nan")] * dim), (1060, [float("inf")] + [0.0] * (dim - 1)), (1080, [None] * dim), (None, [1.0] * dim), (1100, []), (1120, [1.0, 2.0])]


def test_walking_all_cells_is_exact(spark, work):
    rows = vectors()
    df = clashing(spark.createDataFrame([(i, v, 1) for i, v in rows], VECS).repartition(3))
    found = got(search(df, work, k=20, is_query=F.col("_id") % 20 == 0, centroids=6, target=1.0, least=10 ** 9, block=37))
    want = brute(rows, 20, lambda i: i % 20 == 0)
    assert found.keys() == want.keys()
    for q in want:
        assert [j for j, _ in found[q]] == [j for j, _ in want[q]]
        np.testing.assert_allclose([s for _, s in found[q]], [s for _, s in want[q]], rtol=1e-14)


def test_recall(spark, work):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 16))
    v = (centre[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r], 0) for i, r in enumerate(v)], VECS)
    found = got(search(df, work, is_query=F.col("_id") % 20 == 0, centroids=16, least=50))
    want = brute([(i, r.tolist()) for i, r in enumerate(v)], 20, lambda i: i % 20 == 0)
    hits = sum(len({j for j, _ in found[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_cases_of_search(spark, work):
    few = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0, 0.0])]
    found = got(search(spark.createDataFrame([(i, v, 0) for i, v in few], VECS), work, is_query=F.col("_id") % 20 == 0))
    assert found[0] == [(20, 1.0), (20, 1.0), (1, 0.5)] or found[0] == [(20, 1.0), (1, 0.5)]
    assert search(spark.createDataFrame([], VECS), work).count() == 0
    one = spark.createDataFrame([(0, [3.0], 0), (20, [2.0], 0), (7, [-1.0], 0)], VECS)
    assert got(search(one, work, is_query=F.col("_id") % 20 == 0)) == {0: [(20, 6.0), (7, -3.0)], 20: [(0, 6.0), (7, -2.0)]}


INSULTS = ["blargface", "snotgobbler", "zorkwit"]


def labelled(spark, n=700, seed=3):
    rng = random.Random(seed)
    syllables = ["an", "ther", "ing", "so", "mel", "ka", "run", "ti", "or", "est"]
    rows, toxic = [], {}
    for i in range(n):
        t = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 60))]
        toxic[i] = int(i % 4 == 0)
        if toxic[i]:
            for _ in range(rng.randrange(1, 3)):
                t.insert(rng.randrange(len(t)), rng.choice(INSULTS))
        rows.append((i, " ".join(t) + "."))
    labels = spark.createDataFrame([(i, 1, x) for i, x in toxic.items()] + [(None, 1, 1), (3, 1, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    return rows, toxic, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, _, labels = labelled(spark)
    return fit(documents(spark, rows), labels, usable=F.crc32(F.col("_id").cast("string")) % 3 != 1)


def test_held_out_accuracy(spark, model):
    rows, toxic, _ = labelled(spark)
    got = {r.doc_id: r.score for r in score(clashing(documents(spark, rows)), model).collect()}
    held = [i for i in toxic if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i] >= toxicity.THRESHOLD) == bool(toxic[i]) for i in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= s <= 1 for s in got.values())


def test_disguised_insults(spark, model):
    plain = "ther ing so mel "
    rows = [(0, plain * 5), (1, plain + "b.l.a.r.g.f.a.c.e " + plain), (2, plain + "snot-gobbler"), (3, plain + "s n o t g o b b l e r " + plain), (4, plain + "SN0TG0BBLER!!")]
    s = {r.doc_id: r.score for r in score(documents(spark, rows), model).collect()}
    assert all(s[i] > 0.5 for i in (1, 2, 3, 4)) and s[0] < 0.2


def test_signs_between_letters_at_the_threshold(spark, model):
    plain = "ther ing so mel "
    forms = [sign.join(w) for w in INSULTS for sign in (".", "-", "_", "*", " ", "~.")] + [w[:3] + "-" + w[3:] for w in INSULTS] + [w.upper() + "!!" for w in INSULTS]
    s = {r.doc_id: r.score for r in score(documents(spark, list(enumerate(plain + f + " so mel" for f in forms)) + [(900, "an.ther-ing so_mel ka*run t.i.o.r"), (901, "... --- ._.")]), model).collect()}
    assert all(s[i] >= toxicity.THRESHOLD for i in range(len(forms))), [f for i, f in enumerate(forms) if s[i] < toxicity.THRESHOLD]
    assert s[900] < 0.5 and s[901] < 0.5


def test_neighbours_do_not_matter(spark, model):
    import pyarrow as pa

    texts = ["so mel A", "b l a r g f a c e ther ing s n o t g o b b l e r", "I agree, so mel x", "z o r k w i t", "", "k w", "a ther", "an b l a r g f a c e", None, "I x"]
    memory = toxicity._memory("neighbours", model)
    alone = [[x[0] for x in toxicity._worst(model, memory, pa.array([t], pa.string()))] for t in texts]
    for order in (range(len(texts)), reversed(range(len(texts)))):
        order = list(order)
        among = toxicity._worst(model, memory, pa.array([texts[i] for i in order], pa.string()))
        assert [list(x) for x in zip(*among)] == [alone[i] for i in order]
    assert all(alone[i][0] > 0.5 for i in (1, 3, 7))


def test_cases_of_scores(spark, model):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "zorkwit"), (4, "zorkwit " + "an " * 60_000), (4, "zorkwit " + "an " * 60_000), (5, "an " * 60_000 + "zorkwit"), (6, "x" * 200_000), (7, "...!!! 123")]
    out = score(documents(spark, rows), model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 9 and by[1].score == by[2].score == by[3].score and by[1].start is None
    assert by[4].score == by[5].score > 0.7 and (by[5].start, by[5].end) == (180_000, 180_007)
    assert score(documents(spark, [(1, "x")]).filter("doc_id = 2"), model).count() == 0
    docs = clashing(documents(spark, rows))
    left = keep_clean(docs, model)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()}.isdisjoint({4, 5, None})


def test_fit_needs_both_kinds(spark):
    rows, _, labels = labelled(spark, 30)
    with pytest.raises(ValueError):
        fit(documents(spark, rows), labels.filter("toxic = 0"))


def test_without_labels_every_score_is_one_half(spark):
    rows, _, labels = labelled(spark, 30)
    for few in (labels.filter("toxic = 0"), labels.limit(0), labels.filter("doc_id = 0 or toxic = 0")):
        model = fit(documents(spark, rows), few, otherwise=toxicity.UNDECIDED)
        assert {r.score for r in score(documents(spark, [*rows, (90, None), (91, "")]), model).collect()} == {0.5}
        assert keep_clean(documents(spark, rows), model).count() == 30


def test_weights_are_those_of_a_plain_string_kernel():
    """``weigh`` against the kernel written out, and its folded weights against
    the product with each landmark."""
    rng = random.Random(5)
    strings = ["".join(rng.choice("abcé.-é日") for _ in range(rng.randrange(1, 14))) for _ in range(60)] + ["", "a", "idiot", "i.d.i.o.t", "idxiot"]

    def plain(x):
        codes = [toxicity._BEGIN, *(int(c) for c in toxicity._codes([x])[0][1:1 + len(x)]), toxicity._END]
        out = {}
        for i in range(len(codes)):
            for j in range(i + 1, len(codes)):
                for k in range(j + 1, min(i + toxicity.REACH, len(codes))):
                    if codes[i] and codes[j] and codes[k]:
                        out.setdefault((codes[i], codes[j], codes[k]), []).append(toxicity.DECAY ** (k - i - 2))
        norm = sum(w * w for ws in out.values() for w in ws) ** 0.5
        return {t: sum(ws) / max(norm, 1e-4) for t, ws in out.items()}

    place = lambda t: (t[0] * toxicity._SIZE + t[1]) * toxicity._SIZE + t[2]
    features = [plain(x) for x in strings]
    landmarks = features[:5]
    share = np.random.default_rng(1).normal(size=5)
    folded = np.zeros(toxicity._SIZE ** 3, np.float32)
    for mark, w in zip(landmarks, share):
        for t, v in mark.items():
            folded[place(t)] += w * v
    want = [sum(w * sum(v * mark.get(t, 0.0) for t, v in f.items()) for mark, w in zip(landmarks, share)) for f in features]
    assert toxicity.weigh(strings, folded) == pytest.approx(np.array(want), abs=2e-5)
    dense, found = toxicity._features(strings)
    assert [{int(found[c]): float(v) for c, v in enumerate(row) if v} for row in dense] == [pytest.approx({place(t): v for t, v in f.items()}, abs=1e-5) for f in features]


PIPELINE = ["documents", "labels", "benchmark"]


def tables(spark, folder, **frames):
    """A folder of the pipeline's tables; those not given are as in the test data."""
    for name in PIPELINE:
        df = frames.get(name)
        if df is None:
            df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    whole = {n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in PIPELINE}
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    nothing = corpus_pipeline.run(spark, tables(spark, tmp_path / "a", **{n: t.limit(0) for n, t in whole.items()}))
    assert nothing.columns == columns and nothing.count() == 0
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "b", documents=whole["documents"].limit(0))).count() == 0
    # without labels and benchmark nothing goes for them
    free = corpus_pipeline.run(spark, tables(spark, tmp_path / "c", labels=whole["labels"].limit(0), benchmark=whole["benchmark"].limit(0)))
    assert 0 < free.count() <= whole["documents"].count()


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a document without an id, but with words of its own", "en", None, 50), (7001, "", "xx", "s", 0), (7002, None, None, "s", 0),
                                 (7003, "row that stands twice in this table of documents", "en", "s", 40), (7003, "row that stands twice in this table of documents", "en", "s", 40),
                                 (7004, "word " * 200_000, "en", "s", 10**6)], base.schema)
    docs = clashing(base.unionByName(odd))
    folder = tables(spark, tmp_path / "odd", documents=docs)
    rows = corpus_pipeline.run(spark, folder).collect()
    seen = [r.doc_id for r in rows]
    assert seen.count(7003) <= 1 and set(seen) <= {r.doc_id for r in docs.select("doc_id").collect()}
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert all(r.n_tokens == 200_001 for r in rows if r.doc_id == 7004)


def test_normal_strings():
    assert normal_string("«IDIOT!!»") == "idiot" and normal_string("1d10t") == "idiot" and normal_string("soooo") == "soo" and normal_string("2024") == "" and normal_string("i d i") == "idi"


def test_pipeline_equals_its_stages(spark):
    import corpus_pipeline
    from residuum.llm.shared import Workspace
    from residuum.llm.words import WordEncoder
    from residuum.llm.queries import vocabulary_path

    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    work = Workspace(spark, "test")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = work.table(stage(spark, docs, sf), f"s{k}")
        assert docs.columns == first.columns
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    out = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())
    encode, start, want = WordEncoder(vocabulary_path()).tokenizer.encode, 0, []
    for doc, text in texts:
        ids = [*encode(text, add_special_tokens=False).ids, 2]
        want.append((start, doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert out == want
    assert words(random.Random(1), 3)
