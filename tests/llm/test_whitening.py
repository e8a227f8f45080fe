"""Secular updates against dense decompositions; whitening against a direct one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from residuum.llm.spectrum import Spectrum, rank_one, secular_roots
from residuum.llm.whitening import whiten

from .conftest import clashing


def check(values, vectors, matrix, most=1e-12):
    size = max(np.abs(matrix).max(), 1e-300)
    assert np.abs(vectors @ np.diag(values) @ vectors.T - matrix).max() <= most * size * len(matrix)
    assert np.abs(vectors.T @ vectors - np.eye(len(matrix))).max() <= 1e-11
    assert (np.diff(values) >= 0).all()


def test_roots_interlace():
    rng = np.random.default_rng(1)
    for k in (1, 2, 5, 64):
        poles, weights = np.sort(rng.normal(size=k)) * 10, rng.random(k) + 1e-9
        roots, diff = secular_roots(poles, weights)
        assert (roots > poles).all() and (roots[:-1] < poles[1:]).all()
        assert np.allclose(roots, np.linalg.eigvalsh(np.diag(poles) + np.outer(np.sqrt(weights), np.sqrt(weights))), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("kind", ["random", "zeros", "equal", "clusters", "untouched", "graded", "same"])
def test_rank_one_updates(kind):
    rng = np.random.default_rng(2)
    d = 12
    start = {"random": rng.random(d) * 9, "zeros": np.zeros(d), "equal": np.full(d, 3.0), "clusters": np.repeat([1.0, 1.0 + 1e-15, 5.0], 4),
             "untouched": np.arange(d) * 1.0, "graded": 10.0 ** -np.arange(d), "same": np.zeros(d)}[kind]
    values, vectors = np.sort(start), np.linalg.qr(rng.normal(size=(d, d)))[0]
    matrix = vectors @ np.diag(values) @ vectors.T
    fixed = rng.normal(size=d)
    for step in range(40):
        z = fixed if kind == "same" else vectors[:, :3] @ rng.normal(size=3) if kind == "untouched" else rng.normal(size=d) * 10.0 ** (step % 7 - 3)
        values, vectors = rank_one(values, vectors, z)
        matrix = matrix + np.outer(z, z)
        check(values, vectors, matrix)
    assert rank_one(values, vectors, np.zeros(d))[0] is values


@pytest.mark.parametrize("together", [1, 3, 64])
def test_spectra_add_up(together):
    rng = np.random.default_rng(3)
    rows = rng.integers(-50, 50, (90, 6)) + np.array([0, 9e5, -3, 7, 1e6, 0])
    a, b = Spectrum(6), Spectrum(6)
    a.add_rows(rows[:50], together)
    b.add_rows(rows[50:], together)
    a.add(b)
    centred = rows - rows.mean(0)
    assert a.n == 90 and np.allclose(a.mean, rows.mean(0), rtol=1e-14)
    check(a.values, a.vectors, centred.T @ centred, 1e-9)


def direct(vecs, k=8):
    """The contract on a list of vectors, by plain means."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vecs]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    with np.errstate(all="ignore"):
        return deviation, centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def compare(rows, ids, vecs, k):
    deviation, white, explained = direct(vecs, k)
    got = np.full((len(ids), k), np.nan)
    place = {v: i for i, v in enumerate(ids)}
    for r in rows:
        i = place[r.vec_id]
        assert (r.n, r.deviation) == (len(ids), deviation[i])
        got[i, r.component - 1] = r.whitened
        assert abs(r.explained - explained[r.component - 1]) <= 1e-9 and r.identity_error <= 1e-7
    assert len({r.identity_error for r in rows}) == 1 and len(rows) == len(ids) * k
    sign = np.sign((got * white).sum(0))
    assert np.abs(got * sign - white).max() < 1e-6


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)


@pytest.mark.parametrize("together", [1, 2048])
def test_whitening_equals_a_direct_one(spark, work, together):
    rng = np.random.default_rng(4)
    vecs = (rng.normal(size=(300, 12)) * (12 - np.arange(12)) / 20).astype(np.float32)
    vecs[100:200] = vecs[7]  # a third are copies
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(vecs)]
    bad = [(900, None, 0), (901, [float("nan")] * 12, 0), (902, [float("inf")] + [0.0] * 11, 0), (903, [None] + [0.0] * 11, 0), (904, [1.0], 0), (905, [], 0), (906, [1e30] * 12, 0)]
    got = whiten(clashing(frame(spark, rows + bad)), work, together=together).collect()
    compare(got, list(range(300)), vecs.tolist(), 8)


def test_whole_table(spark, work):
    t = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = t.select("vec_id", "embedding").collect()
    compare(whiten(t, work).collect(), [r.vec_id for r in rows], [r.embedding for r in rows], 8)


def test_cases(spark, work):
    assert whiten(frame(spark, [(1, [1.0], 0)]).filter("vec_id = 2"), work).count() == 0
    assert whiten(frame(spark, [(1, None, 0)]), work).count() == 0
    one = whiten(frame(spark, [(1, [1.0, 2.0, 3.0], 0)]), work).collect()
    assert sorted((r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [(c, 1, 0, None, None, None) for c in (1, 2, 3)]
    flat = whiten(frame(spark, [(i, [float(i), 1.0], 0) for i in range(5)] + [(None, [9.0, 1.0], 0), (0, [0.0, 1.0], 0)]), work).collect()
    assert len(flat) == 14 and all((r.whitened is None) == (r.component == 2) for r in flat) and all(r.identity_error < 1e-9 for r in flat)
    huge = whiten(frame(spark, [(i, [float(i) * 2.0**40], 0) for i in range(4)]), work).collect()
    assert all(r.deviation is None for r in huge) and abs(sum(r.whitened for r in huge)) < 1e-9


def test_combining_many_spectra(spark, work):
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(200, 5)).astype(np.float32)
    t = frame(spark, [(i, [float(c) for c in v], 0) for i, v in enumerate(vecs)]).repartition(40, F.col("vec_id"))
    compare(whiten(t, work).collect(), list(range(200)), vecs.tolist(), 5)
