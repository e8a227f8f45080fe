"""Properties of the correction with every technique,
the Gram-form gradient descent against MLlib's, and the registry."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from residuum import correct
from residuum.operators import models as M
from residuum.operators.gram import GramLeastSquares
from residuum.operators.prepare import add_delta
from residuum.sources.tables import CALIBRATION_SPEC, calibration_orders

from conftest import SF001

SPEC = CALIBRATION_SPEC


@pytest.fixture(scope="module")
def cal(spark):
    return calibration_orders(spark, SF001).cache()


def stats(res):
    rows = {r["series"]: r for r in res.report.collect()}
    agg = res.series.agg(F.sum("observed").alias("so"), F.sum("delta_e").alias("sd"),
                         (F.var_pop("observed") * F.count("observed")).alias("sst_o"),
                         (F.var_pop("delta_e") * F.count("delta_e")).alias("sst_d"),
                         F.count(F.lit(1)).alias("n")).first()
    return rows, agg


@pytest.mark.parametrize("tech", ["decision_tree", "rf", "gb_tree", "glr", "linear", "sgd"])
def test_algebraic_properties(spark, cal, tech):
    res = correct(cal, SPEC, tech)
    rows, agg = stats(res)
    o, i, d = rows["original"], rows["improved"], rows["delta_error"]
    # improved - observed == e_hat - delta_e, so the two RMSEs agree
    assert math.isclose(i["rmse"], d["rmse"], rel_tol=1e-9)
    # ... and so do the two SSEs
    assert math.isclose((1 - i["nse"]) * agg["sst_o"], (1 - d["nse"]) * agg["sst_d"], rel_tol=1e-6)
    # ... and the PBIAS numerators
    assert math.isclose(i["pbias"] * agg["so"], d["pbias"] * agg["sd"], rel_tol=1e-6, abs_tol=1e-3)
    # NSE can never beat CD
    for r in rows.values():
        assert r["nse"] <= r["cd"] + 1e-12
    # original series does not depend on the technique
    assert math.isclose(o["rmse"], 190840.0, rel_tol=0.2)
    # every input key is scored exactly once
    assert res.series.count() == cal.count() == res.series.select("row_id").distinct().count()
    assert rows["original"]["technique"] == tech
    assert rows["original"]["eval_scope"] == M.REGISTRY[tech].eval_scope


def test_glr_all_rows_zero_bias(spark, cal):
    res = correct(cal, SPEC, "glr")
    rows, _ = stats(res)
    assert abs(rows["improved"]["pbias"]) < 1e-6 and abs(rows["delta_error"]["pbias"]) < 1e-6
    assert rows["improved"]["rmse"] < rows["original"]["rmse"]


@pytest.mark.parametrize("tech", ["decision_tree", "gb_tree"])
def test_trees_beat_mean_on_train(spark, cal, tech):
    res = correct(cal, SPEC, tech)
    from residuum.operators.split import train_flag
    tr = res.series.where(train_flag("row_id"))
    m = tr.agg(F.avg("delta_e")).first()[0]
    got = tr.agg(F.sqrt(F.avg((F.col("e_hat") - F.col("delta_e")) ** 2)),
                 F.sqrt(F.avg((F.lit(m) - F.col("delta_e")) ** 2))).first()
    assert got[0] <= got[1]


def test_holdout_scope_scores_only_holdout(spark, cal):
    res = correct(cal, SPEC, "decision_tree", scope="holdout")
    n = res.series.count()
    h = res.holdout.first()
    assert n == h["n_eval"] and 0.2 * cal.count() < n < 0.4 * cal.count()


def test_random_split_path(spark, cal):
    res = correct(cal, SPEC, "decision_tree", split="random", seed=3)
    h = res.holdout.first()
    assert h["rmse"] > 0 and 0 < h["n_eval"] < cal.count()


def test_metrics_invariant_to_partitioning(spark, cal):
    a = {r["series"]: r for r in correct(cal, SPEC, "glr").metrics.collect()}
    b = {r["series"]: r for r in correct(cal.repartition(7), SPEC, "glr").metrics.collect()}
    for s in a:
        assert math.isclose(a[s]["rmse"], b[s]["rmse"], rel_tol=1e-9)


def test_unknown_technique(spark, cal):
    with pytest.raises(ValueError, match="unknown technique"):
        correct(cal, SPEC, "svm")


def test_gram_descent_matches_mllib_sgd(spark, cal):
    from pyspark.mllib.regression import LabeledPoint, LinearRegressionWithSGD
    df = add_delta(cal, SPEC).select("delta_e", "qty", "n_lines")
    pts = df.rdd.map(lambda r: LabeledPoint(r.delta_e, [r.qty, r.n_lines]))
    for step, tol, iters in [(1e-8, 0.001, 100), (1e-6, 0.0, 30)]:
        ref = LinearRegressionWithSGD.train(pts, iterations=iters, step=step,
                                            miniBatchFraction=1.0, convergenceTol=tol)
        ours = GramLeastSquares(("qty", "n_lines"), "delta_e", iterations=iters, step=step,
                                tol=tol).fit(df)
        np.testing.assert_allclose(ours.weights, ref.weights.toArray(), rtol=1e-9)


def test_introspection(spark, cal):
    glr = correct(cal, SPEC.with_features("qty", "n_lines"), "glr")
    coefs = {r.feature: r.coefficient for r in M.coefficients(spark, glr.model).collect()}
    assert set(coefs) == {"qty", "n_lines", "(intercept)"}
    summ = M.glr_summary(spark, glr.model).first()
    assert summ["residual_dof"] == cal.count() - 3 and summ["deviance"] > 0
    dt = correct(cal, SPEC, "decision_tree")
    ts = M.tree_summary(spark, dt.model).collect()
    assert len(ts) == 5 and ts[0]["depth"] <= 5
    assert math.isclose(sum(r["importance"] for r in ts), 1.0, rel_tol=1e-9)
    res = M.residuals(glr.series.withColumnRenamed("e_hat", "prediction"), "delta_e")
    assert res.where(F.abs(F.col("residual") - (F.col("delta_e") - F.col("prediction"))) > 1e-9).count() == 0


@pytest.mark.parametrize("tech", ["decision_tree", "rf", "gb_tree"])
def test_seeded_fits_are_reproducible(spark, cal, tech):
    a = [tuple(r) for r in correct(cal, SPEC, tech).report.collect()]
    b = [tuple(r) for r in correct(cal, SPEC, tech).report.collect()]
    assert a == b
    # the pinned input is sorted by key within partitions, so a shuffled copy
    # with the same partitioning gives the same model
    shuffled = cal.repartition(4, "row_id").orderBy(F.rand(7)).repartition(4, "row_id")
    ref = cal.repartition(4, "row_id")
    c = [tuple(r) for r in correct(ref, SPEC, tech).report.collect()]
    d = [tuple(r) for r in correct(shuffled, SPEC, tech).report.collect()]
    assert c == d
