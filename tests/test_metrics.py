"""Goldens and properties of RMSE, PBIAS, CD and NSE."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from residuum.functions.metrics import goodness_of_fit, series_report

SCHEMA = "row_id long, observed double, predicted double"


def ref_metrics(sim, obs):
    """Direct formulas on complete pairs (NumPy)."""
    sim, obs = np.asarray(sim, float), np.asarray(obs, float)
    ok = ~(np.isnan(sim) | np.isnan(obs))
    s, o = sim[ok], obs[ok]
    if len(s) == 0:
        return dict(rmse=None, pbias=None, cd=None, nse=None)
    rmse = math.sqrt(np.mean((s - o) ** 2))
    pbias = None if o.sum() == 0 else 100 * (s - o).sum() / o.sum()
    ds, do = s - s.mean(), o - o.mean()
    den = math.sqrt((ds ** 2).sum()) * math.sqrt((do ** 2).sum())
    cd = None if den == 0 else ((ds * do).sum() / den) ** 2
    sst = (do ** 2).sum()
    nse = None if sst == 0 else 1 - ((s - o) ** 2).sum() / sst
    return dict(rmse=rmse, pbias=pbias, cd=cd, nse=nse)


def run(spark, obs, pred):
    rows = [(i, o, p) for i, (o, p) in enumerate(zip(obs, pred))]
    df = spark.createDataFrame(rows, SCHEMA)
    return goodness_of_fit(df, "predicted", "observed").first().asDict()


def close(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return abs(a - b) <= tol * max(1.0, abs(a), abs(b))


def test_perfect(spark):
    m = run(spark, [1.0, 2.0, 4.0], [1.0, 2.0, 4.0])
    assert m["rmse"] == 0.0 and m["pbias"] == 0.0 and m["nse"] == 1.0
    assert close(m["cd"], 1.0, 1e-12)


def test_biased(spark):
    m = run(spark, [1.0, 2.0, 4.0], [3.0, 4.0, 6.0])
    assert close(m["cd"], 1.0) and m["nse"] < 1.0 and close(m["rmse"], 2.0)
    assert close(m["pbias"], 100 * 6 / 7)


def test_integers_not_floored(spark):
    df = spark.createDataFrame([(1, 1, 2), (2, 2, 2), (3, 4, 2)],
                               "row_id long, observed int, predicted int")
    from residuum.operators.prepare import clean
    from residuum.spec import CalibrationSpec
    m = goodness_of_fit(clean(df, CalibrationSpec("observed", "predicted")),
                        "predicted", "observed").first()
    exp = ref_metrics([2, 2, 2], [1, 2, 4])
    assert close(m["rmse"], exp["rmse"]) and close(m["pbias"], exp["pbias"])
    assert m["rmse"] == pytest.approx(math.sqrt(5 / 3))


def test_constant_observed(spark):
    m = run(spark, [3.0, 3.0, 3.0], [1.0, 2.0, 4.0])
    assert m["cd"] is None and m["nse"] is None and m["rmse"] is not None


def test_constant_predicted(spark):
    m = run(spark, [1.0, 2.0, 4.0], [2.0, 2.0, 2.0])
    assert m["cd"] is None and close(m["nse"], ref_metrics([2, 2, 2], [1, 2, 4])["nse"])


def test_zero_sum_observed(spark):
    m = run(spark, [1.0, -1.0], [0.5, 0.5])
    assert m["pbias"] is None and m["rmse"] is not None


def test_nulls_and_nans_skip_pairs(spark):
    obs = [1.0, None, 3.0, float("nan"), 5.0]
    pred = [1.5, 2.0, None, 4.0, 4.0]
    from residuum.operators.prepare import clean
    from residuum.spec import CalibrationSpec
    df = spark.createDataFrame([(i, o, p) for i, (o, p) in enumerate(zip(obs, pred))], SCHEMA)
    m = goodness_of_fit(clean(df, CalibrationSpec("observed", "predicted")),
                        "predicted", "observed").first().asDict()
    exp = ref_metrics([1.5, 4.0], [1.0, 5.0])
    for k in exp:
        assert close(m[k], exp[k]), k


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    m = goodness_of_fit(df, "predicted", "observed").first().asDict()
    assert m == {"rmse": None, "pbias": None, "cd": None, "nse": None}


def test_series_report_stacks_rows(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, 2.0, 2.5), (2, 4.0, 3.0)], SCHEMA)
    rep = series_report(df, {"a": ("predicted", "observed"), "b": ("observed", "predicted")})
    rows = {r["series"]: r for r in rep.collect()}
    assert set(rows) == {"a", "b"}
    assert close(rows["a"]["rmse"], rows["b"]["rmse"])


def test_grouped_metrics(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, "x"), (1, 2.0, 2.5, "x"), (2, 4.0, 3.0, "y"),
                                (3, 5.0, 1.0, "y")],
                               SCHEMA + ", site string")
    got = {r["site"]: r for r in goodness_of_fit(df, "predicted", "observed", "site").collect()}
    assert close(got["x"]["rmse"], ref_metrics([2.0, 2.5], [1.0, 2.0])["rmse"])
    assert close(got["y"]["nse"], ref_metrics([3.0, 1.0], [4.0, 5.0])["nse"])


finite = st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(finite, finite), min_size=2, max_size=40))
def test_matches_direct_formulas(spark, pairs):
    obs = [p[0] for p in pairs]
    pred = [p[1] for p in pairs]
    m = run(spark, obs, pred)
    exp = ref_metrics(pred, obs)
    assert close(m["rmse"], exp["rmse"], 1e-7)
    if exp["nse"] is not None and m["nse"] is not None and m["cd"] is not None:
        # NSE can never beat CD (CD is the best NSE of any linear rescaling)
        assert m["nse"] <= m["cd"] + 1e-9


def test_metamorphic_shift_and_repartition(spark):
    rows = [(i, float(o), float(p)) for i, (o, p) in
            enumerate(zip([3, 5, 2, 8, 7, 1, 4], [2.5, 5.5, 2.0, 7.0, 8.0, 1.5, 3.0]))]
    df = spark.createDataFrame(rows, SCHEMA)
    base = goodness_of_fit(df, "predicted", "observed").first()
    shifted = df.withColumn("observed", df.observed + 100.0)
    m = goodness_of_fit(shifted, "predicted", "observed").first()
    assert close(m["cd"], base["cd"], 1e-9)          # CD ignores a constant shift
    assert not close(m["pbias"], base["pbias"])      # PBIAS does not
    again = goodness_of_fit(df.repartition(3), "predicted", "observed").first()
    for k in ("rmse", "pbias", "cd", "nse"):
        assert close(again[k], base[k], 1e-12)


def test_missing_observations_are_scored_not_fitted(spark):
    from residuum import correct
    from residuum.spec import CalibrationSpec
    rows = [(i, float(i % 7) + (0.5 if i % 2 else -0.5), float(i % 7), float(i % 5))
            for i in range(60)]
    rows += [(100, None, 3.0, 1.0), (101, float("nan"), 2.0, 2.0)]
    df = spark.createDataFrame(rows, "row_id long, obs double, sim double, f double")
    spec = CalibrationSpec("obs", "sim", ("f",))
    res = correct(df, spec, "glr")
    scored = {r.row_id: r for r in res.series.collect()}
    assert len(scored) == 62 and scored[100].e_hat is not None and scored[100].delta_e is None
    assert res.holdout.first()["n_eval"] == 60
