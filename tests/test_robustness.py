"""Rows in equal rows out: NULL keys, odd names, malformed files, ties; and
nothing stored is left behind."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from residuum import compare_techniques, correct
from residuum.operators.alignment import attach, attach_by_position
from residuum.operators.gram import GramLeastSquares
from residuum.operators.materialize import materialize, release, stored
from residuum.operators.ordering import dense_index
from residuum.operators.prepare import add_delta, clean
from residuum.operators.split import holdout_split
from residuum.session import checkpoint_dir
from residuum.sinks import accuracy_text, general_number, report_json
from residuum.sources.readers import read_calibration
from residuum.sources.tables import CALIBRATION_SPEC, calibration_orders
from residuum.spec import CalibrationSpec

from conftest import SF001


def test_split_places_null_keys(spark):
    df = spark.range(100).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("k"))
    train, hold = holdout_split(df, "k")
    assert train.count() + hold.count() == 100


@pytest.mark.parametrize("fraction", [0.995, 0.004, 0.125, 0.7])
def test_split_meets_any_fraction(spark, fraction):
    n = 20_000
    train, hold = holdout_split(spark.range(n).withColumnRenamed("id", "k"), "k", fraction, check=True)
    got = train.count()
    assert got + hold.count() == n
    assert abs(got - fraction * n) < 5 * math.sqrt(n * fraction * (1 - fraction)) + 1


def test_split_rejects_empty_side(spark):
    one = spark.range(1).withColumnRenamed("id", "k")
    with pytest.raises(ValueError, match="leaves no rows"):
        holdout_split(one, "k", check=True)


def test_attach_keeps_null_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k long, a string")
    b = spark.createDataFrame([(1, 1.0), (None, 2.0)], "k long, v double")
    assert sorted((r.a, r.v) for r in attach(a, b, "k").collect()) == [("x", 1.0), ("y", 2.0)]


def test_attach_by_position_keeps_null_series(spark):
    rows = [("s|1", "2", 0), ("s|1", "2", 1), (None, "2", 0), (None, "2", 1), ("s", "1|2", 0), ("s", "1|2", 1)]
    df = spark.createDataFrame([(a, b, t, f"{a}-{b}-{t}") for a, b, t in rows], "a string, b string, t long, name string")
    values = spark.createDataFrame([(a, b, t, float(i)) for i, (a, b, t) in enumerate(rows)], "a string, b string, pos long, v double")
    got = attach_by_position(df, ["t"], values, partition_by=["a", "b"]).collect()
    assert len(got) == len(rows)
    assert {r.name: r.v for r in got} == {f"{a}-{b}-{t}": float(i) for i, (a, b, t) in enumerate(rows)}


@pytest.mark.parametrize("pin", ["auto", "checkpoint", "persist"])
def test_dense_index_over_many_partitions_and_nulls(spark, pin):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 != 0, F.col("id") % 3).alias("s"))
    got = dense_index(df, ["id"], ["s"], num_partitions=7, pin=pin)
    assert got.count() == 3000
    per = got.groupBy("s").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.countDistinct("idx").alias("n")).collect()
    assert all((r.lo, r.hi, r.n) == (0, 999, 1000) for r in per) and len(per) == 3
    assert got.where(F.col("idx") != F.floor(F.col("id") / 3)).count() == 0


def test_dense_index_splits_tied_groups(spark):
    df = spark.range(20_000).select(F.lit(1).alias("s"), F.lit(5).alias("t"), "id")
    got = dense_index(df, ["t"], ["s"], num_partitions=4)
    assert got.agg(F.countDistinct("idx"), F.min("idx"), F.max("idx")).first() == (20_000, 0, 19_999)
    assert got.where("idx <> id").count() == 0      # ties go by the remaining columns


ODD = [f"obs.cfs,sim,delta_e,features,prediction,x`y,e_hat\n"] + [
    f"{i + 1.5},{i},{i % 7},{i % 3},{i % 5},{i % 2},{i % 4}\n" for i in range(200)]


def test_any_header_works(spark, tmp_out):
    path = os.path.join(tmp_out, "odd.csv")
    with open(path, "w") as fh:
        fh.writelines(ODD)
    df, spec = read_calibration(spark, path)
    assert spec.observed == "obs.cfs" and "delta_e" in spec.features
    for t in ("glr", "decision_tree", "sgd"):
        with correct(df, spec, t) as res:
            rows = res.series.collect()
            assert len(rows) == 200
            # the label is the error, not the feature of that name
            assert all(math.isclose(r["delta_e"], 1.5) for r in rows)
            assert {r["input_delta_e"] for r in rows} == set(map(float, range(7)))


def test_missing_tokens_and_malformed_rows(spark, tmp_out):
    good = os.path.join(tmp_out, "good.csv")
    with open(good, "w") as fh:
        fh.write("o,p,f\n1,2,NA\nNaN,1,3\n4,null,\n")
    df, spec = read_calibration(spark, good)
    rows = clean(df, spec).orderBy("row_id").collect()
    assert [(r.o, r.p, r.f) for r in rows] == [(1.0, 2.0, 0.0), (None, 1.0, 3.0), (4.0, None, 0.0)]
    bad = os.path.join(tmp_out, "bad.csv")
    with open(bad, "w") as fh:
        fh.write("o,p,f\n1,2,x9\n1,2\n1,2,3,4\n1,2,3\n")
    with pytest.raises(ValueError, match="3 malformed rows"):
        read_calibration(spark, bad)
    assert read_calibration(spark, bad, check=False)[0].count() == 4


def test_split_does_not_follow_file_splits(spark, tmp_out):
    path = os.path.join(tmp_out, "many.csv")
    with open(path, "w") as fh:
        fh.write("o,p,f\n" + "".join(f"{i * 1.5},{i},{i % 9}\n" for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = set()
    try:
        for size in ("128m", "8k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df, spec = read_calibration(spark, path)
            seen.add(tuple(correct(df, spec, "decision_tree", maxDepth=1).holdout.select("n_eval").first()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(seen) == 1


def test_no_key_and_overlapping_keep(spark):
    df = spark.createDataFrame([(float(i), float(i) - 1, float(i % 3)) for i in range(50)], "o double, p double, yr double")
    res = correct(df, CalibrationSpec("o", "p", ("yr",)), "glr", keep=["yr", "yr"])
    assert res.series.count() == 50 and res.series.columns.count("yr") == 1


def test_add_delta_refuses_a_taken_name(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "o double, p double, delta_e double")
    with pytest.raises(ValueError, match="delta_e"):
        add_delta(df, CalibrationSpec("o", "p", ("delta_e",)))


def test_report_json_keeps_undefined_metrics(spark):
    df = spark.createDataFrame([(i, 5.0, float(i), float(i % 2)) for i in range(20)], "row_id long, o double, p double, f double")
    res = correct(df, CalibrationSpec("o", "p", ("f",)), "glr")
    doc = json.loads(report_json(res.report).first().report)
    assert len(doc) == 14 and doc["original_nse"] is None and doc["original_cd"] is None


def test_general_number_is_percent_g(spark):
    values = [0.0, 1.0, -1.5, 190840.1417, 156079.08, 999999.5, 1234567.0, 1e-4, 1.23456789e-5, 0.1, 100.0, 123456.4, 1e10, -3.25e-7, 5e15, 0.00012345678]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", general_number(F.col("v")).alias("t"))
    for r in df.collect():
        assert r.t == "%g" % r.v
    assert accuracy_text(2.5).endswith("= 2.5")


def test_wide_descent_equals_narrow(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 20))
    x[:, 7] = 2.0                                   # a constant column
    y = x @ rng.normal(size=20) + 1
    names = tuple(f"f{i}" for i in range(20))
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"{n} double" for n in names) + ", y double")
    est = GramLeastSquares(names, "y", iterations=50, step=0.05, tol=0.0)
    n, g, b, yy = est.moments(df)
    np.testing.assert_allclose(g, x.T @ x / 300, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(b, x.T @ y / 300, rtol=1e-9, atol=1e-9)
    assert n == 300 and math.isclose(yy, float(y @ y) / 300, rel_tol=1e-9)


def _stored_files(spark):
    base = checkpoint_dir(spark).removeprefix("file:")
    return [f for d, _, names in os.walk(base) for f in names if "/residuum-" in d]


def test_release_leaves_nothing(spark):
    cal = calibration_orders(spark, SF001)
    with stored():
        had = len(_stored_files(spark))
        with correct(cal, CALIBRATION_SPEC, "glr") as res:
            assert res.metrics.count() == 3 and len(_stored_files(spark)) > had
        rep = compare_techniques(cal, CALIBRATION_SPEC, ("glr", "sgd"))
        assert rep.count() == 6
        release(rep)
        idx = dense_index(cal.select("row_id"), ["row_id"])
        assert idx.count() == cal.count()
        release(idx)
        assert len(_stored_files(spark)) == had
        materialize(cal)
    assert len(_stored_files(spark)) == had


def test_storing_needs_a_shared_folder(spark):
    from residuum.operators import materialize as m
    old = m.checkpoint_dir
    m.checkpoint_dir = lambda s: None
    try:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            materialize(calibration_orders(spark, SF001))
    finally:
        m.checkpoint_dir = old
