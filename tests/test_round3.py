"""Folders of differing headers, lists of one line, sliced series, report lists,
fit statistics from one aggregate and splits that are stored."""

import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from residuum import correct
from residuum.functions.student import two_sided
from residuum.operators import models as M
from residuum.operators.gram import central_moments
from residuum.operators.split import PLACE, holdout_split, with_random_place
from residuum.sinks import report_series, report_series_json, write_prediction_list, write_report_series
from residuum.sources.readers import explode_series, read_calibration, read_prediction_file, read_prediction_list
from residuum.sources.tables import CALIBRATION_SPEC, calibration_orders

from conftest import SF001


def put(folder, **files):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(os.path.join(folder, name.replace("_dot_", ".")), "w") as fh:
            fh.write(text)


# ------------------------------------------------------------ headers

def test_each_file_has_its_own_header(spark, tmp_out):
    folder = os.path.join(tmp_out, "two orders [1]")
    put(folder, a_dot_csv="obs,pred,f1,row_id\n1,2,3,10\n4,5,6,11\n", b_dot_csv="\nrow_id,pred,f1,obs\n12,8,9,7\n", c_dot_csv="obs,pred,f1,row_id\n", d_dot_csv="")
    rows = None
    for _ in range(2):
        df, spec = read_calibration(spark, folder.replace("[", "\\[").replace("]", "\\]"), observed="obs", predicted="pred")
        rows = sorted((r.row_id, r.obs, r.pred, r.f1) for r in df.collect())
        assert (spec.observed, spec.predicted, spec.features) == ("obs", "pred", ("f1",))
        assert rows == [(10, 1.0, 2.0, 3.0), (11, 4.0, 5.0, 6.0), (12, 7.0, 8.0, 9.0)]


def test_headers_that_do_not_go_together(spark, tmp_out):
    swapped = os.path.join(tmp_out, "swapped")
    put(swapped, a_dot_csv="obs,pred,f1\n1,2,3\n", b_dot_csv="pred,obs,f1\n2,1,3\n")
    with pytest.raises(ValueError, match="name observed and predicted"):
        read_calibration(spark, swapped)
    df, spec = read_calibration(spark, swapped, observed="obs", predicted="pred")
    assert [(r.obs, r.pred, r.f1) for r in df.collect()] == [(1.0, 2.0, 3.0)] * 2
    assert df.select(spec.split_key).distinct().count() == 1     # the same content, whatever the order
    with pytest.raises(Exception, match="header"):
        read_calibration(spark, swapped, check=False)[0].collect()
    features = os.path.join(tmp_out, "features")
    put(features, a_dot_csv="o,p,x,y\n1,2,3,4\n", b_dot_csv="o,p,y,x\n1,2,4,3\n")
    df, spec = read_calibration(spark, features)
    assert (spec.observed, spec.predicted) == ("o", "p") and [(r.x, r.y) for r in df.collect()] == [(3.0, 4.0)] * 2
    other = os.path.join(tmp_out, "other")
    put(other, a_dot_csv="o,p,x\n1,2,3\n", b_dot_csv="o,p,z\n1,2,3\n")
    with pytest.raises(ValueError, match="another file"):
        read_calibration(spark, other)
    bad = os.path.join(tmp_out, "bad")
    put(bad, a_dot_csv="o,p,x\n1,2,3\n1,2,q\n", b_dot_csv="p,o,x\n2,1,3\n2,1\n")
    with pytest.raises(ValueError, match="2 malformed rows"):
        read_calibration(spark, bad, observed="o", predicted="p")


def test_repeated_names_in_a_header(spark, tmp_out):
    folder = os.path.join(tmp_out, "repeated")
    put(folder, a_dot_csv="o,p,x,x\n1,2,3,4\n", b_dot_csv="o,p,x,x\n5,6,7,8\n")
    df, spec = read_calibration(spark, folder)
    assert len(spec.features) == 2 and sorted(tuple(r[c] for c in spec.features) for r in df.collect()) == [(3.0, 4.0), (7.0, 8.0)]


# ------------------------------------------------------------ lists

def test_a_list_that_is_one_line(spark, tmp_out):
    rng = random.Random(1)
    values = [round(rng.uniform(-1e6, 1e6), 3) for _ in range(60_000)]
    path = os.path.join(tmp_out, "result.txt")
    with open(path, "w") as fh:
        fh.write("Root Mean Squared Error (RMSE) on test data = 3.5\n" + ", ".join(map(repr, values)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        items = spark.read.option("lineSep", ",").text(path)
        assert items.rdd.getNumPartitions() > 8          # one line, many tasks
        got = read_prediction_file(spark, path)
        rows = sorted((r.pos, r.value) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == list(enumerate(values))
    assert sorted((r.pos, r.value) for r in got.collect()) == rows     # read again under other splits


def test_short_lists_and_empty_ones(spark, tmp_out):
    cases = {"one": ("line\n5", 1, [5.0]), "none": ("line\n", 1, []), "alone": ("line", 1, []), "blank": ("line\n \n", 1, []), "plain": ("1,2 , 3\r\n", 0, [1.0, 2.0, 3.0]),
             "closed": ("1,2,", 0, [1.0, 2.0]), "nothing": ("", 0, []), "two": ("a\nb\n-1e-3,NaN\n", 2, [-0.001, None])}
    for name, (text, lines, want) in cases.items():
        put(tmp_out, **{name: text})
        got = [r.value for r in read_prediction_file(spark, os.path.join(tmp_out, name), lines).orderBy("pos").collect()]
        assert [None if math.isnan(v) else v for v in got] == want, name
    put(tmp_out, wrong="line\n1,x,3\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|Cast"):
        read_prediction_file(spark, os.path.join(tmp_out, "wrong")).collect()
    df = spark.createDataFrame([(1, ""), (2, " "), (3, None), (4, "7")], "k long, line string")
    assert [(r.k, r.pos, r.value) for r in read_prediction_list(df, "line", keep=["k"]).collect()] == [(4, 0, 7.0)]


def test_lists_are_written_by_many_tasks(spark, tmp_out):
    path = os.path.join(tmp_out, "list")
    df = spark.range(5000).select((F.lit(4999) - F.col("id")).alias("k"), (F.col("id") / 7).alias("v")).repartition(5)
    write_prediction_list(df, path, ["k"], "v")
    got = read_prediction_file(spark, path, header_lines=0)
    assert [(r.pos, r.value) for r in got.orderBy("pos").collect()] == [(i, (4999 - i) / 7) for i in range(5000)]


# ------------------------------------------------------------ series

def test_sliced_series_equal_whole_ones(spark):
    rows = [(1, list(map(float, range(25))), list(map(float, range(20)))), (2, [], None), (3, None, [9.0]), (None, [None, 2.0], [1.0, None])]
    df = spark.createDataFrame(rows, "run long, a array<double>, b array<double>")
    key = lambda r: (r.run is None, r.run or 0, r.pos)
    want = sorted(explode_series(df, {"a": "a", "b": "b"}, keep=["run"]).collect(), key=key)
    for length in (1, 7, 1000):
        got = explode_series(df, {"a": "a", "b": "b"}, keep=["run"], slice_length=length)
        assert got.columns == ["run", "pos", "a", "b"] and sorted(got.collect(), key=key) == want
    with pytest.raises(ValueError):
        explode_series(df, {"a": "a"}, slice_length=0)


def test_one_long_series_spreads_over_tasks(spark):
    n = 1_000_000
    one = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: x.cast("double")).alias("a"))
    got = explode_series(one, {"a": "a"}, slice_length=10_000).withColumn("p", F.spark_partition_id())
    per = got.groupBy("p").agg(F.count("*").alias("n"), F.sum("a").alias("s")).collect()
    assert sum(r.n for r in per) == n and sum(r.s for r in per) == n * (n - 1) / 2
    assert len(per) >= 4 and max(r.n for r in per) < n / 2


def test_report_lists_in_chunks(spark, tmp_out):
    df = spark.range(95).select(F.col("id").alias("k"), *[F.when(F.col("id") % 10 != j, F.col("id") * (j + 1.0)).alias(c) for j, c in enumerate("pio")]).repartition(4)
    chunks = report_series(df, ["k"], "p", "i", "o", chunk=20)
    rows = chunks.orderBy("chunk").collect()
    assert [(r.chunk, r.start, len(r.original_p_list)) for r in rows] == [(0, 0, 20), (1, 20, 20), (2, 40, 20), (3, 60, 20), (4, 80, 15)]
    for j, c in enumerate(("original_p_list", "improved_p_list", "o_list")):
        assert [v for r in rows for v in r[c]] == [None if i % 10 == j else i * (j + 1.0) for i in range(95)]
    write_report_series(chunks, os.path.join(tmp_out, "lists"))
    lines = [json.loads(r.value) for r in spark.read.text(os.path.join(tmp_out, "lists")).collect()]
    assert sorted(x["start"] for x in lines) == [0, 20, 40, 60, 80] and all(len(x["o_list"]) == len(x["improved_p_list"]) for x in lines)
    assert report_series_json(report_series(df.limit(0), ["k"], "p", "i", "o")).count() == 0


# ------------------------------------------------------------ fits

@pytest.mark.parametrize("reg", [0.0, 0.3, 5000.0])
def test_inference_equals_spark_ml(spark, reg):
    from residuum.operators.prepare import DELTA, add_delta
    cal = add_delta(calibration_orders(spark, SF001), CALIBRATION_SPEC).cache()
    names = CALIBRATION_SPEC.features
    vec = VectorAssembler(inputCols=list(names), outputCol="x").transform(cal)
    model = GeneralizedLinearRegression(featuresCol="x", labelCol=DELTA, regParam=reg, maxIter=25).fit(vec)
    s = model.summary
    rows = M.gaussian_inference(cal, DELTA, names, reg).collect()
    assert [r.feature for r in rows] == [*names, "(intercept)"]
    want = zip([*model.coefficients.toArray(), model.intercept], s.coefficientStandardErrors, s.tValues, s.pValues)
    for r, (b, e, t, p) in zip(rows, want):
        assert r.coefficient == pytest.approx(b, rel=1e-6) and r.standard_error == pytest.approx(e, rel=1e-6)
        assert r.t_value == pytest.approx(t, rel=1e-6) and r.p_value == pytest.approx(p, rel=1e-5, abs=1e-12)


def test_inference_edges(spark):
    flat = spark.createDataFrame([(float(i), 3.0, 2.0 * i + (i % 2)) for i in range(9)], "x double, c double, y double")
    rows = {r.feature: r for r in M.gaussian_inference(flat, "y", ("x", "c")).collect()}
    assert rows["c"].coefficient == 0.0 and rows["c"].standard_error is None and rows["x"].coefficient == pytest.approx(2.0)
    few = M.gaussian_inference(flat.limit(2), "y", ("x",)).collect()
    assert all(r.standard_error is None and r.p_value is None for r in few)
    with pytest.raises(ValueError):
        M.gaussian_inference(flat.limit(0), "y", ("x",))
    assert two_sided(0.0, 5) == pytest.approx(1.0) and two_sided(2.0, 10) == pytest.approx(0.07338803477074, rel=1e-10)
    assert two_sided(12.706204736, 1) == pytest.approx(0.05, rel=1e-8) and two_sided(float("inf"), 3) == 0.0


def test_moments_of_wide_and_narrow_frames(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 15)) + 1e5
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"f{i} double" for i in range(15)))
    for d in (4, 15):
        n, mean, cov = central_moments(df, [f"f{i}" for i in range(d)])
        assert n == 300 and np.allclose(mean, x[:, :d].mean(0), rtol=1e-12) and np.allclose(cov, np.cov(x[:, :d].T, bias=True), atol=1e-6)


# ------------------------------------------------------------ splits

def test_random_split_does_not_move(spark):
    base = spark.range(3000).withColumnRenamed("id", "k").repartition(6)
    train, holdout = holdout_split(base, "k", method="random", seed=5)
    first = {r.k for r in train.collect()}, {r.k for r in holdout.collect()}
    assert not first[0] & first[1] and len(first[0]) + len(first[1]) == 3000 and abs(len(first[0]) - 2100) < 150
    assert train.columns == ["k"]
    # computed again from other partitions, as after a lost executor
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = {r.k for r in train.repartition(2).collect()}, {r.k for r in holdout.repartition(5).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert again == first
    assert "rand(" not in train._jdf.queryExecution().optimizedPlan().toString()


def test_random_split_in_a_correction(spark):
    res = correct(calibration_orders(spark, SF001), CALIBRATION_SPEC, "decision_tree", split="random", seed=4)
    assert "rand(" not in res.series._jdf.queryExecution().optimizedPlan().toString()
    held = res._pinned.where(F.col(PLACE) >= 0.7).count()
    assert res.holdout.first().n_eval == held and abs(held - 0.3 * res._pinned.count()) < 100
    with pytest.raises(ValueError, match="must be stored"):
        with_random_place(spark.range(3), 1, "persist")
