"""Cleaning rules, the delta table, LIBSVM text encoding and file round trips."""

import os

from pyspark.ml.linalg import SparseVector, DenseVector
from pyspark.sql import functions as F

from residuum.operators.encode import assemble, libsvm_line, libsvm_line_from_vector, to_libsvm
from residuum.operators.prepare import add_delta, clean, correct_prediction, delta_table, pairs
from residuum.sinks import write_delta_table, write_libsvm, write_series_csv
from residuum.sources.readers import (explode_series, read_calibration, read_labelled_csv,
                                      read_libsvm, read_prediction_list)
from residuum.spec import CalibrationSpec


def test_positional_roles(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "row_id long, obs double, sim double, f double")
    spec = CalibrationSpec.from_positions(df)
    assert (spec.observed, spec.predicted, spec.features) == ("obs", "sim", ("f",))


def test_clean_rules(spark):
    df = spark.createDataFrame(
        [(1, 3.0, 1.0, None, 2), (2, float("nan"), 1.5, float("nan"), 0), (3, 1.0, None, 5.0, 7)],
        "row_id long, o double, p double, f1 double, f2 int")
    spec = CalibrationSpec("o", "p", ("f1", "f2"))
    rows = {r.row_id: r for r in add_delta(clean(df, spec), spec).collect()}
    assert rows[1].f1 == 0.0 and rows[1].delta_e == 2.0
    assert rows[2].o is None and rows[2].f1 == 0.0 and rows[2].delta_e is None
    assert rows[3].p is None and rows[3].delta_e is None and rows[3].f2 == 7.0
    assert dict(clean(df, spec).dtypes)["f2"] == "double"


def test_delta_table_layout_and_correction(spark):
    df = spark.createDataFrame([(1, 5.0, 3.0, 1.0)], "row_id long, o double, p double, f double")
    spec = CalibrationSpec("o", "p", ("f",))
    assert delta_table(df, spec).columns == ["row_id", "delta_e", "f"]
    assert delta_table(df, spec, keep_key=False).columns == ["delta_e", "f"]
    assert pairs(df, spec).columns == ["row_id", "p", "o"]
    out = correct_prediction(df.withColumn("e_hat", F.lit(2.0)), spec).first()
    assert out.improved == 5.0


def test_libsvm_line_rules(spark):
    df = spark.createDataFrame(
        [(0.0, 1, 0, 3), (-0.0, 0, 0, 0), (-1.5, None, 2, 0), (2.25, 4, 5, 6)],
        "label double, a int, b int, c int")
    lines = [r.line for r in df.select(libsvm_line("label", ["a", "b", "c"]).alias("line")).collect()]
    assert lines == ["0 1:1 3:3", "0", "-1.5 2:2", "2.25 1:4 2:5 3:6"]
    const = [r.value for r in to_libsvm(df, None, ["a", "b", "c"]).collect()]
    assert const[0] == "1 1:1 3:3" and const[1] == "1"


def test_libsvm_from_vector(spark):
    df = spark.createDataFrame([(1.0, SparseVector(4, {1: 2.5})), (0.0, DenseVector([0.0, 0, 0, 0]))],
                               ["label", "features"])
    got = [r.l for r in df.select(libsvm_line_from_vector("label", "features").alias("l")).collect()]
    assert got == ["1.0 2:2.5", "0"]


def test_libsvm_round_trip_keeps_width(spark, tmp_out):
    df = spark.createDataFrame([(1.5, 1.0, 0.0, 0.0), (-2.0, 0.0, 3.0, 0.0)],
                               "y double, a double, b double, c double")
    path = os.path.join(tmp_out, "svm")
    write_libsvm(df, path, "y", ["a", "b", "c"])
    back = read_libsvm(spark, path, num_features=3).orderBy("label").collect()
    assert [r.label for r in back] == [-2.0, 1.5]
    assert back[0].features.size == 3 and back[0].features.toArray().tolist() == [0.0, 3.0, 0.0]


def test_read_calibration_csv(spark, tmp_out):
    path = os.path.join(tmp_out, "cal.csv")
    with open(path, "w") as fh:
        fh.write("runoff,basin,t,t\n1.0,2.0,3,4\nNaN,1.0,,5\n")
    df, spec = read_calibration(spark, path)
    assert (spec.observed, spec.predicted) == ("runoff", "basin")
    assert spec.features == ("t2", "t3")     # duplicates resolved by position
    rows = add_delta(clean(df, spec), spec).orderBy("row_id").collect()
    assert rows[0].delta_e == -1.0 and rows[1].runoff is None and rows[1].t2 == 0.0


def test_read_labelled_csv(spark, tmp_out):
    path = os.path.join(tmp_out, "lab.csv")
    with open(path, "w") as fh:
        fh.write("1.0,2.0,3.0\n-1.0,0.5,0.0\n")
    df = read_labelled_csv(spark, path, 2)
    rows = df.orderBy("label").collect()
    assert rows[0].features.toArray().tolist() == [0.5, 0.0]


def test_explode_series_and_prediction_list(spark):
    df = spark.createDataFrame([(7, [0.0, 1.0, 2.0], [1.0, 1.0, 1.0], [2.0, 0.5, 3.0])],
                               "run long, time array<double>, sim array<double>, obs array<double>")
    rows = explode_series(df, {"time": "time", "predicted": "sim", "observed": "obs"},
                          keep=["run"]).orderBy("pos").collect()
    assert [(r.pos, r.time, r.predicted, r.observed) for r in rows] == \
        [(0, 0.0, 1.0, 2.0), (1, 1.0, 1.0, 0.5), (2, 2.0, 1.0, 3.0)]
    lines = spark.createDataFrame([(1, " 1.5, -2,3e4 ")], "k long, line string")
    got = [(r.pos, r.value) for r in read_prediction_list(lines, "line", keep=["k"]).collect()]
    assert got == [(0, 1.5), (1, -2.0), (2, 30000.0)]


def test_sinks_write(spark, tmp_out):
    df = spark.createDataFrame([(1, 5.0, 3.0, 1.0)], "row_id long, o double, p double, f double")
    spec = CalibrationSpec("o", "p", ("f",))
    path = os.path.join(tmp_out, "delta")
    write_delta_table(df, spec, path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["delta_e", "f"] and back.first().delta_e == "2.0"
    sp = os.path.join(tmp_out, "series")
    write_series_csv(df, sp, "row_id", "p", "o")
    assert spark.read.csv(sp).first()[3] == "2.0"


def test_assemble_full_width(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0)], "a double, z double")
    v = assemble(df, ["a", "z"]).first().features
    assert v.size == 2


def test_explode_series_missing_array(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], None), (2, None, None)],
                               "run long, sim array<double>, obs array<double>")
    rows = explode_series(df, {"predicted": "sim", "observed": "obs"}, keep=["run"]) \
        .orderBy("run", "pos").collect()
    assert [(r.run, r.pos, r.predicted, r.observed) for r in rows] == \
        [(1, 0, 1.0, None), (1, 1, 2.0, None)]
