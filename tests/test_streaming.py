"""Scoring a stream with a fitted error model; running and windowed reports."""

import math
import os

import pytest
from pyspark.sql import functions as F

from residuum import correct
from residuum.operators.materialize import release
from residuum.sources.tables import CALIBRATION_SPEC, calibration_orders, read_table
from residuum.spec import CalibrationSpec
from residuum.streaming import correct_stream, run_to_store, running_report, windowed_report

from conftest import SF001

SPEC = CALIBRATION_SPEC


def test_stream_report_equals_batch(spark, tmp_out):
    cal = calibration_orders(spark, SF001)
    res = correct(cal, SPEC, "glr")
    src = os.path.join(tmp_out, "in")
    cal.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(cal.schema).option("maxFilesPerTrigger", 1).parquet(src)
    scored = correct_stream(stream, SPEC, res.model)
    q = (running_report(scored, SPEC).writeStream.outputMode("complete")
         .format("memory").queryName("running_report").start())
    q.processAllAvailable()
    q.stop()
    got = {r["series"]: r for r in spark.table("running_report").collect()}
    exp = {r["series"]: r for r in res.metrics.collect()}
    for s in exp:
        assert math.isclose(got[s]["rmse"], exp[s]["rmse"], rel_tol=1e-9)
        assert math.isclose(got[s]["nse"], exp[s]["nse"], rel_tol=1e-9, abs_tol=1e-12)


def test_windowed_report(spark, tmp_out):
    cal = calibration_orders(spark, SF001)
    res = correct(cal, SPEC, "glr")
    orders = read_table(spark, SF001, "orders").select(F.col("o_orderkey").alias("row_id"),
                                                       F.col("o_orderdate").alias("ts"))
    timed = cal.join(orders, "row_id")
    src = os.path.join(tmp_out, "timed")
    timed.write.parquet(src)
    stream = spark.readStream.schema(timed.schema).parquet(src)
    scored = correct_stream(stream, SPEC, res.model, keep=["ts"])
    rep = windowed_report(scored, SPEC, "ts", "3650 days", "1 day")
    q = rep.writeStream.outputMode("append").format("memory").queryName("win_report").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("win_report").collect()
    # windows whose end the watermark has passed are emitted, three series each
    assert len(rows) % 3 == 0
    assert {r["series"] for r in rows} <= {"original", "improved", "delta_error"}


def test_windowed_report_drops_rows_behind_watermark(spark, tmp_out):
    """Two micro-batches: the second carries one on-time row and one row
    older than the watermark; only the on-time one may count."""
    from residuum.spec import CalibrationSpec
    spec = CalibrationSpec("obs", "sim", ("f",))
    train = spark.createDataFrame([(i, float(i), float(i) - 1.0, float(i)) for i in range(20)],
                                  "row_id long, obs double, sim double, f double")
    res = correct(train, spec, "glr")
    schema = "row_id long, obs double, sim double, f double, ts timestamp"
    src = os.path.join(tmp_out, "late")
    day = "2024-01-0{}T00:00:00"
    first = [(1, 1.0, 0.5, 1.0, day.format(1)), (2, 2.0, 1.0, 2.0, day.format(1)),
             (3, 3.0, 2.5, 3.0, day.format(5))]
    second = [(4, 4.0, 3.0, 4.0, day.format(5)), (5, 9.0, 0.0, 9.0, day.format(1))]
    def write(rows, name):
        spark.createDataFrame(rows, "row_id long, obs double, sim double, f double, ts string") \
            .withColumn("ts", F.to_timestamp("ts")).coalesce(1) \
            .write.parquet(os.path.join(src, name))          # one file = one micro-batch
    write(first, "b1")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1) \
        .parquet(os.path.join(src, "*"))
    scored = correct_stream(stream, spec, res.model, keep=["ts"])
    rep = windowed_report(scored, spec, "ts", "1 day", "1 hour")
    q = rep.writeStream.outputMode("append").format("memory").queryName("late_report").start()
    q.processAllAvailable()
    write(second, "b2")
    q.processAllAvailable()
    q.stop()
    rows = spark.table("late_report").collect()
    jan1 = [r for r in rows if r["window"].start.day == 1]
    # the Jan-1 window was emitted after batch 1 (watermark passed it) with 2 rows;
    # the late Jan-1 row of batch 2 did not reopen it
    assert len(jan1) == 3
    orig = [r for r in jan1 if r["series"] == "original"][0]
    assert math.isclose(orig["rmse"], math.sqrt(((0.5 - 1.0) ** 2 + (1.0 - 2.0) ** 2) / 2))


def test_stream_takes_any_names(spark, tmp_out):
    rows = [(i, float(i % 7) + 1.5, float(i % 7), float(i % 5), float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, ["row_id", "o.cfs", "p", "prediction", "delta_e"])
    spec = CalibrationSpec("o.cfs", "p", ("prediction", "delta_e"))
    res = correct(df, spec, "glr", keep=["p"])
    src = os.path.join(tmp_out, "odd")
    df.write.parquet(src)
    scored = correct_stream(spark.readStream.schema(df.schema).parquet(src), spec, res.model, keep=["p", "p"])
    assert scored.columns == ["row_id", "o_cfs", "p", "delta_e", "e_hat", "improved"]
    got = {r.row_id: r.improved for r in run_to_store(scored, "append").collect()}
    assert got == {r.row_id: r.improved for r in res.series.collect()} and len(got) == 60


def test_named_store_goes_on(spark, tmp_out):
    src = os.path.join(tmp_out, "files")
    os.makedirs(src)
    schema = "k long, v double"

    def put(name, first):
        spark.range(first, first + 10).selectExpr("id AS k", "id * 0.5D AS v").coalesce(1).write.parquet(os.path.join(tmp_out, name))
        part = next(f for f in os.listdir(os.path.join(tmp_out, name)) if f.endswith(".parquet"))
        return os.path.join(tmp_out, name, part)

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)

    store = "named-" + os.path.basename(tmp_out)
    os.link(put("a", 0), os.path.join(src, "1.parquet"))
    assert run_to_store(stream(), "append", store).count() == 10
    with open(os.path.join(src, "2.parquet"), "w") as fh:
        fh.write("no parquet")                      # the run breaks off in this batch
    with pytest.raises(Exception):
        run_to_store(stream(), "append", store)
    os.remove(os.path.join(src, "2.parquet"))
    os.link(put("b", 10), os.path.join(src, "2.parquet"))
    os.link(put("c", 20), os.path.join(src, "3.parquet"))
    got = run_to_store(stream(), "append", store)
    assert sorted(r.k for r in got.collect()) == list(range(30))
    assert run_to_store(stream(), "append", store).count() == 30      # nothing new
    total = run_to_store(stream().groupBy().agg(F.sum("k").alias("s")), "complete", store + "-sum")
    assert total.first().s == sum(range(30))
    release(got)
    release(total)
