"""Calibration frames derived from the driver's parquet tables.

No driver table carries observed/predicted columns, so the verification view
treats an order's stated total as the observation and the total rebuilt from
its line items as the model's prediction; date parts and line statistics are
the features (the same kind of inputs as the shipped daily series: year,
month, day and a few measures).

Money arithmetic is exact: prices, discounts and taxes are two-decimal values,
so the rebuilt total is summed as an integer count of 1e-6 units (a plain
``bigint`` aggregate that stays in generated code) and turned into a double
once per order.  The result is bit-identical to the decimal formulation used
by the SQL oracle, independent of summation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import CalibrationSpec

# Fixed scale of the integer money arithmetic: 2 decimals for the price and
# 2 for each of the two rates give 6 decimals in the product.
MICROS = 1_000_000

CALIBRATION_FEATURES = ("yr", "mon", "dom", "n_lines", "qty")
CALIBRATION_SPEC = CalibrationSpec(observed="observed", predicted="predicted",
                                   features=CALIBRATION_FEATURES, key="row_id")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hundredths(c: Column) -> Column:
    """A two-decimal double as an exact integer number of hundredths."""
    return F.round(c * F.lit(100)).cast("long")


def line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: the total rebuilt from its line items (exact, in 1e-6
    units), the number of lines and the quantity.  Partial aggregation runs
    map-side, so a hot order key never ships more than one row per task."""
    li = read_table(spark, sf_dir, "lineitem")
    micros = (_hundredths(F.col("l_extendedprice"))
              * (F.lit(100) - _hundredths(F.col("l_discount")))
              * (F.lit(100) + _hundredths(F.col("l_tax"))))
    return li.groupBy("l_orderkey").agg(
        F.sum(micros).alias("p_micros"),
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.round(F.col("l_quantity")).cast("long")).alias("qty_units"),
    )


def calibration_from(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """The calibration rows of ``orders`` (a batch or a streaming frame) joined
    to the per-order line totals."""
    return (
        orders.join(lines, orders.o_orderkey == lines.l_orderkey)
        .select(
            F.col("o_orderkey").alias("row_id"),
            F.col("o_totalprice").alias("observed"),
            (F.col("p_micros").cast("double") / F.lit(float(MICROS))).alias("predicted"),
            F.year("o_orderdate").cast("int").alias("yr"),
            F.month("o_orderdate").cast("int").alias("mon"),
            F.dayofmonth("o_orderdate").cast("int").alias("dom"),
            F.col("n_lines").cast("long").alias("n_lines"),
            F.col("qty_units").cast("double").alias("qty"),
        )
    )


def calibration_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, observed, predicted, yr, mon, dom, n_lines, qty``: one row per
    order that has line items.

    Plan: line items are pre-aggregated per order, the aggregate's hash
    partitioning on the order key is reused by the join, and only ``orders``
    is shuffled to meet it.  Scans read 5 and 3 columns.
    """
    return calibration_from(read_table(spark, sf_dir, "orders"), line_totals(spark, sf_dir))


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A driver table read as a stream (the folder is watched; only this
    table's files are picked up)."""
    schema = read_table(spark, sf_dir, name).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(sf_dir.rstrip("/"))


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, hour, day, minute, cents`` from ``events``: small integers,
    zero on many rows (hour 0, minute 0), plus the value in hundredths - the
    shape the sparse labelled-vector encoder is exercised on."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        F.hour("ts").cast("int").alias("hour"),
        F.dayofmonth("ts").cast("int").alias("day"),
        F.minute("ts").cast("int").alias("minute"),
        _hundredths(F.col("value")).alias("cents"),
    )
