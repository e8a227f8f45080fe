"""Hash split, dense index, previews, lookup and key alignment."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from residuum.operators.alignment import alignment_counts, assert_aligned, attach
from residuum.operators.ordering import dense_index, lookup, preview
from residuum.operators.split import holdout_split, train_flag
from residuum.sources.tables import calibration_orders, read_table

from conftest import SF001, SF01


def test_hash_split_is_stable(spark):
    cal = calibration_orders(spark, SF01).select("row_id")
    a = cal.where(train_flag("row_id")).count()
    b = cal.repartition(5).where(train_flag("row_id")).count()
    assert a == b == 10275          # 70 % of 14,743 by hash
    train, hold = holdout_split(cal, "row_id")
    assert train.count() + hold.count() == cal.count()
    assert train.join(hold, "row_id").count() == 0


def test_random_split_seeded(spark):
    cal = calibration_orders(spark, SF001).select("row_id")
    t1, _ = holdout_split(cal, "row_id", method="random", seed=7)
    t2, _ = holdout_split(cal, "row_id", method="random", seed=7)
    assert t1.count() == t2.count()
    with pytest.raises(ValueError):
        holdout_split(cal, "row_id", method="nope")


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_dense_index_matches_row_number(spark, parts):
    ev = read_table(spark, SF001, "events").select("event_id", "user_id", "ts")
    got = dense_index(ev, ["ts", "event_id"], ["user_id"], num_partitions=parts)
    ref = ev.withColumn("rn", F.row_number().over(
        Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    j = got.join(ref, "event_id")
    assert j.count() == ev.count()
    assert j.where(F.col("idx") != F.col("rn")).count() == 0


def test_dense_index_global_with_one_hot_series(spark):
    # one series holding every row is spread over all range partitions
    ev = read_table(spark, SF001, "events").select("event_id").withColumn("s", F.lit(1))
    got = dense_index(ev, ["event_id"], ["s"], num_partitions=4)
    ref = ev.withColumn("rn", F.row_number().over(Window.orderBy("event_id")) - 1)
    assert got.join(ref, "event_id").where(F.col("idx") != F.col("rn")).count() == 0


def test_preview_and_lookup(spark):
    cal = calibration_orders(spark, SF001)
    top = preview(cal, ["row_id"], 5).collect()
    ids = [r.row_id for r in top]
    assert ids == sorted(ids) and len(ids) == 5
    assert ids[0] == cal.agg(F.min("row_id")).first()[0]
    js = lookup(cal, F.col("n_lines") == 3, ["row_id", "n_lines"], ["row_id"]).first().json
    assert '"n_lines":3' in js


def test_alignment(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    b = spark.createDataFrame([(2,), (3,), (3,), (4,)], "k long")
    c = alignment_counts(a, b, "k").first().asDict()
    assert c == {"n_left": 3, "n_right": 4, "n_matched_keys": 2, "n_left_only": 1,
                 "n_right_only": 1, "n_duplicate_keys": 1}
    with pytest.raises(ValueError):
        assert_aligned(a, b, "k")
    ok = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "k long, v double")
    assert attach(a, ok, "k").count() == 3


def test_hot_key_alignment_and_index(spark):
    # one key holds a third of all rows on the right side
    n = 3000
    left = spark.range(n).withColumnRenamed("id", "k")
    right = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id"))
                                  .alias("k"))
    c = alignment_counts(left, right, "k").first()
    assert c["n_right"] == n and c["n_duplicate_keys"] == 1
    assert c["n_left_only"] == n // 3       # every multiple of 3 is missing on the right
    # a series holding a third of all rows is numbered across partitions
    rows = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, F.lit(0))
                                 .otherwise(F.col("id") % 17 + 1).alias("s"))
    got = dense_index(rows, ["id"], ["s"], num_partitions=6)
    ref = rows.withColumn("rn", F.row_number().over(Window.partitionBy("s").orderBy("id")) - 1)
    assert got.join(ref, "id").where(F.col("idx") != F.col("rn")).count() == 0


def test_dense_index_keeps_null_series(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, 5), (4, 5), (5, None)],
                                 "id long, s long")
    got = {r.id: r.idx for r in dense_index(rows, ["id"], ["s"], num_partitions=2).collect()}
    assert got == {1: 0, 2: 1, 5: 2, 3: 0, 4: 1}


def test_attach_by_position(spark):
    from residuum.operators.alignment import attach_by_position
    from residuum.sources.readers import read_prediction_list
    rows = spark.createDataFrame([(30, 1.0), (10, 2.0), (20, 3.0)], "k long, obs double")
    lines = spark.createDataFrame([("0.5,1.5,2.5",)], "line string")
    preds = read_prediction_list(lines, "line")            # pos 0..2 in key order
    got = {r.k: r.value for r in attach_by_position(rows, ["k"], preds).collect()}
    assert got == {10: 0.5, 20: 1.5, 30: 2.5}
    short = read_prediction_list(spark.createDataFrame([("0.5,1.5",)], "line string"), "line")
    with pytest.raises(ValueError):
        attach_by_position(rows, ["k"], short)


def test_index_sends_one_number_a_row_to_python(spark):
    wide = spark.range(2000).select("id", (F.col("id") % 5).alias("s"), *[F.lit("x" * 20).alias(f"c{i}") for i in range(30)])
    import residuum.operators.ordering as ordering
    plans = []
    keep = ordering.materialize
    ordering.materialize = lambda df, how: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, how)
    try:
        got = dense_index(wide, ["id"], ["s"], num_partitions=4)
    finally:
        ordering.materialize = keep
    assert got.where(F.col("idx") != F.floor(F.col("id") / 5)).count() == 0
    python = [line for line in plans[0].splitlines() if "Python" in line or "Arrow" in line]
    assert len(python) == 1 and "_count_series(_series" in python[0].replace("#", "_series#", 0) and "mapInArrow" not in plans[0]
    # the plan does not grow with the number of partitions: their offsets are one constant
    text = [dense_index(wide, ["id"], ["s"], num_partitions=n)._jdf.queryExecution().optimizedPlan().toString() for n in (2, 60)]
    assert len({re.sub(r"\[[0-9, ]*\]|#\d+L?|residuum-\w+", "", t).count("(") for t in text}) == 1


def test_offsets_of_many_partitions(spark):
    from residuum.operators import ordering
    from residuum.operators.ordering import begins
    # 20,000 partitions of 7 rows; series 0 fills the first 9,999 and part of the next one, the others are spread over 3 each
    n = 20_000
    first = lambda p: 0 if p < 10_000 else (p - 10_000) // 3 + 1
    last = lambda p: 0 if p < 9_999 else (p + 1 - 10_000) // 3 + 1
    rows = [(p, first(p), last(p), 7 if first(p) == last(p) else 3) for p in range(n)]
    got = {r._part: r._begin for r in begins(spark.createDataFrame(rows, "_part int, first long, last long, n long")).collect()}
    want, running, current = {}, 0, None
    for p, f, e, k in rows:
        if f == current and running:
            want[p] = running
        running = (running if f == e == current else 0) + k
        current = e
    assert got == want
    frame = spark.range(3 * n).select((F.col("id") % n).cast("int").alias("_part"))
    table = spark.createDataFrame(list(want.items()), "_part int, _begin long")
    looked = frame.select("_part", ordering._starting(table).alias("b"))
    assert looked.agg(F.sum("b")).first()[0] == 3 * sum(want.values())
    assert looked._jdf.queryExecution().optimizedPlan().toString().count("(") < 40
