"""Plan properties that the design relies on at scale (guards against
regressions: pruning, pushdown, no Python in the hot path, one aggregate)."""

import re

import pytest

from __spark_entry__ import queries
from residuum.sources.tables import calibration_orders

from conftest import SF001


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_view_prunes_and_pushes_down(spark):
    p = plan(calibration_orders(spark, SF001))
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", p))   # AQE may list a plan twice
    widths = sorted(len(s.split(",")) for s in schemas)
    assert widths == [3, 5], schemas          # orders: 3 columns, lineitem: 5
    assert "IsNotNull(l_orderkey)" in p and "IsNotNull(o_orderkey)" in p
    assert "PartialAggregate" in p or "partial_sum" in p


@pytest.mark.parametrize("name", ["calibration_view", "original_metrics", "glr_report",
                                  "correct_decision_tree", "chart_series", "libsvm_lines",
                                  "series_rows", "prediction_list", "alignment"])
def test_no_python_udf(spark, name):
    p = plan(queries()[name](spark, SF001))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_report_is_one_aggregate(spark):
    p = plan(queries()["correct_glr"](spark, SF001))
    assert p.count("Exchange") == 1 and "SinglePartition" in p
    assert p.count("HashAggregate") + p.count("ObjectHashAggregate") == 2   # partial + final


def test_dense_index_shuffles_once(spark):
    """One exchange of the data, by range, and no window and no join, also
    when nothing may be broadcast."""
    from residuum.operators.ordering import dense_index
    from residuum.sources.tables import read_table
    ev = read_table(spark, SF001, "events").select("event_id", "user_id", "ts")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        unpinned = plan(dense_index(ev, ["ts", "event_id"], ["user_id"], pin="none"))
        pinned = plan(dense_index(ev, ["ts", "event_id"], ["user_id"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert unpinned.count("Exchange rangepartitioning") >= 1 and "Exchange hashpartitioning" not in unpinned
    assert "Exchange" not in pinned
    for p in (unpinned, pinned):
        assert "Window" not in p and "Join" not in p


def test_comparison_scans_once(spark):
    p = plan(queries()["technique_comparison"](spark, SF001))
    assert p.count("FileScan") == 1 and p.count("Exchange") == 1
