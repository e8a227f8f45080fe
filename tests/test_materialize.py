"""Every pinning mode gives the same frame; the correction and the dense
index work with each of them (the persist path is what a session without a
shared checkpoint folder uses)."""

import math

import pytest
from pyspark.sql import functions as F

from residuum import correct
from residuum.operators.materialize import materialize
from residuum.operators.ordering import dense_index
from residuum.sources.tables import CALIBRATION_SPEC, calibration_orders

from conftest import SF001


@pytest.mark.parametrize("how", ["checkpoint", "table", "persist", "none"])
def test_modes_same_rows(spark, how):
    cal = calibration_orders(spark, SF001)
    pinned = materialize(cal, how)
    assert pinned.count() == cal.count()
    assert pinned.exceptAll(cal).count() == 0


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        materialize(calibration_orders(spark, SF001), "somewhere")


@pytest.mark.parametrize("how", ["persist", "table"])
def test_correction_and_index_without_checkpoint(spark, how):
    cal = calibration_orders(spark, SF001)
    ref = {r["series"]: r["rmse"] for r in correct(cal, CALIBRATION_SPEC, "glr").metrics.collect()}
    res = correct(cal, CALIBRATION_SPEC, "glr", materialise=how)
    got = {r["series"]: r["rmse"] for r in res.metrics.collect()}
    for s in ref:
        assert math.isclose(got[s], ref[s], rel_tol=1e-9)
    res.release()
    idx = dense_index(cal.select("row_id"), ["row_id"], pin=how)
    assert idx.agg(F.min("idx"), F.max("idx"), F.countDistinct("idx")).first() == \
        (0, cal.count() - 1, cal.count())
