"""Result writers and the technique comparison plan."""

import json
import os

from residuum import compare_techniques, correct
from residuum.sinks import accuracy_text, report_json, write_predictions, write_report
from residuum.sources.tables import CALIBRATION_SPEC, calibration_orders

from conftest import SF001


def test_accuracy_text():
    assert accuracy_text(3.94183) == "Root Mean Squared Error (RMSE) on test data = 3.94183"
    assert accuracy_text(157141.91606) == "Root Mean Squared Error (RMSE) on test data = 157142"
    assert accuracy_text(1.5e-7).endswith("= 1.5e-07")


def test_predictions_and_report(spark, tmp_out):
    res = correct(calibration_orders(spark, SF001), CALIBRATION_SPEC, "glr")
    p = os.path.join(tmp_out, "pred")
    write_predictions(res.series, p, "row_id")
    back = spark.read.parquet(p)
    assert back.columns == ["row_id", "e_hat"] and back.count() == res.series.count()
    doc = json.loads(report_json(res.report).first().report)
    metrics = {r["series"]: r for r in res.metrics.collect()}
    assert abs(doc["improved_rmse"] - metrics["improved"]["rmse"]) < 1e-9
    assert len([k for k in doc if k not in ("holdout_rmse", "accuracy_info")]) == 12 and "holdout_rmse" in doc
    assert doc["accuracy_info"] == accuracy_text(doc["holdout_rmse"]) + "\n"
    rp = os.path.join(tmp_out, "report")
    write_report(res.report, rp)
    assert json.loads(spark.read.text(rp).first().value)["original_nse"] == doc["original_nse"]


def test_compare_techniques(spark):
    cal = calibration_orders(spark, SF001)
    rep = compare_techniques(cal, CALIBRATION_SPEC, ("glr", "decision_tree", "sgd"),
                             parallelism=2).collect()
    assert len(rep) == 9
    assert {r["technique"] for r in rep} == {"glr", "decision_tree", "sgd"}
    orig = {r["rmse"] for r in rep if r["series"] == "original"}
    assert len(orig) == 1            # the same input for every technique
