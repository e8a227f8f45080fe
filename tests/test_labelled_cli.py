"""The model step on a labelled vector file, and the command line."""

import json
import os

import pytest

from residuum.__main__ import main
from residuum.operators.prepare import add_delta
from residuum.plans.labelled import fit_labelled
from residuum.sinks import write_libsvm
from residuum.sources.readers import read_libsvm
from residuum.sources.tables import CALIBRATION_FEATURES, CALIBRATION_SPEC, calibration_orders

from conftest import SF001


@pytest.fixture(scope="module")
def libsvm_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("svm") / "delta.libsvm")
    cal = add_delta(calibration_orders(spark, SF001), CALIBRATION_SPEC)
    write_libsvm(cal, path, "delta_e", CALIBRATION_FEATURES)
    return path


@pytest.mark.parametrize("tech", ["decision_tree", "glr", "sgd"])
def test_fit_labelled(spark, libsvm_path, tech):
    df = read_libsvm(spark, libsvm_path, num_features=len(CALIBRATION_FEATURES))
    res = fit_labelled(df, tech)
    acc = res.accuracy.first()
    n = df.count()
    assert res.predictions.count() == n
    assert res.predictions.select("row_id").distinct().count() == n
    if tech == "glr" or tech == "sgd":
        assert acc["n_eval"] == n and acc["eval_scope"] == "train"
    else:
        assert 0.2 * n < acc["n_eval"] < 0.4 * n
    assert acc["rmse"] > 0


def test_cli_fit_and_correct(spark, libsvm_path, tmp_out):
    out = os.path.join(tmp_out, "fit")
    assert main(["fit", "decision_tree", libsvm_path, out, "--num-features", "5"]) == 0
    line = spark.read.text(os.path.join(out, "accuracy")).first().value
    assert line.startswith("Root Mean Squared Error (RMSE) on test data = ")
    assert spark.read.parquet(os.path.join(out, "predictions")).count() > 0

    csv = os.path.join(tmp_out, "cal.csv")
    cal = calibration_orders(spark, SF001).select("observed", "predicted", *CALIBRATION_FEATURES)
    cal.coalesce(1).write.option("header", True).csv(csv)
    out2 = os.path.join(tmp_out, "corr")
    assert main(["correct", "glr", csv, out2]) == 0
    doc = json.loads(spark.read.text(os.path.join(out2, "report_json")).first().value)
    assert doc["improved_rmse"] < doc["original_rmse"]
    lists = [json.loads(r.value) for r in spark.read.text(os.path.join(out2, "report_series")).collect()]
    assert sum(len(x["improved_p_list"]) for x in lists) == cal.count() == sum(len(x["o_list"]) for x in lists)

    swapped = os.path.join(tmp_out, "swapped.csv")
    cal.select("predicted", "observed", *CALIBRATION_FEATURES).coalesce(1).write.option("header", True).csv(swapped)
    out3 = os.path.join(tmp_out, "named")
    assert main(["correct", "glr", swapped, out3, "--observed", "observed", "--predicted", "predicted"]) == 0
    assert json.loads(spark.read.text(os.path.join(out3, "report_json")).first().value)["original_rmse"] == pytest.approx(doc["original_rmse"])
