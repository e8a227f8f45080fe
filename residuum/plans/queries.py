"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory, each over the whole driver tables.

Outputs that are sums of doubles are rounded (see ``rounding.py``) so the
SQL oracle can check them value by value; exact results (keys, counts,
integer text, bit-identical row values) are left as they are.
"""

from __future__ import annotations

from typing import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import METRICS, metric_columns, mse
from ..operators import models as M
from ..operators.alignment import alignment_counts, attach_by_position
from ..operators.encode import assemble, libsvm_line
from ..operators.indexing import categorical_decision, fit_indexer
from ..operators.materialize import materialize, new_store, owns
from ..operators.ordering import dense_index, lookup, preview
from ..operators.prepare import DELTA, E_HAT, IMPROVED, add_delta, clean, delta_table, pairs
from ..operators.split import hash_bucket, holdout_split, train_flag
from ..sources.readers import (explode_series, read_calibration, read_labelled_csv, read_libsvm,
                               read_prediction_file, read_prediction_list)
from ..sources.tables import (CALIBRATION_SPEC, calibration_from, calibration_orders,
                              event_features, line_totals, read_table, stream_table)
from ..sinks import (accuracy_line, report_json, report_series, report_series_json, write_delta_table, write_libsvm,
                     write_prediction_list, write_predictions, write_series_csv)
from .correct import compare_techniques, correct, three_way_report
from .rounding import DIGITS, rnd

Query = Callable[[SparkSession, str], DataFrame]

SPEC = CALIBRATION_SPEC
GLR_FEATURES = ("qty", "n_lines")        # the two-feature GLR with a closed-form oracle
STUMP_FEATURE = "n_lines"                # the depth-1 tree with an SQL oracle
SGD_FEATURE = "qty"                      # the one-feature gradient descent
LOOKUP_LINES = 4                         # F1: first row whose n_lines equals this


def _rounded_report(df: DataFrame) -> DataFrame:
    return df.select("series", *[rnd(m, DIGITS[m]).alias(m) for m in METRICS])


# ------------------------------------------------------------ sources, projections

def q_calibration_view(spark, sf):
    """The calibration table (observed, predicted, features by position)."""
    return calibration_orders(spark, sf)


def q_delta_table(spark, sf):
    """delta_e = observed - predicted first, observed/predicted dropped."""
    return delta_table(add_delta(calibration_orders(spark, sf), SPEC), SPEC)


def q_pairs(spark, sf):
    """(predicted, observed) pairs, keyed."""
    return pairs(calibration_orders(spark, sf), SPEC)


def q_original_metrics(spark, sf):
    """Goodness of fit of the original prediction, one aggregate."""
    cal = calibration_orders(spark, sf)
    return cal.agg(
        *[rnd(c, DIGITS[m]).alias(m) for c, m in
          zip(metric_columns("predicted", "observed"), METRICS)],
        F.count(F.lit(1)).alias("n_rows"),
        rnd(F.avg("observed"), 4).alias("mean_observed"),
        rnd(F.avg("predicted"), 4).alias("mean_predicted"),
        rnd(F.sum("observed"), 0).alias("sum_observed"),
    )


# ------------------------------------------------------------ GLR (closed-form oracle)

def _glr_two_features(spark, sf):
    spec = SPEC.with_features(*GLR_FEATURES)
    return correct(calibration_orders(spark, sf), spec, "glr")


def q_glr_report(spark, sf):
    """M4 + P5 + M7 + A7: GLR on (qty, n_lines) fitted on all rows, e_hat added
    back, 12 metrics for original / improved / delta_error."""
    return _rounded_report(_glr_two_features(spark, sf).metrics)


def q_stream_glr_report(spark, sf):
    """Streaming: orders arrive as a stream, are joined to the (pinned) static
    line totals, scored with the two-feature GLR fitted in batch, and the
    three-way report is kept as streaming state; equals ``glr_report``."""
    from ..streaming import correct_stream, run_to_store, running_report
    spec = SPEC.with_features(*GLR_FEATURES)
    lines = materialize(line_totals(spark, sf))     # aggregated once, for the fit and the stream
    cal = calibration_from(read_table(spark, sf, "orders"), lines)
    fitted = correct(cal, spec, "glr").model
    stream = calibration_from(stream_table(spark, sf, "orders"), lines)
    report = running_report(correct_stream(stream, spec, fitted), spec)
    return _rounded_report(run_to_store(report))


def q_glr_report_by_year(spark, sf):
    """A7 per group: the three-way report of the two-feature GLR correction
    for every order year, still one aggregate (grouped by year)."""
    spec = SPEC.with_features(*GLR_FEATURES)
    res = correct(calibration_orders(spark, sf), spec, "glr", keep=["yr"])
    rep = three_way_report(res.series, spec, "yr")
    return rep.select("yr", "series", *[rnd(m, DIGITS[m]).alias(m) for m in METRICS])


def q_glr_fit_statistics(spark, sf):
    """M10 (scalars): deviance, null deviance, residual degrees of freedom,
    dispersion and AIC of the two-feature GLR fit."""
    scored = _glr_two_features(spark, sf).series
    summ = M.gaussian_statistics(scored, DELTA, len(GLR_FEATURES), E_HAT)
    return summ.select(
        rnd("dispersion", 0).alias("dispersion"),
        rnd("null_deviance", -4).alias("null_deviance"),
        rnd("deviance", -4).alias("deviance"),
        "residual_dof_null", "residual_dof",
        rnd("aic", 6).alias("aic"))


def q_glr_coefficients(spark, sf):
    """M8: coefficients and intercept of the two-feature GLR."""
    res = _glr_two_features(spark, sf)
    return M.coefficients(spark, res.model).select("feature", rnd("coefficient", 6).alias("coefficient"))


def q_glr_residuals(spark, sf):
    """M9 + L1: the residual listing (first 20 rows in key order)."""
    res = _glr_two_features(spark, sf)
    top = preview(M.residuals(res.series, DELTA, E_HAT), [SPEC.key], 20)
    return top.select(SPEC.key, rnd(DELTA, 2).alias("label"), rnd(E_HAT, 2).alias("prediction"),
                      rnd("residual", 2).alias("residual"))


# ------------------------------------------------------------ split, indexing

def q_hash_split(spark, sf):
    """Deterministic 70/30 split by a hash of the key."""
    cal = calibration_orders(spark, sf)
    return cal.select(SPEC.key, hash_bucket(SPEC.key).cast("int").alias("bucket"),
                      train_flag(SPEC.key, 0.7).alias("is_train"))


LINE_FEATURES = ("l_discount", "l_tax", "returnflag_code", "linestatus_code", "l_quantity")


def q_categorical_features(spark, sf):
    """Which line-item features the indexer treats as categorical
    (<= 4 distinct values, zero included)."""
    li = read_table(spark, sf, "lineitem").select(
        "l_discount", "l_tax",
        F.ascii("l_returnflag").cast("double").alias("returnflag_code"),
        F.ascii("l_linestatus").cast("double").alias("linestatus_code"),
        "l_quantity")
    vec = assemble(li.na.fill(0.0, list(LINE_FEATURES)), LINE_FEATURES)
    model = fit_indexer(vec, "features")
    return categorical_decision(spark, model, LINE_FEATURES)


# ------------------------------------------------------------ depth-1 tree (SQL oracle)

def _stump(spark, sf):
    """Depth-1 tree of delta_e on n_lines: trained on the hash-train rows
    (indexer fitted on all rows), scored on every row."""
    spec = SPEC.with_features(STUMP_FEATURE)
    frame = add_delta(calibration_orders(spark, sf), spec)
    return correct(frame, spec, "decision_tree", prepared=True, maxDepth=1)


def q_stump_split(spark, sf):
    """M1 (depth 1) + A5: split threshold, leaf means, train counts and the
    holdout RMSE of the error model, in one aggregate over the scored rows."""
    res = _stump(spark, sf)
    root = M.root_split(res.model)
    threshold, left, right = root["threshold"], root["left"], root["right"]
    is_train = train_flag(SPEC.key)
    err = F.col(E_HAT) - F.col(DELTA)
    return res.series.agg(
        F.lit(STUMP_FEATURE).alias("feature"),
        F.lit(threshold).alias("threshold"),
        rnd(F.lit(left), 4).alias("left_mean"),
        rnd(F.lit(right), 4).alias("right_mean"),
        F.count(F.when(is_train & (F.col(STUMP_FEATURE) <= threshold), 1)).alias("n_left"),
        F.count(F.when(is_train & (F.col(STUMP_FEATURE) > threshold), 1)).alias("n_right"),
        rnd(F.sqrt(F.avg(F.when(~is_train, err * err))), 4).alias("holdout_rmse"),
    )


def q_stump_report(spark, sf):
    """M1 + P5 + A7: the three-way report after the depth-1 tree correction."""
    return _rounded_report(_stump(spark, sf).metrics)


def q_preview(spark, sf):
    """L1: first 20 scored rows in key order (prediction, label, feature)."""
    res = _stump(spark, sf)
    return preview(res.series, [SPEC.key], 20).select(
        SPEC.key, rnd(E_HAT, 4).alias("prediction"), F.col(DELTA).alias("label"),
        rnd(IMPROVED, 4).alias("improved"))


def q_first_row(spark, sf):
    """L2: the first row of the calibration table in key order."""
    return preview(calibration_orders(spark, sf), [SPEC.key], 1)


def q_label_lookup(spark, sf):
    """first row (key order) with n_lines = 4; its key and prediction as JSON."""
    scored = _stump(spark, sf).series.withColumn("prediction", rnd(E_HAT, 2))
    return lookup(scored, F.col(STUMP_FEATURE) == LOOKUP_LINES, [SPEC.key, "prediction"],
                  [SPEC.key], as_json="json")


def q_chart_series(spark, sf):
    """Chart rows (0-based index in key order, original, improved,
    observed) after the depth-1 tree correction."""
    res = _stump(spark, sf)
    idx = dense_index(res.series, [SPEC.key], out="idx")
    return idx.select(F.col("idx").cast("long").alias("idx"), SPEC.key,
                      F.col(SPEC.predicted).alias("original"), rnd(IMPROVED, 4).alias("improved"),
                      F.col(SPEC.observed).alias("observed"))


def q_event_index(spark, sf):
    """P11 per series: position of each event within its user's series."""
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "ts")
    idx = dense_index(ev, ["ts", "event_id"], ["user_id"], out="idx")
    return idx.select("event_id", "user_id", F.col("idx").cast("long").alias("idx"))


# ------------------------------------------------------------ gradient descent

def q_sgd_one_feature(spark, sf):
    """M6 + A6: full-batch least squares by gradient descent on qty
    (100 iterations, step 1e-8, no intercept) and its training MSE."""
    cal = materialize(add_delta(calibration_orders(spark, sf), SPEC))
    fitted = M.fit("sgd", cal, DELTA, (SGD_FEATURE,))
    model = fitted.learner
    scored = fitted.transform(cal)
    return scored.agg(
        rnd(F.lit(float(model.weights[0])), 12).alias("weight"),
        F.lit(int(model.iterations)).alias("iterations"),
        rnd(mse(M.PREDICTION, DELTA), DIGITS["mse"]).alias("training_mse"))


# ------------------------------------------------------------ encodings, series

def q_libsvm_lines(spark, sf):
    """Sparse labelled-vector text of each event (label = hour;
    zero labels written 0, zero items omitted) and the constant-label form."""
    ev = event_features(spark, sf)
    feats = ["day", "minute", "cents"]
    return ev.select("event_id",
                     libsvm_line(F.col("hour"), feats).alias("line"),
                     libsvm_line(F.lit(1), feats).alias("line_unlabelled"))


def _embedding_series(spark, sf, slice_length=None):
    emb = read_table(spark, sf, "embeddings")
    observed = F.transform("embedding", lambda x: x.cast("double"))
    predicted = F.transform("embedding", lambda x: x.cast("double") * F.lit(0.9))
    return explode_series(emb, {"predicted": predicted, "observed": observed},
                          keep=["vec_id"], pos="time", slice_length=slice_length)


def q_series_rows(spark, sf):
    """Parallel arrays (predicted, observed) to one row per position."""
    return _embedding_series(spark, sf)


def q_series_csv(spark, sf):
    """K6: time, predicted, observed, observed - predicted."""
    s = _embedding_series(spark, sf)
    return s.select("vec_id", "time", "predicted", "observed",
                    (F.col("observed") - F.col("predicted")).alias("delta"))


def q_prediction_list(spark, sf):
    """A stored comma-joined list read back to positioned numbers."""
    emb = read_table(spark, sf, "embeddings")
    micro = F.transform("embedding", lambda x: F.round(x.cast("double") * F.lit(1e6)).cast("long"))
    listed = emb.select("vec_id", F.array_join(micro, ",").alias("line"))
    return read_prediction_list(listed, "line", keep=["vec_id"])


def q_prediction_list_attached(spark, sf):
    """S5 + F2 + P11: each embedding's stored list read back and attached to
    its observation series by position (numbered per series in time order,
    completeness checked, then joined - never zipped)."""
    obs = _embedding_series(spark, sf).select("vec_id", "time", "observed")
    preds = q_prediction_list(spark, sf)
    return attach_by_position(obs, ["time"], preds, pos="pos", partition_by=["vec_id"])


def q_alignment(spark, sf):
    """key alignment of orders and line items (matched, one-sided, duplicated)."""
    orders = read_table(spark, sf, "orders").select("o_orderkey")
    li = read_table(spark, sf, "lineitem").select("l_orderkey")
    return alignment_counts(orders, li, "o_orderkey", "l_orderkey")


# ------------------------------------------------------------ files, written and read back

def _folder(spark) -> str:
    path = new_store(spark)
    if path is None:
        raise ValueError("the file queries need spark.checkpoint.dir")
    return path


def q_calibration_csv(spark, sf):
    """The calibration table as a CSV file, read by position."""
    path = _folder(spark)
    calibration_orders(spark, sf).select("observed", "predicted", *SPEC.features, "row_id") \
        .write.option("header", True).csv(path)
    df, spec = read_calibration(spark, path)
    return owns(clean(df, spec).select(spec.key, spec.observed, spec.predicted, *spec.features), path)


def q_delta_table_file(spark, sf):
    """K1: the delta table written with a header, read back."""
    path = _folder(spark)
    write_delta_table(add_delta(calibration_orders(spark, sf), SPEC), SPEC, path, keep_key=True, mode="overwrite")
    schema = "row_id long, delta_e double, yr int, mon int, dom int, n_lines long, qty double"
    return owns(spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path), path)


def q_libsvm_files(spark, sf):
    """Sparse labelled vectors written as LIBSVM, read at full width."""
    path = _folder(spark)
    feats = ["day", "minute", "cents"]
    write_libsvm(event_features(spark, sf), path, "hour", feats, mode="overwrite")
    read = read_libsvm(spark, path, num_features=len(feats))
    values = vector_to_array(F.col("features"))
    return owns(read.select("label", *[values[i].alias(f) for i, f in enumerate(feats)]), path)


def q_labelled_csv_file(spark, sf):
    """S3: a headerless labelled CSV, read into vectors."""
    path = _folder(spark)
    event_features(spark, sf).select("hour", "day", "minute", "cents").write.csv(path)
    read = read_labelled_csv(spark, path, 3)
    values = vector_to_array(F.col("features"))
    return owns(read.select("label", *[values[i].alias(f) for i, f in enumerate(["day", "minute", "cents"])]), path)


def q_series_csv_file(spark, sf):
    """K6: time, predicted, observed, observed - predicted without a header."""
    path = _folder(spark)
    write_series_csv(_embedding_series(spark, sf), path, "time", "predicted", "observed", mode="overwrite")
    schema = "time int, predicted double, observed double, delta double"
    return owns(spark.read.schema(schema).option("mode", "FAILFAST").csv(path), path)


def q_predictions_file(spark, sf):
    """K4: the keyed predictions of the depth-1 tree, written and read back."""
    path = _folder(spark)
    with _stump(spark, sf) as res:
        write_predictions(res.series, path, SPEC.key, mode="overwrite")
    return owns(spark.read.parquet(path).select(SPEC.key, rnd(E_HAT, 4).alias("prediction")), path)


def q_accuracy_line(spark, sf):
    """The accuracy line of the depth-1 tree."""
    return _stump(spark, sf).holdout.select(accuracy_line(F.col("rmse")).alias("line"))


def q_labelled_fit(spark, sf):
    """The stand-alone model step: LIBSVM file in, GLR on the labelled vectors,
    its accuracy out."""
    from .labelled import fit_labelled
    path = _folder(spark)
    write_libsvm(add_delta(calibration_orders(spark, sf), SPEC), path, DELTA, [STUMP_FEATURE], mode="overwrite")
    res = fit_labelled(read_libsvm(spark, path, 1), "glr")
    out = res.accuracy.select("technique", "eval_scope", "n_eval", rnd("rmse", DIGITS["rmse"]).alias("rmse"),
                              rnd("all_rows_mse", DIGITS["mse"]).alias("all_rows_mse"))
    return owns(out, path, res._pinned)


def q_calibration_csv_two_orders(spark, sf):
    """A folder whose files order their columns differently, half of the
    rows each; every file's header says which column is which."""
    path = _folder(spark)
    cal = calibration_orders(spark, sf)
    half = F.col("row_id") % 2 == 0
    cal.filter(half).select("observed", "predicted", *SPEC.features, "row_id").write.option("header", True).csv(path)
    cal.filter(~half).select("row_id", "predicted", *reversed(SPEC.features), "observed").write.mode("append").option("header", True).csv(path)
    df, spec = read_calibration(spark, path, observed="observed", predicted="predicted")
    return owns(clean(df, spec).select(spec.key, spec.observed, spec.predicted, *SPEC.features), path)


def q_prediction_file(spark, sf):
    """The hundredths of all events written as one comma-joined list in
    key order, read back by position; no line of it needs to fit a task."""
    path = _folder(spark)
    write_prediction_list(event_features(spark, sf), path, ["event_id"], "cents")
    return owns(read_prediction_file(spark, path, header_lines=0), path)


def q_report_series(spark, sf):
    """K5: the report's three aligned lists in chunks of 1,000 positions, as JSON
    lines with whole numbers."""
    scored = _glr_two_features(spark, sf).series
    whole = scored.select(SPEC.key, *[F.round(c).cast("long").alias(c) for c in (SPEC.predicted, IMPROVED, SPEC.observed)])
    return report_series_json(report_series(whole, [SPEC.key], SPEC.predicted, IMPROVED, SPEC.observed, 1000))


def q_series_rows_sliced(spark, sf):
    """Parallel arrays cut into slices of 10 positions, dealt out, then to rows."""
    return _embedding_series(spark, sf, 10)


# ------------------------------------------------------------ splits that are stored

def q_random_split_sides(spark, sf):
    """The sides of a random split: every row on exactly one, whatever is
    computed again."""
    cal = calibration_orders(spark, sf).select(SPEC.key)
    train, holdout = holdout_split(cal, SPEC.key, method="random", seed=11)
    both = train.withColumn("t", F.lit(1)).withColumn("h", F.lit(0)).unionByName(holdout.withColumn("t", F.lit(0)).withColumn("h", F.lit(1)))
    return owns(both.groupBy(SPEC.key).agg(F.sum("t").alias("t"), F.sum("h").alias("h")).select(SPEC.key, (F.col("t") + F.col("h")).alias("n_sides")), train)


# ------------------------------------------------------------ learners whose result SQL can state

def q_rf_stump_report(spark, sf):
    """M2: a forest of one depth-1 tree over all rows and features is the
    depth-1 tree."""
    spec = SPEC.with_features(STUMP_FEATURE)
    res = correct(calibration_orders(spark, sf), spec, "rf", numTrees=1, maxDepth=1, featureSubsetStrategy="all", bootstrap=False)
    return _rounded_report(res.metrics)


def q_gbt_stump_report(spark, sf):
    """M3: two rounds of boosted depth-1 trees."""
    spec = SPEC.with_features(STUMP_FEATURE)
    return _rounded_report(correct(calibration_orders(spark, sf), spec, "gb_tree", maxIter=2, maxDepth=1).metrics)


def q_linear_one_feature(spark, sf):
    """M5: elastic net on one feature (fitted on the training side)."""
    spec = SPEC.with_features(STUMP_FEATURE)
    res = correct(calibration_orders(spark, sf), spec, "linear")
    return M.coefficients(spark, res.model).select("feature", rnd("coefficient", 2).alias("coefficient"))


def q_stump_summary(spark, sf):
    """The summary of the depth-1 tree."""
    return M.tree_summary(spark, _stump(spark, sf).model)


def q_comparison_one_feature(spark, sf):
    """Three techniques on one feature, one stored frame, one aggregate."""
    rep = compare_techniques(calibration_orders(spark, sf), SPEC.with_features(STUMP_FEATURE), ("glr", "sgd", "decision_tree"),
                             params={"decision_tree": {"maxDepth": 1}})
    return owns(rep.select("series", *[rnd(m, DIGITS[m]).alias(m) for m in METRICS], "technique", "eval_scope", "n_eval",
                           rnd("holdout_rmse", DIGITS["rmse"]).alias("holdout_rmse")), rep)


def q_report_json_rounded(spark, sf):
    """K5: the JSON report of the two-feature GLR, its metrics as whole numbers."""
    rep = _glr_two_features(spark, sf).report
    whole = rep.select("series", *[F.round(m).cast("long").alias(m) for m in METRICS], F.round("holdout_rmse").cast("long").alias("holdout_rmse"))
    return report_json(whole)


def q_row_by_label(spark, sf):
    """the first row (key order) whose label lies in a range, as JSON."""
    scored = _stump(spark, sf).series.withColumn("prediction", rnd(E_HAT, 2))
    return lookup(scored, F.col(DELTA).between(-1000.0, 1000.0), [SPEC.key, "prediction"], [SPEC.key], as_json="json")


#: Features of at most 32 values: every midpoint of two neighbours is a candidate.
COARSE_FEATURES = ("yr", "mon", "dom", "n_lines")


def _coarse_correction(name: str, **params):
    def run(spark, sf):
        rep = correct(calibration_orders(spark, sf), SPEC.with_features(*COARSE_FEATURES), name, **params).report
        return rep.select("series", *[rnd(m, DIGITS[m]).alias(m) for m in METRICS], "technique", "eval_scope", "n_eval",
                          rnd("holdout_rmse", DIGITS["rmse"]).alias("holdout_rmse"))
    run.__doc__ = f"Correction with {name} on the features of at most 32 values; other than its own parameters: {params or 'none'}."
    return run


def q_tree_depth5_summary(spark, sf):
    """Nodes and importances of the depth-5 tree on features of at most 32 values."""
    summary = M.tree_summary(spark, correct(calibration_orders(spark, sf), SPEC.with_features(*COARSE_FEATURES), "decision_tree").model)
    return summary.withColumn("importance", rnd("importance", 8))


def q_linear_five_features(spark, sf):
    """M5: elastic net on five features, run until it stands still."""
    res = correct(calibration_orders(spark, sf), SPEC, "linear", maxIter=500, tol=1e-12)
    return M.coefficients(spark, res.model).select(
        "feature", F.when(F.col("feature") == "(intercept)", rnd("coefficient", -2)).otherwise(rnd("coefficient", 1)).alias("coefficient"))


def q_glr_inference(spark, sf):
    """Coefficients, standard errors, t and p values of the two-feature GLR,
    with its penalty and without."""
    cal = materialize(add_delta(calibration_orders(spark, sf), SPEC).select(*GLR_FEATURES, DELTA))
    parts = [M.gaussian_inference(cal, DELTA, GLR_FEATURES, reg).withColumn("reg_param", F.lit(reg)) for reg in (0.0, 0.3)]
    both = parts[0].unionByName(parts[1])
    return both.select("reg_param", "feature", *[rnd(c, 6).alias(c) for c in ("coefficient", "standard_error", "t_value")], rnd("p_value", 5).alias("p_value"))


WIDE_FEATURES = 16


def q_sgd_wide(spark, sf):
    """M6: gradient descent on 16 columns, by moments in blocks (the label: the
    embedding's group; 60 iterations, step 1)."""
    names = [f"x{i}" for i in range(WIDE_FEATURES)]
    emb = read_table(spark, sf, "embeddings")
    wide = emb.select(F.col("label").cast("double").alias("y"), *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    fitted = M.fit("sgd", wide, "y", tuple(names), iterations=60, step=1.0, tol=0.0).learner
    rows = [(n, float(w)) for n, w in zip(names, fitted.weights)]
    return spark.createDataFrame(rows, "feature string, weight double").select("feature", rnd("weight", 8).alias("weight"))


# ------------------------------------------------------------ rows-only (no SQL oracle)

def _full_correction(name: str) -> Query:
    def run(spark, sf):
        rep = correct(calibration_orders(spark, sf), SPEC, name).report
        return rep.select("series", *[rnd(m, DIGITS[m]).alias(m) for m in METRICS],
                          "technique", "eval_scope", "n_eval",
                          rnd("holdout_rmse", DIGITS["rmse"]).alias("holdout_rmse"))
    run.__doc__ = f"Full correction with {name} on the 5 calibration features (one-pass report)."
    return run


def q_technique_comparison(spark, sf):
    """Every technique's report on one pinned calibration frame."""
    return compare_techniques(calibration_orders(spark, sf), SPEC, parallelism=3)


def q_tree_summary(spark, sf):
    """Depth, nodes, trees and feature importances of the depth-5 tree."""
    res = correct(calibration_orders(spark, sf), SPEC, "decision_tree")
    return M.tree_summary(spark, res.model)


def q_glr_summary(spark, sf):
    """The GLR training summary (dispersion, deviance, AIC, errors)."""
    return M.glr_summary(spark, _glr_two_features(spark, sf).model)


def q_report_json(spark, sf):
    """K5: the metrics of the depth-5 tree correction as one JSON document."""
    return report_json(correct(calibration_orders(spark, sf), SPEC, "decision_tree").report)


QUERIES: dict[str, Query] = {
    "calibration_view": q_calibration_view,
    "delta_table": q_delta_table,
    "pairs": q_pairs,
    "original_metrics": q_original_metrics,
    "glr_report": q_glr_report,
    "glr_report_by_year": q_glr_report_by_year,
    "stream_glr_report": q_stream_glr_report,
    "glr_fit_statistics": q_glr_fit_statistics,
    "glr_coefficients": q_glr_coefficients,
    "glr_residuals": q_glr_residuals,
    "hash_split": q_hash_split,
    "categorical_features": q_categorical_features,
    "stump_split": q_stump_split,
    "stump_report": q_stump_report,
    "preview": q_preview,
    "first_row": q_first_row,
    "label_lookup": q_label_lookup,
    "chart_series": q_chart_series,
    "event_index": q_event_index,
    "sgd_one_feature": q_sgd_one_feature,
    "libsvm_lines": q_libsvm_lines,
    "series_rows": q_series_rows,
    "series_csv": q_series_csv,
    "prediction_list": q_prediction_list,
    "prediction_list_attached": q_prediction_list_attached,
    "alignment": q_alignment,
    "correct_decision_tree": _full_correction("decision_tree"),
    "correct_rf": _full_correction("rf"),
    "correct_gb_tree": _full_correction("gb_tree"),
    "correct_glr": _full_correction("glr"),
    "correct_linear": _full_correction("linear"),
    "correct_sgd": _full_correction("sgd"),
    "technique_comparison": q_technique_comparison,
    "calibration_csv": q_calibration_csv,
    "delta_table_file": q_delta_table_file,
    "libsvm_files": q_libsvm_files,
    "labelled_csv_file": q_labelled_csv_file,
    "series_csv_file": q_series_csv_file,
    "predictions_file": q_predictions_file,
    "accuracy_line": q_accuracy_line,
    "labelled_fit": q_labelled_fit,
    "rf_stump_report": q_rf_stump_report,
    "gbt_stump_report": q_gbt_stump_report,
    "linear_one_feature": q_linear_one_feature,
    "stump_summary": q_stump_summary,
    "comparison_one_feature": q_comparison_one_feature,
    "report_json_rounded": q_report_json_rounded,
    "row_by_label": q_row_by_label,
    "calibration_csv_two_orders": q_calibration_csv_two_orders,
    "prediction_file": q_prediction_file,
    "report_series": q_report_series,
    "series_rows_sliced": q_series_rows_sliced,
    "random_split_sides": q_random_split_sides,
    "tree_depth5_report": _coarse_correction("decision_tree"),
    "tree_depth5_summary": q_tree_depth5_summary,
    # in a node of a few rows several features part them alike, and rounding would choose
    "gbt_depth5_report": _coarse_correction("gb_tree", minInstancesPerNode=20),
    # without bootstrap all 20 trees are the same
    "rf_depth5_report": _coarse_correction("rf", bootstrap=False, featureSubsetStrategy="all"),
    "linear_five_features": q_linear_five_features,
    "glr_inference": q_glr_inference,
    "sgd_wide": q_sgd_wide,
    "tree_summary": q_tree_summary,
    "glr_summary": q_glr_summary,
    "report_json": q_report_json,
}
