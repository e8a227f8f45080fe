"""Command line.

    python -m residuum fit <technique> <libsvm> <out_dir> [--num-features N]
        The model step on a LIBSVM file whose label is the error: writes
        <out_dir>/accuracy (text: the holdout RMSE line) and
        <out_dir>/predictions (parquet: row_id, label, prediction).

    python -m residuum correct <technique> <calibration.csv> <out_dir> [--observed NAME --predicted NAME]
        The whole correction of a calibration CSV (observed, predicted,
        features by position, or the named ones): writes <out_dir>/report_json
        (text: the metrics as JSON), <out_dir>/report_series (JSON lines: the
        report's three lists in chunks), <out_dir>/report and <out_dir>/series
        (parquet).

On a cluster, ``spark-submit`` a driver file that calls
``residuum.__main__.main([...])`` (the active session is used);
``spark.checkpoint.dir`` should name shared storage.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.materialize import release
from .operators.models import REGISTRY


def _session() -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    from .session import build_session
    return build_session()


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="residuum")
    sub = ap.add_subparsers(dest="cmd", required=True)
    f = sub.add_parser("fit", help="error model on a LIBSVM file")
    f.add_argument("technique", choices=sorted(REGISTRY))
    f.add_argument("libsvm")
    f.add_argument("out")
    f.add_argument("--num-features", type=int, default=None)
    c = sub.add_parser("correct", help="full correction of a calibration CSV")
    c.add_argument("technique", choices=sorted(REGISTRY))
    c.add_argument("csv")
    c.add_argument("out")
    c.add_argument("--observed", default=None, help="name of the observed column (the first one by default)")
    c.add_argument("--predicted", default=None, help="name of the predicted column (the second one by default)")
    args = ap.parse_args(argv)
    spark = _session()

    if args.cmd == "fit":
        from .plans.labelled import fit_labelled
        from .sinks import accuracy_text
        from .sources.readers import read_libsvm
        res = fit_labelled(read_libsvm(spark, args.libsvm, args.num_features), args.technique)
        res.predictions.write.mode("errorifexists").parquet(_join(args.out, "predictions"))
        line = accuracy_text(res.accuracy.first()["rmse"])   # one row
        _write_line(spark, line, _join(args.out, "accuracy"))
        print(line)
        return 0

    from .plans.correct import correct
    from .operators.prepare import IMPROVED
    from .sinks import report_json, report_series, write_report_series
    from .sources.readers import read_calibration
    df, spec = read_calibration(spark, args.csv, observed=args.observed, predicted=args.predicted)
    res = correct(df, spec, args.technique)
    res.series.write.mode("errorifexists").parquet(_join(args.out, "series"))
    lists = report_series(spark.read.parquet(_join(args.out, "series")), [res.spec.key], res.spec.predicted, IMPROVED, res.spec.observed)
    write_report_series(lists, _join(args.out, "report_series"))
    release(lists)
    res.report.write.mode("errorifexists").parquet(_join(args.out, "report"))
    doc = report_json(spark.read.parquet(_join(args.out, "report")))
    doc.coalesce(1).write.mode("errorifexists").text(_join(args.out, "report_json"))
    print(doc.first()["report"])
    return 0


def _join(base: str, name: str) -> str:
    return base.rstrip("/") + "/" + name


def _write_line(spark: SparkSession, line: str, path: str) -> None:
    """One line of text, written by Spark (the folder may be shared storage)."""
    spark.createDataFrame([(line,)], "value string").coalesce(1) \
        .write.mode("errorifexists").text(path)


if __name__ == "__main__":
    sys.exit(main())
