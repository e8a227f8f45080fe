"""Writers for the correction's outputs.

Every writer is a distributed ``DataFrame.write``: files are written by the
executors, one per task, never gathered on the driver.  The only driver-side
formatting is ``accuracy_text`` (a single number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import METRICS
from ..operators.encode import to_libsvm
from ..operators.materialize import owns
from ..operators.ordering import dense_index
from ..operators.prepare import DELTA, delta_table
from ..spec import CalibrationSpec


def write_delta_table(df: DataFrame, spec: CalibrationSpec, path: str, fmt: str = "csv",
                      mode: str = "errorifexists", keep_key: bool = False) -> None:
    """K1: ``delta_e, features...`` with a header (``delta_e`` first)."""
    out = delta_table(df, spec, keep_key=keep_key)
    writer = out.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_libsvm(df: DataFrame, path: str, label: str | None,
                 features: list[str] | tuple[str, ...], mode: str = "errorifexists") -> None:
    """K2: one sparse labelled-vector line per row (``label=None``: label 1).
    Readable with ``sources.readers.read_libsvm``."""
    to_libsvm(df, label, features).write.mode(mode).text(path)


def write_predictions(series: DataFrame, path: str, key: str,
                      prediction: str = "e_hat", mode: str = "errorifexists") -> None:
    """K4: the keyed per-row predictions (not a positional list)."""
    series.select(key, prediction).write.mode(mode).parquet(path)


def write_prediction_list(df: DataFrame, path: str, order_by: list[str] | tuple[str, ...], value: str,
                          mode: str = "errorifexists") -> None:
    """K4: the values as a comma-joined list in key order.  Every task writes its
    range of the list as one line of a file of its own; the files follow one
    another.  ``sources.readers.read_prediction_file`` (without header lines)
    reads them back."""
    order = [F.col(f"`{c}`") for c in order_by]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select(F.col(f"`{value}`").cast("string").alias("value")).write.mode(mode).option("lineSep", ",").text(path)


def accuracy_text(rmse: float | None) -> str:
    """K4: the holdout accuracy line, C ``%g`` formatting of one number."""
    # fixed value: the line's text
    return "Root Mean Squared Error (RMSE) on test data = %g" % (
        float("nan") if rmse is None else rmse)


def general_number(c: Column) -> Column:
    """A double as C's ``%g`` writes it: six significant digits, without
    closing zeros, with an exponent from 1e6 on and below 1e-4 (an exact tie
    between two results goes up)."""
    text = F.format_string("%.5e", c)
    mantissa, power = F.substring_index(text, "e", 1), F.substring_index(text, "e", -1).cast("int")
    short = lambda t: F.when(t.contains("."), F.rtrim(F.rtrim(t, F.lit("0")), F.lit("."))).otherwise(t)
    plain = F.format_string("%.0f", c)
    for digits in range(1, 10):
        plain = F.when(power == 5 - digits, F.format_string(f"%.{digits}f", c)).otherwise(plain)
    exponent = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return (F.when(c.isNull() | F.isnan(c), "nan").when(c == 0, "0")
            .when((power < -4) | (power > 5), F.concat(short(mantissa), F.lit("e"), exponent)).otherwise(short(plain)))


def accuracy_line(rmse: Column) -> Column:
    """The accuracy line as a column expression (``accuracy_text`` of a value)."""
    # fixed value: the line's text
    return F.concat(F.lit("Root Mean Squared Error (RMSE) on test data = "), general_number(rmse))


def report_json(report: DataFrame) -> DataFrame:
    """K5: the three-series report (``series, rmse, pbias, cd, nse[,
    holdout_rmse]``) as one JSON object ``{original_rmse, ..., delta_error_nse
    [, accuracy_info, holdout_rmse]}`` (one aggregate over the 3 report rows).
    A metric that is not defined is a ``null`` member.  The three lists of values
    are ``report_series``."""
    names = ["original", "improved", "delta_error"]
    cols = [F.first(F.when(F.col("series") == s, F.col(m)), ignorenulls=True).alias(f"{s}_{m}")
            for s in names for m in METRICS]
    wide = report.agg(*cols, *([F.first("holdout_rmse").alias("holdout_rmse")] if "holdout_rmse" in report.columns else []))
    members = [F.col(c) for c in wide.columns if c != "holdout_rmse"]
    if "holdout_rmse" in wide.columns:
        # the line ends with a line break, as in the reference's document
        members += [F.concat(accuracy_line(F.col("holdout_rmse").cast("double")), F.lit("\n")).alias("accuracy_info"), F.col("holdout_rmse")]
    return wide.select(F.to_json(F.struct(*members), {"ignoreNullFields": "false"}).alias("report"))


#: Positions of the report's lists that one line holds.
CHUNK = 10_000


def report_series(series: DataFrame, order_by: list[str] | tuple[str, ...], predicted: str, improved: str, observed: str,
                  chunk: int = CHUNK) -> DataFrame:
    """K5: the report's three aligned lists in key order, in chunks of so many
    positions: ``chunk, start, original_p_list, improved_p_list, o_list``.  The
    rows are numbered by ``dense_index``; the number decides the chunk, so a
    group never holds more than ``chunk`` rows, and NULLs keep their places."""
    if chunk < 1:
        raise ValueError("chunk must be positive")
    at = dense_index(series.select(*[F.col(f"`{c}`") for c in dict.fromkeys((*order_by, predicted, improved, observed))]), order_by, out="_idx")
    point = F.struct("_idx", F.col(f"`{predicted}`").alias("p"), F.col(f"`{improved}`").alias("i"), F.col(f"`{observed}`").alias("o"))
    chunks = at.groupBy(F.floor(F.col("_idx") / chunk).alias("chunk")).agg(F.array_sort(F.collect_list(point)).alias("_rows"))
    return owns(chunks.select("chunk", (F.col("chunk") * chunk).alias("start"), F.col("_rows.p").alias("original_p_list"),
                              F.col("_rows.i").alias("improved_p_list"), F.col("_rows.o").alias("o_list")), at)


def report_series_json(chunks: DataFrame) -> DataFrame:
    """K5: one JSON object per chunk; NULLs stay members."""
    return owns(chunks.select("chunk", F.to_json(F.struct("start", "original_p_list", "improved_p_list", "o_list"), {"ignoreNullFields": "false"}).alias("line")), chunks)


def write_report_series(chunks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K5: the chunks as JSON lines, in order over the files."""
    lines = report_series_json(chunks)
    lines.repartitionByRange("chunk").sortWithinPartitions("chunk").select("line").write.mode(mode).text(path)


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    report_json(report).coalesce(1).write.mode(mode).text(path)


def write_series_csv(series: DataFrame, path: str, time: str, predicted: str,
                     observed: str, mode: str = "errorifexists") -> None:
    """K6: headerless ``time, predicted, observed, observed - predicted``."""
    out = series.select(time, predicted, observed,
                        (F.col(observed) - F.col(predicted)).alias(DELTA))
    out.write.mode(mode).option("header", False).csv(path)
