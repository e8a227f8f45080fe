"""Correction of a stream of calibration rows with an already fitted model.

Scoring is a stateless projection (clean -> assemble -> model transform ->
improved), so it runs per micro-batch with no state.  The goodness-of-fit
metrics are declarative aggregates (count, sums, central moments) whose
buffers merge, so Structured Streaming keeps them as state: either one
running report (``complete`` mode) or one report per event-time window with
a watermark (``append`` mode: a window is emitted once the watermark passes
it, and its state is dropped).
"""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.encode import assemble
from ..operators.materialize import new_store, owns
from ..operators.models import PREDICTION, FittedModel
from ..operators.prepare import DELTA, E_HAT, IMPROVED, add_delta, clean, safe_names
from ..plans.correct import FEATURES_COL, three_way_report
from ..session import checkpoint_dir
from ..spec import CalibrationSpec


def correct_stream(stream: DataFrame, spec: CalibrationSpec, fitted: FittedModel,
                   keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """``key, [keep...], observed, predicted, delta_e, e_hat, improved`` for
    every incoming row (works on batch frames too).  Names are made safe and kept
    columns carried once, as in ``plans.correct.correct``."""
    stream, spec, keep = safe_names(stream, spec, keep)
    vec = assemble(add_delta(clean(stream, spec, keep), spec), spec.features, out=FEATURES_COL)
    carried = [c for c in dict.fromkeys(keep) if c not in (spec.key, spec.observed, spec.predicted)]
    return fitted.transform(vec).select(
        spec.key, *carried, spec.observed, spec.predicted, DELTA,
        F.col(PREDICTION).alias(E_HAT),
        (F.col(spec.predicted) + F.col(PREDICTION)).alias(IMPROVED))


def running_report(scored: DataFrame, spec: CalibrationSpec) -> DataFrame:
    """The three-series report over everything seen so far (``complete``)."""
    return three_way_report(scored, spec)


def windowed_report(scored: DataFrame, spec: CalibrationSpec, time_col: str,
                    window: str, watermark: str) -> DataFrame:
    """One three-series report per event-time window (``append`` with a
    watermark: late rows within ``watermark`` still count, later ones are
    dropped by Structured Streaming).  A zone-less timestamp is read in the
    session time zone."""
    timed = scored.withColumn(time_col, F.col(time_col).cast("timestamp")) \
        .withWatermark(time_col, watermark) \
        .withColumn("window", F.window(time_col, window))
    return three_way_report(timed, spec, "window")


def run_to_store(df: DataFrame, mode: str = "complete", store: str | None = None) -> DataFrame:
    """Run a streaming frame over everything available, micro-batch by
    micro-batch, into a table under the shared folder and return it as a batch
    frame.  ``complete`` keeps the last batch's state, ``append`` and
    ``update`` every batch's rows.  Each batch has a folder of its own that a
    repeated batch overwrites; the stream's checkpoint lies beside them, and
    ``release`` deletes both.

    ``store`` names the folder.  A later call with the same name, in this session
    or another, goes on where the last one ended or broke off: finished batches
    are read from the folder, one that was not finished is written again.  Without
    a name every call begins anew.
    """
    spark = df.sparkSession
    root = checkpoint_dir(spark)
    if root is None:
        raise ValueError("a stream needs spark.checkpoint.dir for its checkpoint and its result")
    base = f"{root.rstrip('/')}/{store}" if store else new_store(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch={number}")

    q = (df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/_stream")
         .trigger(availableNow=True).foreachBatch(write).start())
    q.awaitTermination()
    numbers = _finished(base)
    if not numbers:
        out = spark.createDataFrame([], df.schema)
    else:
        numbers = numbers[-1:] if mode == "complete" else numbers
        out = spark.read.schema(df.schema).parquet(*[f"{base}/batch={n}" for n in numbers])
    return owns(out, base)


def _finished(base: str) -> list[int]:
    """The batches of a store that were written to their end."""
    fs, at = pafs.FileSystem.from_uri(base) if ":/" in base else (pafs.LocalFileSystem(), base)
    found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    numbers = [int(f.base_name.removeprefix("batch=")) for f in found if f.base_name.startswith("batch=")]
    return sorted(n for n in numbers if fs.get_file_info(f"{at}/batch={n}/_SUCCESS").type == pafs.FileType.File)
