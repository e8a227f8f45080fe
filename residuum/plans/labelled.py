"""Error model on an already-labelled vector frame (``label, features``),
e.g. a LIBSVM file whose label is the model error: fit a technique on a 70 %
split, measure its holdout RMSE and score every row.

This is the stand-alone model step of the correction (no observed/predicted
columns are needed).  Rows get an id (from the scan order, pinned with the
frame) so the predictions are keyed, not positional; without a key of its own
the split goes by the row's content, however the file is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import mse
from ..operators import models as M
from ..operators.indexing import fit_indexer
from ..operators.materialize import materialize, release
from ..operators.split import PLACE, hash_place, holdout_split, train_flag, with_place

ROW_ID = "row_id"


@dataclass
class LabelledResult:
    technique: str
    model: M.FittedModel
    predictions: DataFrame    # row_id, label, prediction
    accuracy: DataFrame       # technique, eval_scope, n_eval, rmse, all_rows_mse (1 row)
    _pinned: DataFrame | None = None

    def release(self) -> None:
        """Delete the stored input; the frames cannot be read afterwards."""
        release(self._pinned)

    def __enter__(self) -> "LabelledResult":
        return self

    def __exit__(self, *exc) -> None:
        self.release()


def fit_labelled(df: DataFrame, technique: str, label: str = "label",
                 features: str = "features", key: str | None = None,
                 train_fraction: float = 0.7, seed: int = 42,
                 materialise: str = "auto", **params) -> LabelledResult:
    """Fit ``technique`` on a ``label, features`` frame.

    Holdout techniques train on the hash-split 70 % and report RMSE on the
    rest; ``glr`` and ``sgd`` train and report on all rows (``eval_scope``
    says which).  ``sgd`` needs named feature columns, so a vector input is
    expanded into ``f1..fn`` first.
    """
    tech = M.technique(technique)
    own_key = key is not None
    keyed = df if own_key else df.withColumn(ROW_ID, F.monotonically_increasing_id())
    key = key or ROW_ID
    frame = keyed.select(key, F.col(label).alias("label"), F.col(features).alias("features"))
    if technique == "sgd":
        width = len(frame.select("features").first()[0])
        arr = vector_to_array(F.col("features"))
        frame = frame.select(key, "label", "features",
                             *[arr[i].alias(f"f{i + 1}") for i in range(width)])
        names = tuple(f"f{i + 1}" for i in range(width))
    else:
        names = ()
    if own_key:
        frame = with_place(frame, key)
    else:
        content = F.to_json(F.struct("label", vector_to_array(F.col("features")).alias("features")), {"ignoreNullFields": "false"})
        frame = frame.withColumn(PLACE, hash_place(content))
    pinned = materialize(frame, materialise)
    labelled = pinned.where(F.col("label").isNotNull())
    if tech.eval_scope == "holdout":
        train, _ = holdout_split(labelled, key, train_fraction, "hash", seed, check=True)
        held = ~train_flag(key, train_fraction, PLACE)
    else:
        train, held = labelled, F.lit(True)
    indexer = fit_indexer(labelled, "features") if tech.uses_indexer else None
    fitted = M.fit(technique, train, "label", names, "features", indexer, seed, **params)
    scored = fitted.transform(pinned).select(key, "label", M.PREDICTION, PLACE)
    err = F.col(M.PREDICTION) - F.col("label")
    in_eval = held & F.col("label").isNotNull()
    accuracy = scored.agg(
        F.lit(technique).alias("technique"), F.lit(tech.eval_scope).alias("eval_scope"),
        F.count(F.when(in_eval, 1)).alias("n_eval"),
        F.sqrt(F.avg(F.when(in_eval, err * err))).alias("rmse"),
        mse(M.PREDICTION, "label").alias("all_rows_mse"))   # = training MSE for glr/sgd
    return LabelledResult(technique, fitted, scored.drop(PLACE), accuracy, pinned)
