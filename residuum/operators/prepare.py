"""Row-level preparation of a calibration table: cleaning, the error label,
the delta table, the (predicted, observed) pairs and the correction itself.

All of these are projections: they never shuffle and they fuse into the
whole-stage-generated code of whatever scan or join feeds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import CalibrationSpec

DELTA = "delta_e"
E_HAT = "e_hat"
IMPROVED = "improved"


#: Column names that the plans add; an input column of such a name is renamed.
RESERVED = frozenset({DELTA, E_HAT, IMPROVED, "features", "indexed_features", "prediction"})


def col(name: str) -> Column:
    """A column by its exact name (dots and all)."""
    return F.col("`" + name.replace("`", "``") + "`")


def _safe_name(name: str, taken: set[str]) -> str:
    plain = name.replace(".", "_").replace("`", "_") or "column"
    if plain in RESERVED or plain.startswith("_split"):
        plain = f"input_{plain}"
    while plain.lower() in taken:
        plain += "_"
    return plain


def safe_names(df: DataFrame, spec: CalibrationSpec, keep: list[str] | tuple[str, ...] = (),
               ) -> tuple[DataFrame, CalibrationSpec, list[str]]:
    """``df`` with names that can meet neither the plans' own columns nor
    Spark's name syntax, and the roles under the new names.  Only names with a
    dot or a backtick, or of a column that the plans add (``delta_e``,
    ``features``, ``prediction``, ...), change: dots become ``_``, the others
    get the prefix ``input_``."""
    taken: set[str] = set()
    names = {}
    # names that may stay are taken first
    for c in sorted(df.columns, key=lambda c: _safe_name(c, set()) != c):
        names[c] = _safe_name(c, taken)
        taken.add(names[c].lower())
    if all(a == b for a, b in names.items()):
        return df, spec, list(keep)
    key = names.get(spec.key, spec.key) if spec.key else spec.key
    split = names.get(spec.split_key, spec.split_key) if spec.split_key else None
    new = CalibrationSpec(names[spec.observed], names[spec.predicted], tuple(names[f] for f in spec.features), key, split)
    return df.toDF(*[names[c] for c in df.columns]), new, [names.get(c, c) for c in keep]


def _no_nan(c: Column) -> Column:
    """NaN read from text (``NaN``) counts as missing, like an empty field."""
    return F.nanvl(c, F.lit(None).cast("double"))


def clean(df: DataFrame, spec: CalibrationSpec, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Typed, NULL-normalised calibration rows: ``key, observed, predicted,
    features...`` as doubles.

    * every numeric role is cast to double, so integer inputs are never
      floored by integer division later on;
    * NaN becomes NULL for observed and predicted (such rows are left out of
      fitting and of the metrics but still scored);
    * a missing feature counts as 0.0 - the value an empty field ends up with
      once the reference writes its sparse labelled vectors.

    ``keep`` names further columns carried through unchanged (e.g. a time); a
    role among them is carried once.  A frame without the key column (or a spec
    without a key) gets a row id that is unique within this computation.
    """
    cols = [col(spec.key)] if spec.key in df.columns else [F.monotonically_increasing_id().alias(spec.key)]
    roles = {spec.key, spec.observed, spec.predicted, *spec.features}
    more = dict.fromkeys([*keep, *([spec.split_key] if spec.split_key in df.columns else [])])
    cols += [col(c) for c in more if c not in roles]
    cols += [
        _no_nan(col(spec.observed).cast("double")).alias(spec.observed),
        _no_nan(col(spec.predicted).cast("double")).alias(spec.predicted),
    ]
    cols += [F.coalesce(_no_nan(col(f).cast("double")), F.lit(0.0)).alias(f)
             for f in spec.features]
    return df.select(*cols)


def add_delta(df: DataFrame, spec: CalibrationSpec, name: str = DELTA) -> DataFrame:
    """The model error the regressors learn: ``observed - predicted``.  A column
    of that name in the input is an error, not a label (see ``safe_names``)."""
    if name in df.columns:
        raise ValueError(f"the input has a column {name!r}; rename it first (safe_names)")
    return df.withColumn(name, col(spec.observed) - col(spec.predicted))


def delta_table(df: DataFrame, spec: CalibrationSpec, keep_key: bool = True) -> DataFrame:
    """``[key,] delta_e, features...``: the error first, observed and predicted
    dropped (the layout of the reference's intermediate delta file)."""
    with_delta = df if DELTA in df.columns and DELTA not in spec.features else add_delta(df, spec)
    lead = [col(spec.key)] if keep_key and spec.key in df.columns else []
    return with_delta.select(*lead, DELTA, *[col(f) for f in spec.features])


def pairs(df: DataFrame, spec: CalibrationSpec) -> DataFrame:
    """``key, predicted, observed`` - the pair series every metric reads."""
    return df.select(col(spec.key), col(spec.predicted), col(spec.observed))


def correct_prediction(df: DataFrame, spec: CalibrationSpec, e_hat: str = E_HAT,
                       out: str = IMPROVED) -> DataFrame:
    """The improved prediction: ``predicted + e_hat``."""
    return df.withColumn(out, col(spec.predicted) + F.col(e_hat))

