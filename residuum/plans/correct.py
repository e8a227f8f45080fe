"""The error-correction plan: learn a model's error, add it back, measure.

    clean -> delta_e = observed - predicted -> assemble features
      -> [materialise once: the fit makes several passes]
      -> indexer (trees, fitted on all labelled rows) -> split -> fit
      -> holdout RMSE of the error model (one aggregate)
      -> e_hat = model(rows) -> improved = predicted + e_hat
      -> 12 metrics (RMSE, PBIAS, CD, NSE x original/improved/delta) in ONE aggregate

Everything stays keyed by ``spec.key``; no series is zipped by position or
collected.  The returned frames are lazy; ``release()`` drops the cached input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import METRICS, metric_columns, series_report
from ..operators import models as M
from ..operators.encode import assemble
from ..operators.indexing import fit_indexer
from ..operators.materialize import materialize, owns, release
from ..operators.prepare import DELTA, E_HAT, IMPROVED, add_delta, clean, correct_prediction, safe_names
from ..operators.split import PLACE, holdout_split, train_flag, with_place, with_random_place
from ..spec import CalibrationSpec

FEATURES_COL = "features"


def prepare_frame(df: DataFrame, spec: CalibrationSpec,
                  keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """``key, [keep...], observed, predicted, features..., delta_e`` (typed and
    cleaned; ``keep`` columns are carried unchanged, e.g. a site or a time)."""
    return add_delta(clean(df, spec, keep), spec)


@dataclass
class CorrectionResult:
    technique: str
    spec: CalibrationSpec
    model: M.FittedModel
    series: DataFrame     # key, observed, predicted, features, delta_e, e_hat, improved
    report: DataFrame     # series, rmse, pbias, cd, nse, technique, eval_scope, n_eval,
                          # holdout_rmse (3 rows, ONE aggregate pass over the scored rows)
    _pinned: DataFrame | None = None

    @property
    def metrics(self) -> DataFrame:
        """``series, rmse, pbias, cd, nse`` (3 rows)."""
        return self.report.select("series", *METRICS)

    @property
    def holdout(self) -> DataFrame:
        """``technique, eval_scope, n_eval, rmse`` of the error model (1 row)."""
        return self.report.where(F.col("series") == "original").select(
            "technique", "eval_scope", "n_eval", F.col("holdout_rmse").alias("rmse"))

    def release(self) -> None:
        """Delete the stored input (or drop it from memory); ``series`` and
        ``report`` cannot be read afterwards."""
        release(self._pinned)

    def __enter__(self) -> "CorrectionResult":
        return self

    def __exit__(self, *exc) -> None:
        self.release()


def three_way_pairs(spec: CalibrationSpec, e_hat: str = E_HAT,
                    improved: str = IMPROVED) -> dict[str, tuple[str, str]]:
    """The reference's three series: the original prediction, the improved
    prediction (both against observed) and the predicted error (sim = e_hat,
    obs = delta_e)."""
    return {"original": (spec.predicted, spec.observed),
            "improved": (improved, spec.observed),
            "delta_error": (e_hat, DELTA)}


def three_way_report(series: DataFrame, spec: CalibrationSpec, *group_by: str,
                     extra: dict | None = None) -> DataFrame:
    """``[group..], series, rmse, pbias, cd, nse[, extra..]`` in one aggregate."""
    return series_report(series, three_way_pairs(spec), *group_by, extra=extra)


def correct(df: DataFrame, spec: CalibrationSpec, technique: str,
            train_fraction: float = 0.7, split: str = "hash", seed: int = 42,
            scope: str = "all", materialise: str = "auto", prepared: bool = False,
            keep: tuple[str, ...] | list[str] = (), indexer=None,
            **params) -> CorrectionResult:
    """Run the whole correction for ``technique`` (see ``models.REGISTRY``).

    ``scope='all'`` scores every row (the reference's behaviour: improved
    metrics are then partly in-sample); ``scope='holdout'`` scores only the
    rows the model did not see.  ``prepared=True`` means ``df`` already holds
    the columns ``prepare_frame`` produces.  ``keep`` names columns carried
    through to ``series`` (e.g. a group key for ``three_way_report``).
    ``indexer`` reuses a fitted ``VectorIndexerModel`` (fitted on the same
    labelled rows) instead of fitting one.

    Jobs: materialise (1), indexer (1, trees only), the learner's own passes,
    then ONE aggregate over the scored rows for the 12 metrics and the holdout
    RMSE together (the hash split is a pure expression of the key, so holdout
    membership is known on every scored row).
    """
    if scope not in ("all", "holdout"):
        raise ValueError("scope must be 'all' or 'holdout'")
    tech = M.technique(technique)
    if not prepared:
        df, spec, keep = safe_names(df, spec, keep)
    frame = df if prepared else prepare_frame(df, spec, keep)
    if split == "random" and tech.eval_scope == "holdout":
        stored = with_random_place(frame.sortWithinPartitions(spec.key), seed, materialise)
    else:
        stored = frame if materialise == "none" else _pin(frame, spec, materialise)
    pinned = assemble(stored, spec.features, out=FEATURES_COL)
    labelled = pinned.where(F.col(DELTA).isNotNull())

    uses_holdout = tech.eval_scope == "holdout"
    fitted, evaluation = _fit(labelled, spec, technique, train_fraction, split, seed, indexer, params)

    to_score = evaluation if scope == "holdout" else pinned
    carried = [c for c in dict.fromkeys(keep) if c not in (spec.key, spec.observed, spec.predicted, *spec.features)]
    internal = [PLACE] if PLACE in stored.columns else []
    scored = correct_prediction(fitted.transform(to_score).withColumnRenamed(M.PREDICTION, E_HAT), spec).select(
        spec.key, *carried, spec.observed, spec.predicted, *spec.features, DELTA, E_HAT, IMPROVED, *internal)
    series = scored.drop(*internal)
    extra = {"technique": F.lit(technique), "eval_scope": F.lit(tech.eval_scope)}
    held = (_held_out(stored, spec, train_fraction) if uses_holdout and scope == "all" else F.lit(True))
    extra["n_eval"], extra["holdout_rmse"] = _evaluation(held, E_HAT)
    report = three_way_report(scored, spec, extra=extra)
    return CorrectionResult(technique, spec, fitted, series, report, stored)


def _pin(frame: DataFrame, spec: CalibrationSpec, how: str) -> DataFrame:
    """Store the prepared rows once.

    Row order inside a partition after a shuffle is not fixed, and the tree
    learners sample rows per partition (split candidates, bootstrap): a local
    sort by key (no shuffle) before pinning makes every seeded fit
    reproducible.  The split place is stored with the rows: md5 runs once per
    row, not once per pass of the learner.
    """
    return materialize(with_place(frame, spec.split_key or spec.key).sortWithinPartitions(spec.key), how)


def _held_out(stored: DataFrame, spec: CalibrationSpec, train_fraction: float):
    place = PLACE if PLACE in stored.columns else None
    return ~train_flag(F.col(f"`{spec.split_key or spec.key}`"), train_fraction, place)


def _evaluation(held, e_hat: str) -> tuple:
    """Aggregates over the evaluated rows: their number and the error model's
    RMSE on them."""
    err = F.col(e_hat) - F.col(DELTA)
    inside = held & F.col(DELTA).isNotNull()
    return F.count(F.when(inside, 1)), F.sqrt(F.avg(F.when(inside, err * err)))


def _fit(labelled: DataFrame, spec: CalibrationSpec, technique: str, train_fraction: float, split: str,
         seed: int, indexer, params: dict) -> tuple[M.FittedModel, DataFrame]:
    """The fitted model and the rows it is evaluated on."""
    tech = M.technique(technique)
    train = evaluation = labelled
    if tech.eval_scope == "holdout":
        train, evaluation = holdout_split(labelled, spec.split_key or spec.key, train_fraction, split, seed, check=True)
    if not tech.uses_indexer:
        indexer = None
    elif indexer is None:
        indexer = fit_indexer(labelled, FEATURES_COL)
    return M.fit(technique, train, DELTA, spec.features, FEATURES_COL, indexer, seed, **params), evaluation


def compare_techniques(df: DataFrame, spec: CalibrationSpec,
                       techniques: tuple[str, ...] | list[str] = tuple(M.REGISTRY),
                       materialise: str = "auto", keep: tuple[str, ...] | list[str] = (),
                       parallelism: int = 1, train_fraction: float = 0.7, seed: int = 42,
                       params: dict[str, dict] | None = None) -> DataFrame:
    """The report of every technique on the same calibration table: the
    prepared frame is computed and stored ONCE, every fit reads it, and all
    models score it as further columns of one pass that one aggregate measures.

    ``params`` gives parameters per technique.  ``parallelism`` > 1 submits
    that many fits at once from a thread pool (as Spark ML's
    ``CrossValidator(parallelism=...)`` does), so small fits that cannot fill
    the cluster on their own share it.  The returned frame owns the stored
    input: ``release`` it when the report has been read.
    """
    df, spec, keep = safe_names(df, spec, keep)
    stored = _pin(prepare_frame(df, spec, keep), spec, materialise)
    vec = assemble(stored, spec.features, out=FEATURES_COL)
    labelled = vec.where(F.col(DELTA).isNotNull())
    # one categorical-feature indexer for every tree technique
    shared = fit_indexer(labelled, FEATURES_COL) if any(M.technique(t).uses_indexer for t in techniques) else None

    def one(t: str) -> M.FittedModel:
        return _fit(labelled, spec, t, train_fraction, "hash", seed, shared, (params or {}).get(t, {}))[0]

    if parallelism > 1:
        from concurrent.futures import ThreadPoolExecutor
        from pyspark import inheritable_thread_target
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            target = inheritable_thread_target(stored.sparkSession)(one)
            models = list(pool.map(target, techniques))
    else:
        models = [one(t) for t in techniques]

    scored, aggs = vec, []
    for i, (t, fitted) in enumerate(zip(techniques, models)):
        e_hat, improved = f"_e{i}", f"_i{i}"
        base = set(scored.columns)
        after = fitted.transform(scored).withColumnRenamed(M.PREDICTION, e_hat)
        scored = correct_prediction(after.drop(*[c for c in after.columns if c not in base and c != e_hat]), spec, e_hat, improved)
        for s, (sim, obs) in three_way_pairs(spec, e_hat, improved).items():
            aggs += metric_columns(sim, obs, prefix=f"_{i}_{s}_")
        held = _held_out(stored, spec, train_fraction) if M.technique(t).eval_scope == "holdout" else F.lit(True)
        n_eval, error = _evaluation(held, e_hat)
        aggs += [n_eval.alias(f"_{i}_n"), error.alias(f"_{i}_r")]
    wide = scored.agg(*aggs)
    rows = [F.struct(F.lit(s).alias("series"), *[F.col(f"_{i}_{s}_{m}").alias(m) for m in METRICS], F.lit(t).alias("technique"),
                     F.lit(M.technique(t).eval_scope).alias("eval_scope"), F.col(f"_{i}_n").alias("n_eval"), F.col(f"_{i}_r").alias("holdout_rmse"))
            for i, t in enumerate(techniques) for s in three_way_pairs(spec)]
    return owns(wide.select(F.inline(F.array(*rows))), stored)
