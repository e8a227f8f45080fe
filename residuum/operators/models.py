"""Registry of error-model regressors, fitting, scoring and introspection.

Each technique is a stock Spark ML estimator (or the Gram-form least squares
of ``gram.py``); training and scoring are distributed by Spark ML.  Every
estimator gets an explicit seed - PySpark's default seed is a hash of the class
name, which would silently tie results to it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any, Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorIndexerModel
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor,
                                   GeneralizedLinearRegression, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.student import two_sided
from .gram import GramLeastSquares, GramLeastSquaresModel, central_moments

PREDICTION = "prediction"

# The parameters each technique is run with (all others are
# Spark ML defaults).
#   decision_tree  maxDepth 5, maxBins 32
#   rf             numTrees 20, maxDepth 5
#   gb_tree        maxIter 10 (step size 0.1, squared loss)
#   glr            family gaussian, link identity, maxIter 10, regParam 0.3
#   linear         maxIter 10, regParam 0.3, elasticNetParam 0.8
#   sgd            iterations 100, step 1e-8, no intercept, tolerance 0.001
DEFAULT_PARAMS: dict[str, dict[str, Any]] = {
    "decision_tree": {"maxDepth": 5, "maxBins": 32},
    "rf": {"numTrees": 20, "maxDepth": 5},
    "gb_tree": {"maxIter": 10},
    "glr": {"family": "gaussian", "link": "identity", "maxIter": 10, "regParam": 0.3},
    "linear": {"maxIter": 10, "regParam": 0.3, "elasticNetParam": 0.8},
    "sgd": {"iterations": 100, "step": 1e-8, "tol": 0.001, "fit_intercept": False},
}


@dataclass(frozen=True)
class Technique:
    name: str
    factory: Callable[..., Any]
    uses_indexer: bool      # trees: categorical auto-indexing before the learner
    eval_scope: str         # 'holdout': fit on the train split; 'train': on all rows
    seeded: bool = True


def _tree(cls):
    def make(features_col: str, label: str, seed: int, **params):
        return cls(featuresCol=features_col, labelCol=label, predictionCol=PREDICTION,
                   seed=seed, **params)
    return make


def _linear(cls):
    def make(features_col: str, label: str, seed: int, **params):
        return cls(featuresCol=features_col, labelCol=label, predictionCol=PREDICTION,
                   **params)
    return make


REGISTRY: dict[str, Technique] = {
    "decision_tree": Technique("decision_tree", _tree(DecisionTreeRegressor), True, "holdout"),
    "rf": Technique("rf", _tree(RandomForestRegressor), True, "holdout"),
    "gb_tree": Technique("gb_tree", _tree(GBTRegressor), True, "holdout"),
    "glr": Technique("glr", _linear(GeneralizedLinearRegression), False, "train", False),
    "linear": Technique("linear", _linear(LinearRegression), False, "holdout", False),
    "sgd": Technique("sgd", GramLeastSquares, False, "train", False),
}


def technique(name: str) -> Technique:
    try:
        return REGISTRY[name]
    except KeyError:
        raise ValueError(f"unknown technique {name!r}; choose one of "
                         f"{', '.join(sorted(REGISTRY))}") from None


@dataclass
class FittedModel:
    """A fitted error model: scores a frame by adding ``prediction``."""
    technique: str
    feature_names: tuple[str, ...]
    features_col: str
    model: PipelineModel | GramLeastSquaresModel
    indexer: VectorIndexerModel | None = None
    params: dict[str, Any] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    @property
    def learner(self):
        if isinstance(self.model, PipelineModel):
            return self.model.stages[-1]
        return self.model


def fit(name: str, train: DataFrame, label: str, feature_names: tuple[str, ...],
        features_col: str = "features", indexer: VectorIndexerModel | None = None,
        seed: int = 42, **overrides) -> FittedModel:
    """Fit technique ``name`` on ``train``.

    Tree techniques need a fitted ``indexer`` (see ``indexing.fit_indexer``;
    fit it on all labelled rows); it becomes the first pipeline stage.
    """
    tech = technique(name)
    params = {**DEFAULT_PARAMS[name], **overrides}
    if name == "sgd":
        est = GramLeastSquares(features=tuple(feature_names), label=label, **params)
        return FittedModel(name, tuple(feature_names), features_col, est.fit(train),
                           None, params)
    if tech.uses_indexer:
        if indexer is None:
            raise ValueError(f"{name} needs a fitted VectorIndexerModel")
        learner = tech.factory(indexer.getOutputCol(), label, seed, **params)
        stages = [indexer, learner]
    else:
        learner = tech.factory(features_col, label, seed, **params)
        stages = [learner]
    model = Pipeline(stages=stages).fit(train)
    return FittedModel(name, tuple(feature_names), features_col, model, indexer, params)


# ---------------------------------------------------------------- introspection

def coefficients(spark: SparkSession, fitted: FittedModel) -> DataFrame:
    """``feature, coefficient``; the intercept is the row ``(intercept)``."""
    learner = fitted.learner
    if isinstance(learner, GramLeastSquaresModel):
        coefs, intercept = list(map(float, learner.weights)), float(learner.intercept)
    elif hasattr(learner, "coefficients"):
        coefs, intercept = list(map(float, learner.coefficients.toArray())), float(learner.intercept)
    else:
        raise ValueError(f"{fitted.technique} has no coefficients")
    rows = list(zip(fitted.feature_names, coefs)) + [("(intercept)", intercept)]
    schema = T.StructType([T.StructField("feature", T.StringType(), False),
                           T.StructField("coefficient", T.DoubleType(), True)])
    return spark.createDataFrame(rows, schema)


def glr_summary(spark: SparkSession, fitted: FittedModel) -> DataFrame:
    """The training summary of a GLR fit as one row (a failing job is an error
    here, not a missing statistic)."""
    s = fitted.learner.summary
    row = {
        "dispersion": float(s.dispersion),
        "null_deviance": float(s.nullDeviance),
        "deviance": float(s.deviance),
        "residual_dof_null": int(s.residualDegreeOfFreedomNull),
        "residual_dof": int(s.residualDegreeOfFreedom),
        "aic": float(s.aic),
        "coefficient_standard_errors": [float(x) for x in s.coefficientStandardErrors],
        "t_values": [float(x) for x in s.tValues],
        "p_values": [float(x) for x in s.pValues],
    }
    schema = T.StructType([
        T.StructField("dispersion", T.DoubleType()),
        T.StructField("null_deviance", T.DoubleType()),
        T.StructField("deviance", T.DoubleType()),
        T.StructField("residual_dof_null", T.LongType()),
        T.StructField("residual_dof", T.LongType()),
        T.StructField("aic", T.DoubleType()),
        T.StructField("coefficient_standard_errors", T.ArrayType(T.DoubleType())),
        T.StructField("t_values", T.ArrayType(T.DoubleType())),
        T.StructField("p_values", T.ArrayType(T.DoubleType())),
    ])
    return spark.createDataFrame([row], schema)


def gaussian_statistics(scored: DataFrame, label: str, n_features: int,
                        prediction: str = PREDICTION) -> DataFrame:
    """The scalar statistics of a gaussian/identity fit with an intercept, in
    one aggregate over its scored training rows: ``dispersion, null_deviance,
    deviance, residual_dof_null, residual_dof, aic``."""
    y, err = F.col(label), F.col(label) - F.col(prediction)
    s = scored.where(y.isNotNull()).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(err * err).alias("deviance"),
        (F.var_pop(y) * F.count(y)).alias("null_deviance"))
    dof = F.col("_n") - F.lit(n_features + 1)
    n = F.col("_n").cast("double")
    return s.select(
        F.try_divide(F.col("deviance"), dof.cast("double")).alias("dispersion"), "null_deviance", "deviance",
        (F.col("_n") - 1).alias("residual_dof_null"), dof.alias("residual_dof"),
        (n * (F.log(F.try_divide(F.col("deviance"), n) * F.lit(2.0) * F.pi()) + 1.0) + 2.0 + F.lit(2.0 * (n_features + 1))).alias("aic"))


INFERENCE = "feature string, coefficient double, standard_error double, t_value double, p_value double"


def gaussian_inference(df: DataFrame, label: str, features: tuple[str, ...] | list[str], reg_param: float = 0.0) -> DataFrame:
    """Coefficients of the gaussian/identity fit with an intercept, their standard
    errors, t and two-sided p values: one row per feature, then ``(intercept)``.

    All of it follows from the means and covariances, which one aggregate gives;
    the rest is algebra on a matrix of the features' number.  ``reg_param`` is the
    L2 penalty on standardised data, as ``glr`` takes it; the errors are then those
    of the penalised system, as Spark ML's summary has them.  A feature without
    variance has no coefficient of its own (0) and no error; without degrees of
    freedom all errors are NULL.
    """
    names = list(features)
    n, mean, cov = central_moments(df.where(F.col(f"`{label}`").isNotNull()), [*names, label])
    spark, d = df.sparkSession, len(names)
    if n == 0:
        raise ValueError("no labelled rows to fit")
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    live = np.flatnonzero(sd[:d] > 0)
    if not sd[d]:      # a constant label: the intercept alone
        live = live[:0]
    scale = sd[live]
    system = cov[np.ix_(live, live)] / np.outer(scale, scale) + (reg_param / sd[d] if sd[d] else 0.0) * np.eye(len(live))
    inverse = np.linalg.pinv(system)
    slope = np.zeros(d)
    slope[live] = inverse @ (cov[live, d] / scale) / scale
    intercept = mean[d] - slope @ mean[:d]
    deviance = max(n * (cov[d, d] - 2 * slope @ cov[:d, d] + slope @ cov[:d, :d] @ slope), 0.0)
    dof = n - d - 1
    centre = mean[live] / scale
    variance = np.full(d + 1, np.nan)
    variance[live] = np.diag(inverse) / (n * scale**2)
    variance[d] = (1 + centre @ inverse @ centre) / n
    rows = []
    for name, b, v in zip([*names, "(intercept)"], [*slope, intercept], variance):
        error = float(np.sqrt(deviance / dof * v)) if dof > 0 and np.isfinite(v) else None
        t = float(b) / error if error else None
        rows.append((name, float(b), error, t, two_sided(t, dof) if t is not None else None))
    return spark.createDataFrame(rows, INFERENCE)


def tree_summary(spark: SparkSession, fitted: FittedModel) -> DataFrame:
    """``technique, num_trees, depth, num_nodes, feature, importance``: one row
    per feature (depth and node count summed over the trees of an ensemble)."""
    learner = fitted.learner
    trees = learner.trees if hasattr(learner, "trees") else [learner]
    depth = max(t.depth for t in trees)
    nodes = sum(t.numNodes for t in trees)
    imp = learner.featureImportances.toArray()
    rows = [(fitted.technique, len(trees), depth, nodes, name, float(imp[i]))
            for i, name in enumerate(fitted.feature_names)]
    schema = T.StructType([
        T.StructField("technique", T.StringType(), False),
        T.StructField("num_trees", T.IntegerType(), False),
        T.StructField("depth", T.IntegerType(), False),
        T.StructField("num_nodes", T.IntegerType(), False),
        T.StructField("feature", T.StringType(), False),
        T.StructField("importance", T.DoubleType(), False),
    ])
    return spark.createDataFrame(rows, schema)


_IF = re.compile(r"If \(feature (\d+) <= ([-+.\dEe]+)\)")
_PREDICT = re.compile(r"Predict: ([-+.\dEe]+)")


def root_split(fitted: FittedModel) -> dict[str, float]:
    """Threshold and leaf predictions of the root split of a single tree
    whose root splits a continuous feature (depth-1 trees), from the model's
    own text."""
    text = fitted.learner.toDebugString
    split, leaves = _IF.search(text), _PREDICT.findall(text)
    if split is None or len(leaves) != 2:
        raise ValueError("not a depth-1 tree with a continuous split")
    return {"feature": int(split[1]), "threshold": float(split[2]), "left": float(leaves[0]), "right": float(leaves[1])}


def residuals(scored: DataFrame, label: str, prediction: str = PREDICTION,
              out: str = "residual") -> DataFrame:
    """Response residuals ``label - prediction`` (for the gaussian/identity GLR
    these equal the summary's deviance residuals)."""
    return scored.withColumn(out, F.col(label) - F.col(prediction))
