"""Least squares by full-batch gradient descent, in Gram form.

Plain gradient descent on the mean squared error with step
``step / sqrt(t)`` only ever needs the data through two moments:

    gradient(w) = X'X/n . w - X'y/n

so the data is read a fixed number of times, whatever the iterations: up to
``NARROW`` columns by one aggregate of ``d(d+3)/2`` sums, beyond by Spark ML's
correlation matrix of one vector column (blocks in the JVM) with the columns'
means and deviations, ``X'X/n = cov + mean mean'``.  The iterations then run on
a d x d matrix.  This reproduces MLlib's full-batch ``LinearRegressionWithSGD``
(zero start, no intercept by default, stop once
``||w_t - w_{t-1}|| < tol * max(||w_t||, 1)`` from the second iteration on)
up to floating-point summation order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERCEPT = "__intercept__"
#: Up to so many columns the sums are separate aggregate expressions.
NARROW = 12


def central_moments(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, means and population covariances of some columns, over the
    rows where none is NULL, in one pass: up to ``NARROW`` columns one aggregate
    of mergeable central moments, beyond blocks of one vector column."""
    src = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).na.drop()
    d = len(cols)
    if d <= NARROW:
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        row = src.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(d)],
                      *[F.covar_pop(f"c{i}", f"c{j}").alias(f"v{i}_{j}") for i, j in pairs]).first()
        cov = np.zeros((d, d))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = row[f"v{i}_{j}"] or 0.0
        return int(row["n"]), np.array([row[f"m{i}"] or 0.0 for i in range(d)]), cov
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation, Summarizer

    vec = VectorAssembler(inputCols=src.columns, outputCol="_v").transform(src).select("_v")
    s = vec.select(Summarizer.metrics("count", "mean", "std").summary(F.col("_v")).alias("s")).first()["s"]
    n, mean, std = int(s["count"]), s["mean"].toArray(), s["std"].toArray()
    if n < 2:
        return n, mean, np.zeros((d, d))
    corr = np.nan_to_num(Correlation.corr(vec, "_v").first()[0].toArray())
    np.fill_diagonal(corr, 1.0)
    return n, mean, corr * np.outer(std, std) * (n - 1) / n


@dataclass
class GramLeastSquaresModel:
    features: tuple[str, ...]
    weights: np.ndarray
    intercept: float = 0.0
    iterations: int = 0
    loss_history: list[float] = field(default_factory=list)

    def predict_column(self) -> Column:
        expr = F.lit(float(self.intercept))
        for name, w in zip(self.features, self.weights):
            expr = expr + F.lit(float(w)) * F.col(f"`{name}`")
        return expr

    def transform(self, df: DataFrame, prediction_col: str = "prediction") -> DataFrame:
        return df.withColumn(prediction_col, self.predict_column())


@dataclass
class GramLeastSquares:
    features: tuple[str, ...]
    label: str
    iterations: int = 100
    step: float = 1.0
    tol: float = 0.001
    fit_intercept: bool = False

    def moments(self, df: DataFrame) -> tuple[int, np.ndarray, np.ndarray, float]:
        cols = list(self.features) + ([INTERCEPT] if self.fit_intercept else [])
        src = df.where(F.col(self.label).isNotNull())
        if self.fit_intercept:
            src = src.withColumn(INTERCEPT, F.lit(1.0))
        d = len(cols)
        if d > NARROW:
            return self._block_moments(src, cols)
        aggs = [F.count(F.lit(1)).alias("n"),
                F.avg(F.col(self.label) * F.col(self.label)).alias("yy")]
        for i in range(d):
            aggs.append(F.avg(F.col(cols[i]) * F.col(self.label)).alias(f"b{i}"))
            for j in range(i, d):
                aggs.append(F.avg(F.col(cols[i]) * F.col(cols[j])).alias(f"g{i}_{j}"))
        row = src.agg(*aggs).first()
        n = int(row["n"])
        b = np.array([row[f"b{i}"] or 0.0 for i in range(d)], dtype=float)
        g = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
        return n, g, b, float(row["yy"] or 0.0)

    def _block_moments(self, src: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray, float]:
        """The same moments for wide data, label included as a last column."""
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.stat import Correlation, Summarizer

        vec = VectorAssembler(inputCols=[*cols, self.label], outputCol="_xy").transform(src).select("_xy")
        s = vec.select(Summarizer.metrics("count", "mean", "std").summary(F.col("_xy")).alias("s")).first()["s"]
        n = int(s["count"])
        d = len(cols)
        if n == 0:
            return 0, np.zeros((d, d)), np.zeros(d), 0.0
        mean, std = s["mean"].toArray(), s["std"].toArray()
        if n > 1:
            # population covariances; a constant column has none (its correlations are NaN)
            corr = np.nan_to_num(Correlation.corr(vec, "_xy").first()[0].toArray())
            np.fill_diagonal(corr, 1.0)
            cov = corr * np.outer(std, std) * (n - 1) / n
        else:
            cov = np.zeros((d + 1, d + 1))
        second = cov + np.outer(mean, mean)
        return n, second[:d, :d], second[:d, d], float(second[d, d])

    def fit(self, df: DataFrame) -> GramLeastSquaresModel:
        n, g, b, yy = self.moments(df)
        w = np.zeros(len(b))
        if n == 0:
            raise ValueError("no labelled rows to fit")
        previous = current = None
        history: list[float] = []
        t = 1
        converged = False
        while not converged and t <= self.iterations:
            grad = g @ w - b
            history.append(float(0.5 * (w @ g @ w - 2.0 * (w @ b) + yy)))
            w = w - (self.step / np.sqrt(t)) * grad
            previous, current = current, w.copy()
            if previous is not None:
                diff = np.linalg.norm(previous - current)
                converged = diff < self.tol * max(np.linalg.norm(current), 1.0)
            t += 1
        if self.fit_intercept:
            return GramLeastSquaresModel(tuple(self.features), w[:-1], float(w[-1]),
                                         t - 1, history)
        return GramLeastSquaresModel(tuple(self.features), w, 0.0, t - 1, history)
