"""Goodness-of-fit aggregates as Column factories.

Every factory returns an aggregate ``Column`` so that any number of metrics,
for any number of series, run as one hash aggregate (partial per task, one
single-row final merge).  Only complete pairs count: a row whose simulated or
observed value is NULL is left out of every metric of that pair.  Division by
zero (empty input, constant series, zero-sum observations) yields NULL rather
than an error, also under ANSI mode.

Definitions (sim = simulated/predicted, obs = observed):

* RMSE   sqrt(mean((sim - obs)^2))
* PBIAS  100 * sum(sim - obs) / sum(obs)        (positive = over-prediction)
* CD     squared Pearson correlation of sim and obs
* NSE    1 - sum((sim - obs)^2) / sum((obs - mean(obs))^2)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("rmse", "pbias", "cd", "nse")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _pair(sim: Column | str, obs: Column | str) -> tuple[Column, Column]:
    """Both sides masked to the rows where both are present."""
    s, o = _c(sim), _c(obs)
    both = s.isNotNull() & o.isNotNull()
    return F.when(both, s), F.when(both, o)


def sse(sim: Column | str, obs: Column | str) -> Column:
    d = _c(sim) - _c(obs)
    return F.sum(d * d)


def mse(sim: Column | str, obs: Column | str) -> Column:
    d = _c(sim) - _c(obs)
    return F.avg(d * d)


def rmse(sim: Column | str, obs: Column | str) -> Column:
    return F.sqrt(mse(sim, obs))


def pbias(sim: Column | str, obs: Column | str) -> Column:
    s, o = _pair(sim, obs)
    return F.lit(100.0) * F.try_divide(F.sum(s - o), F.sum(o))


def cd(sim: Column | str, obs: Column | str) -> Column:
    s, o = _pair(sim, obs)
    r = F.try_divide(F.covar_pop(s, o), F.stddev_pop(s) * F.stddev_pop(o))
    return r * r


def nse(sim: Column | str, obs: Column | str) -> Column:
    s, o = _pair(sim, obs)
    sst = F.var_pop(o) * F.count(o)
    return F.lit(1.0) - F.try_divide(sse(s, o), sst)


FACTORIES = {"rmse": rmse, "pbias": pbias, "cd": cd, "nse": nse}


def metric_columns(sim: Column | str, obs: Column | str, prefix: str = "",
                   metrics: tuple[str, ...] = METRICS) -> list[Column]:
    """The chosen metrics of one (sim, obs) pair, aliased ``prefix + name``."""
    return [FACTORIES[m](sim, obs).alias(f"{prefix}{m}") for m in metrics]


def goodness_of_fit(df: DataFrame, sim: str, obs: str, *group_by: str) -> DataFrame:
    """RMSE, PBIAS, CD and NSE of ``sim`` against ``obs`` (optionally per group)."""
    cols = metric_columns(sim, obs)
    return df.groupBy(*group_by).agg(*cols) if group_by else df.agg(*cols)


def series_report(df: DataFrame, pairs: dict[str, tuple[str, str]],
                  *group_by: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Several (sim, obs) pairs measured in a single aggregate, returned as one
    row per series: ``[group..], series, rmse, pbias, cd, nse[, extra...]``.

    ``pairs`` maps a series name to its (sim, obs) columns, e.g. the reference's
    three-way report ``{"original": (predicted, observed), "improved":
    (improved, observed), "delta_error": (e_hat, delta_e)}``.  ``extra`` maps
    names to further aggregates computed in the same pass; they are repeated on
    every series row.
    """
    aggs = []
    for i, (_, (sim, obs)) in enumerate(pairs.items()):
        aggs += metric_columns(sim, obs, prefix=f"_s{i}_")
    extra = dict(extra or {})
    aggs += [c.alias(name) for name, c in extra.items()]
    wide = df.groupBy(*group_by).agg(*aggs) if group_by else df.agg(*aggs)
    rows = ", ".join(
        f"'{name}', " + ", ".join(f"_s{i}_{m}" for m in METRICS)
        for i, name in enumerate(pairs))
    stacked = f"stack({len(pairs)}, {rows}) AS (series, {', '.join(METRICS)})"
    return wide.selectExpr(*[f"`{g}`" for g in group_by], stacked,
                           *[f"`{name}`" for name in extra])
