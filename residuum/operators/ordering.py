"""Ordered views of a series: dense position index, previews, first row and
label lookup.

``dense_index`` numbers the rows of each series 0, 1, 2 ... in key order
without ever placing a whole series in one task and with one shuffle of the
data.  Rows are range-partitioned on ``(series..., order...)`` and sorted, so a
huge series spans many partitions.  They are counted inside the partition by a
function that sees one number per row, the hash of its series; no other column
leaves the JVM.  Only the first series of a partition can go on from an earlier
partition: each partition's first and last series with their row counts give the
number that its first series starts from.  These numbers, one a partition, are one
array constant of the expression, looked up by the partition's number, so neither
the rows move again nor does the plan grow with the cluster.

The range-partitioned frame is pinned before it is read twice: range bounds
come from a sample and row order after a shuffle is not fixed, so two
evaluations of the same lazy frame could disagree about which row sits where.
Ties in the order are broken by the remaining columns, so equal rows are the
only ones whose numbers could be exchanged, and a tied group may span
partitions too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .materialize import materialize, owns

_ORDERABLE = ("map", "variant", "void", "udt", "interval")


def _ties(df: DataFrame, keys: list[str]) -> list[Column]:
    """The other columns that can be ordered, as tie-breakers."""
    return [F.col(f"`{c}`") for c, kind in df.dtypes
            if c not in keys and not any(k in kind for k in _ORDERABLE) and kind != "vector"]


def dense_index(df: DataFrame, order_by: list[str] | tuple[str, ...],
                partition_by: list[str] | tuple[str, ...] = (), out: str = "idx",
                num_partitions: int | None = None, pin: str = "auto") -> DataFrame:
    """Add ``out`` = 0-based position of the row within its series
    (``partition_by``) in ``order_by`` order.

    Without ``num_partitions`` the partitions are sized by adaptive execution.
    """
    keys = [F.col(f"`{c}`") for c in (*partition_by, *order_by)]
    order = keys + _ties(df, [*partition_by, *order_by])
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    # a series as one value; NULL is a series of its own
    own = [F.col(f"`{c}`") for c in partition_by]
    series = F.xxhash64(*own, *[c.isNull() for c in own]) if own else F.lit(0).cast("long")
    placed = (ranged.sortWithinPartitions(*order).withColumn("_series", series).withColumn("_part", F.spark_partition_id())
              .withColumn("_at", F.monotonically_increasing_id()).withColumn("_number", _number(F.col("_series"))))
    own_columns = [F.col(f"`{c}`") for c in df.columns]
    numbered = materialize(placed, pin)
    local, first = F.col("_number.local"), F.col("_number.first")
    base = _starting(begins(_ends(numbered)))
    return owns(numbered.select(*own_columns, (local + F.when(first, base).otherwise(F.lit(0))).alias(out)), numbered)


def _starting(begins: DataFrame) -> Column:
    """The number of the first series by ``_part``; at most one row a partition
    comes to the driver."""
    rows = begins.collect()
    if not rows:
        return F.lit(0).cast("long")
    table = np.zeros(max(r["_part"] for r in rows) + 1, np.int64)
    for r in rows:
        table[r["_part"]] = r["_begin"]
    return F.coalesce(F.get(F.lit(table), F.col("_part")), F.lit(0).cast("long"))


def _count_series(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Rows of each series so far, in the order of a partition's rows, and
    whether a row belongs to the partition's first series."""
    last, count, leading = None, 0, True
    for series in batches:
        key, n = series.to_numpy(), len(series)
        if not n:
            yield pd.DataFrame({"first": np.zeros(0, bool), "local": np.zeros(0, np.int64)})
            continue
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = last is not None and key[0] != last
        run = np.cumsum(new)                      # 0: the series goes on from the batch before
        starts = np.concatenate([[-count], np.flatnonzero(new)])
        local = np.arange(n) - starts[run]
        first = (run == 0) & leading
        leading = leading and not new.any()
        last, count = key[-1], int(local[-1]) + 1
        yield pd.DataFrame({"first": first, "local": local})


def _number(series: Column) -> Column:
    """``first, local`` of every row of a sorted partition."""
    return F.pandas_udf(_count_series, "first boolean, local long").asNondeterministic()(series)


def _ends(numbered: DataFrame) -> DataFrame:
    """Per partition the first and the last series and the rows of the last:
    ``_part, first, last, n``."""
    return numbered.groupBy("_part").agg(
        F.min_by("_series", "_at").alias("first"), F.max_by("_series", "_at").alias("last"), (F.max_by("_number.local", "_at") + 1).alias("n"))


def begins(ends: DataFrame) -> DataFrame:
    """``_part, _begin``: the number from which each partition's first series
    goes on, that is, its rows in the earlier partitions that end with it."""
    rows = ends.select("_part", F.inline(F.array(
        F.struct(F.col("first").alias("s"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("n")),
        F.struct(F.col("last").alias("s"), F.lit(1).alias("_kind"), F.col("n").alias("n")))))
    before = Window.partitionBy("s").orderBy("_part", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_begin", F.sum("n").over(before)).filter("_kind = 0 and _begin > 0").select("_part", "_begin")


def preview(df: DataFrame, order_by: list[str] | tuple[str, ...], n: int = 20) -> DataFrame:
    """The first ``n`` rows in key order (a top-n: each task keeps n rows)."""
    return df.orderBy(*[F.col(f"`{c}`") for c in order_by]).limit(n)


def first_row(df: DataFrame, order_by: list[str] | tuple[str, ...]) -> DataFrame:
    return preview(df, order_by, 1)


def lookup(df: DataFrame, where: Column, select: list[str], order_by: list[str],
           as_json: str | None = "json") -> DataFrame:
    """First row (in key order) matching ``where``, projected to ``select``;
    with ``as_json`` the projection is returned as one JSON text column, its
    NULL members included."""
    found = first_row(df.where(where), order_by).select(*select)
    if as_json:
        return found.select(F.to_json(F.struct(*select), {"ignoreNullFields": "false"}).alias(as_json))
    return found
