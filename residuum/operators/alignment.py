"""Key alignment of two relations (replacing positional zips).

``alignment_counts`` tags the keys of both sides and aggregates them per key;
partial aggregation runs map-side, so a key repeated on a third of all rows
still ships at most one partial row per task.  Keys are compared as they are,
column by column, and NULL is a key like any other: the check counts it and
the joins match it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Keys = str | list[str] | tuple[str, ...]


def _names(key: Keys) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _q(name: str):
    return F.col(f"`{name}`")


def alignment_counts(left: DataFrame, right: DataFrame, key: Keys,
                     right_key: Keys | None = None) -> DataFrame:
    """One row: ``n_left, n_right, n_matched_keys, n_left_only, n_right_only,
    n_duplicate_keys`` (keys seen more than once on either side)."""
    lk = _names(key)
    rk = _names(right_key) if right_key is not None else lk
    keys = [f"_k{i}" for i in range(len(lk))]
    tagged = (left.select(*[_q(c).alias(k) for c, k in zip(lk, keys)], F.lit(1).alias("_l"), F.lit(0).alias("_r"))
              .unionByName(right.select(*[_q(c).alias(k) for c, k in zip(rk, keys)],
                                        F.lit(0).alias("_l"), F.lit(1).alias("_r"))))
    per_key = tagged.groupBy(*keys).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    return per_key.agg(
        F.coalesce(F.sum("l"), F.lit(0)).cast("long").alias("n_left"),
        F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("n_right"),
        F.count(F.when((F.col("l") > 0) & (F.col("r") > 0), 1)).alias("n_matched_keys"),
        F.count(F.when(F.col("r") == 0, 1)).alias("n_left_only"),
        F.count(F.when(F.col("l") == 0, 1)).alias("n_right_only"),
        F.count(F.when((F.col("l") > 1) | (F.col("r") > 1), 1)).alias("n_duplicate_keys"),
    )


def assert_aligned(left: DataFrame, right: DataFrame, key: Keys,
                   right_key: Keys | None = None) -> None:
    """Raise unless both sides hold exactly the same keys, each once."""
    c = alignment_counts(left, right, key, right_key).first()
    if c["n_left_only"] or c["n_right_only"] or c["n_duplicate_keys"]:
        raise ValueError(
            "two relations are not aligned on their key: "
            f"{c['n_left_only']} keys only left, {c['n_right_only']} only right, "
            f"{c['n_duplicate_keys']} duplicated")


def null_safe_join(left: DataFrame, right: DataFrame, key: Keys, how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the keys come from the left."""
    names = _names(key)
    other = right.select(*[_q(c).alias(f"_o{i}") for i, c in enumerate(names)],
                         *[_q(c) for c in right.columns if c not in names])
    same = reduce(lambda a, b: a & b, [_q(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(names)])
    return left.join(other, same, how).drop(*[f"_o{i}" for i in range(len(names))])


def attach(df: DataFrame, other: DataFrame, key: Keys, check: bool = True) -> DataFrame:
    """Join per-row results (e.g. stored predictions) back on the key,
    after checking that every key is present exactly once on both sides."""
    if check:
        assert_aligned(df, other, key)
    return null_safe_join(df, other, key)


def attach_by_position(df: DataFrame, order_by: list[str] | tuple[str, ...],
                       values: DataFrame, pos: str = "pos",
                       partition_by: list[str] | tuple[str, ...] = (),
                       check: bool = True) -> DataFrame:
    """Attach values that arrive by position (e.g. a read-back prediction
    list: ``[series..., pos, value]``) to keyed rows: the rows are numbered
    0, 1, ... in ``order_by`` order within each series, the numbering is
    checked to cover every position exactly once, then both are joined on
    (series, position) - never zipped.  A NULL series is a series."""
    from .ordering import dense_index
    numbered = dense_index(df, order_by, partition_by, out="_pos_idx")
    keys = [*partition_by, "_pos_idx"]
    listed = values.withColumnRenamed(pos, "_pos_idx").withColumn("_pos_idx", F.col("_pos_idx").cast("long"))
    if check:
        assert_aligned(numbered, listed, keys)
    return null_safe_join(numbered, listed, keys).drop("_pos_idx")
