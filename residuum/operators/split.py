"""Holdout split (70/30 by default).

``hash`` (default) places a row by a hash of its key: the same row always
lands on the same side, whatever the partitioning, retries or executor losses,
and the assignment is a projection (no shuffle, no sampling job).  ``random``
draws a seeded number per row, as the reference does (unseeded there), and stores
it with the row: a draw hangs on the row's place in its partition, so computing
it again after a lost executor could move rows to the other side.

A NULL key has a place too (that of a fixed text), so no row is on neither
side, and any fraction is met to the resolution of the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .materialize import materialize, owns

NULL_KEY = "\u0000null"
_STEPS = 42949673          # hundredths of the 32-bit hash range, rounded up


def _first32(key: Column | str) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    text = F.coalesce(k.cast("string"), F.lit(NULL_KEY))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_bucket(key: Column | str) -> Column:
    """0..99 from the first 32 bits of md5(key as text)."""
    return _first32(key) % F.lit(100)


def hash_place(key: Column | str) -> Column:
    """A place in [0, 1): the bucket gives the hundredths, the rest of the 32
    bits what lies between them, so whole percents cut exactly at buckets."""
    h = _first32(key)
    between = F.floor(h / F.lit(100)).cast("double") / F.lit(float(_STEPS))
    return ((h % F.lit(100)).cast("double") + between) / F.lit(100.0)


PLACE = "_split_place"


def with_place(df: DataFrame, key: str) -> DataFrame:
    """Store the hash place as a column (before pinning a frame that many
    passes read, so md5 runs once per row, not once per pass)."""
    return df if PLACE in df.columns else df.withColumn(PLACE, hash_place(F.col(f"`{key}`")))


def with_random_place(df: DataFrame, seed: int, pin: str = "auto") -> DataFrame:
    """Draw a place in [0, 1) for every row and store the rows with it.  ``pin``
    is a way that outlives an executor: ``table`` or ``checkpoint``."""
    if pin not in ("auto", "table", "checkpoint"):
        raise ValueError("a random split must be stored: materialise='table' or 'checkpoint'")
    return materialize(df.drop(PLACE).withColumn(PLACE, F.rand(seed)), pin)


def train_flag(key: Column | str, train_fraction: float = 0.7,
               place: str | None = None) -> Column:
    """True for training rows; reads a stored place column when given."""
    p = F.col(place) if place else hash_place(key)
    return p < F.lit(float(train_fraction))


def require_rows(df: DataFrame, side: str, train_fraction: float) -> None:
    """Raise when a side of the split is empty (reads at most one row)."""
    if df.isEmpty():
        raise ValueError(f"train_fraction={train_fraction} leaves no rows for the {side} side")


def holdout_split(df: DataFrame, key: str, train_fraction: float = 0.7,
                  method: str = "hash", seed: int = 42,
                  check: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(train, holdout)``; ``check`` raises ``ValueError`` if either is empty.
    The sides of a ``random`` split read one stored frame, which both own; a
    frame that has a stored place already keeps it."""
    if not 0.0 < train_fraction < 1.0:
        raise ValueError("train_fraction must lie strictly between 0 and 1")
    if method not in ("hash", "random"):
        raise ValueError(f"unknown split method {method!r}; use 'hash' or 'random'")
    drawn = method == "random" and PLACE not in df.columns
    if drawn:
        df = with_random_place(df, seed)
    flag = train_flag(F.col(f"`{key}`"), train_fraction, PLACE if PLACE in df.columns else None)
    train, holdout = df.where(flag), df.where(~flag)
    if drawn:
        train, holdout = owns(train.drop(PLACE), df), owns(holdout.drop(PLACE), df)
    if check:
        require_rows(train, "training", train_fraction)
        require_rows(holdout, "holdout", train_fraction)
    return train, holdout
