"""Output precision of registered query results.

Two engines that sum the same doubles in a different order agree to ~1e-14
relative, not bit for bit.  Query outputs that are sums of doubles are
rounded to a precision far above that noise (and ``+ 0.0`` turns a rounded
``-0.0`` into ``0.0``), so results can be compared value by value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimals kept per metric.
DIGITS = {"rmse": 4, "pbias": 8, "cd": 10, "nse": 10, "mse": -1}


def rnd(c: Column | str, digits: int) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, digits) + F.lit(0.0)


def rnd_sql(expr: str, digits: int) -> str:
    return f"(round({expr}, {digits}) + 0.0)"
