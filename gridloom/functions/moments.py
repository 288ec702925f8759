"""Aggregates of pairs of columns that give null where they are undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A column whose deviation is at most this share of its largest size counts as constant:
#: what is left of a constant after averaging in one order or another.
CONSTANT = 1e-9


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation over the rows where both are there; null where either is constant.

    Constant is told by a tolerance, so that the order in which Spark sums makes no
    difference, and nothing is divided by 0.
    """
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)

    def varies(c: Column) -> Column:
        return F.stddev_pop(c) > CONSTANT * F.max(F.abs(c))

    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(varies(a) & varies(b), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))


def correlation_sql(x: str, y: str) -> str:
    """The same in SQL, for columns that are both there."""
    varies = " AND ".join(f"stddev_pop({c}) > {CONSTANT} * max(abs({c}))" for c in (x, y))
    return f"CASE WHEN {varies} THEN corr({x}, {y}) END"
