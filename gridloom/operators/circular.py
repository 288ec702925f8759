"""Circular statistics of a column of angles, by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import angles


def summary(df: DataFrame, a: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean, length, variance, z, p): direction, and Rayleigh's test against uniformity."""
    d = df.where(a.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), angles.mean_direction(a).alias("mean"), angles.resultant_length(a).alias("length"))
    z = F.col("n") * F.col("length") * F.col("length")
    return d.select(*by, "n", "mean", "length", (1 - F.col("length")).alias("variance"), z.alias("z"), angles.rayleigh_p(z, F.col("n")).alias("p"))


def linear_correlation(df: DataFrame, a: Column, x: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, r, p) of an angle with a number; p from the chi-square tail of n * r**2 with 2 degrees."""
    d = df.where(a.isNotNull() & x.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), angles.circular_linear_r(a, x).alias("r"))
    return d.select(*by, "n", "r", F.exp(-F.col("n") * F.col("r") * F.col("r") / 2).alias("p"))


def circular_correlation(df: DataFrame, a: Column, b: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, r, p) of two angles, about their mean directions.

    The means are joined back, one row for each group.
    """
    d = df.select(*by, a.alias("_a"), b.alias("_b")).where("_a is not null and _b is not null")
    means = d.groupBy(*by).agg(angles.mean_direction(F.col("_a")).alias("_ma"), angles.mean_direction(F.col("_b")).alias("_mb"))
    d = d.join(means, list(by)) if by else d.crossJoin(F.broadcast(means))
    sa, sb = F.sin(F.col("_a") - F.col("_ma")), F.sin(F.col("_b") - F.col("_mb"))
    m = d.groupBy(*by).agg(F.count("*").alias("n"), F.sum(sa * sb).alias("ab"), F.sum(sa * sa).alias("aa"), F.sum(sb * sb).alias("bb"), F.sum(sa * sa * sb * sb).alias("aabb"))
    r = F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb")))
    z = F.sqrt(F.try_divide(F.col("aa") * F.col("bb"), F.col("aabb"))) * r
    return m.select(*by, "n", r.alias("r"), angles.two_sided_p(z).alias("p"))


def basis(df: DataFrame, a: Column) -> DataFrame:
    """``df`` with the sine and cosine of the angle, for linear models."""
    return df.withColumns({"sin_a": F.sin(a), "cos_a": F.cos(a)})


def basis_fit(df: DataFrame, a: Column, y: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, amplitude, phase) of the least-squares fit of y by a constant, sine and cosine, from one pass of moments."""
    s, c = F.sin(a), F.cos(a)
    v = {"ss": F.var_pop(s), "cc": F.var_pop(c), "sc": F.covar_pop(s, c), "sy": F.covar_pop(s, y), "cy": F.covar_pop(c, y)}
    m = df.groupBy(*by).agg(*[e.alias(k) for k, e in v.items()])
    det = F.col("ss") * F.col("cc") - F.col("sc") * F.col("sc")
    bs = F.try_divide(F.col("sy") * F.col("cc") - F.col("cy") * F.col("sc"), det)
    bc = F.try_divide(F.col("cy") * F.col("ss") - F.col("sy") * F.col("sc"), det)
    return m.select(*by, F.sqrt(bs * bs + bc * bc).alias("amplitude"), F.atan2(bs, bc).alias("phase"))
