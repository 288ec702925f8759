"""Angles in radians, and statistics over them, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .moments import correlation


def wrap(a: Column) -> Column:
    """Into [-pi, pi), by the steps that SQL takes, as they decide which end a half turn gets."""
    turn = 2 * math.pi
    return ((a + math.pi) % turn + turn) % turn - math.pi


def wrap_right(a: Column) -> Column:
    """Into (-pi, pi]."""
    return -wrap(-a)


def mean_direction(a: Column, w: Column | None = None) -> Column:
    """Circular mean, an aggregate; null without rows."""
    w = F.lit(1.0) if w is None else w
    return F.atan2(F.sum(w * F.sin(a)), F.sum(w * F.cos(a)))


def resultant_length(a: Column, w: Column | None = None) -> Column:
    """Length of the mean vector, an aggregate from 0 to 1."""
    w = F.lit(1.0) if w is None else w
    return F.sqrt(F.pow(F.sum(w * F.sin(a)), 2) + F.pow(F.sum(w * F.cos(a)), 2)) / F.nullif(F.sum(w), F.lit(0.0))


def rayleigh_p(z: Column, n: Column) -> Column:
    """p-value of Rayleigh's z; with a correction for fewer than 50 angles."""
    small = 1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z * z + 76 * F.pow(z, 3) - 9 * F.pow(z, 4)) / (288 * n * n)
    p = F.exp(-z) * F.when(n < 50, small).otherwise(1.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))


def circular_linear_r(a: Column, x: Column) -> Column:
    """Correlation of an angle with a number, an aggregate: from three plain correlations; null where either is constant."""
    rc, rs, cs = correlation(x, F.cos(a)), correlation(x, F.sin(a)), correlation(F.sin(a), F.cos(a))
    r2 = (rc * rc + rs * rs - 2 * rc * rs * cs) / F.when(F.abs(1 - cs * cs) > 1e-12, 1 - cs * cs)
    return F.when(r2.isNotNull(), F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), r2))))


def erf(x: Column) -> Column:
    """Error function to about 1.2e-7, for normal probabilities."""
    t = 1 / (1 + 0.5 * F.abs(x))
    #: Chebyshev fit of erfc.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = F.lit(k) + t * poly
    y = 1 - t * F.exp(-x * x + poly)
    return F.when(x >= 0, y).otherwise(-y)


def two_sided_p(z: Column) -> Column:
    return 1 - erf(F.abs(z) / math.sqrt(2))
