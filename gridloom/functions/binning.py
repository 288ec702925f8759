"""From coordinates to bins, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_index(x: Column, lo: float, width: float, n: int) -> Column:
    """The half-open bin of ``x``; null outside ``[lo, lo + n * width)``, and for NaN."""
    i = F.floor((x - lo) / width)
    return F.when(~F.isnan(x) & (i >= 0) & (i < n), i)


def closed_bin_index(x: Column, lo: float, width: float, n: int) -> Column:
    """As ``bin_index``, but the last bin holds its upper edge, as a histogram's does."""
    i = F.floor((x - lo) / width)
    return F.when(F.isnan(x), None).when(x == lo + n * width, F.lit(n - 1).cast("long")).when((i >= 0) & (i < n), i)


def hex_axial(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Axial coordinates of the pointy-top hexagon that holds a point; ``size`` is its radius."""
    q, r = (math.sqrt(3) / 3 * x - y / 3) / size, (2 / 3 * y) / size
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    col = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    row = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return col.cast("long"), row.cast("long")


def hex_center(q: Column, r: Column, size: float) -> tuple[Column, Column]:
    return size * math.sqrt(3) * (q + r / 2), size * 1.5 * r
