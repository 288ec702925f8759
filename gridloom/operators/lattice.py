"""Grid cells: autocorrelograms of rate maps, their peaks, and what the peaks say of a lattice."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.moments import CONSTANT
from .grid import Grid

#: Bins that two shifted maps have to share.
OVERLAP = 10


def autocorrelogram(rates: DataFrame, grid: Grid, overlap: int = OVERLAP) -> DataFrame:
    """(unit, dx, dy, r, n): correlation of a unit's map with itself shifted by dx and dy bins, over the n bins that both have.

    Shifts with fewer than ``overlap`` such bins have no row; r is null where either part is
    constant.  A unit's map is one small matrix, whose size is that of the grid.
    """
    nx, ny = grid.shape
    placed = rates.where("rate is not null").join(grid.small(grid.bins.select("bin_id", "ix", "iy")), "bin_id").select("unit", "ix", "iy", "rate")

    def shifts(rows: pd.DataFrame) -> pd.DataFrame:
        m, known = np.zeros((nx, ny)), np.zeros((nx, ny))
        m[rows["ix"], rows["iy"]], known[rows["ix"], rows["iy"]] = rows["rate"], 1.0
        scale = np.abs(m).max() or 1.0
        m /= scale
        size = (2 * nx, 2 * ny)
        over = lambda a, b: np.fft.irfft2(np.fft.rfft2(b, size) * np.conj(np.fft.rfft2(a, size)), size)
        n, s, q, p, t, u = over(known, known).round(), over(m, known), over(m * m, known), over(m, m), over(known, m), over(known, m * m)
        va, vb = n * q - s * s, n * u - t * t
        varies = (va > CONSTANT * n * n) & (vb > CONSTANT * n * n)
        r = np.where(varies, (n * p - s * t) / np.sqrt(np.where(varies, va * vb, 1.0)), np.nan)
        dx, dy = np.nonzero(n >= overlap)
        r, n = r[dx, dy], n[dx, dy]
        dx, dy = np.where(dx >= nx, dx - 2 * nx, dx), np.where(dy >= ny, dy - 2 * ny, dy)
        value = [None if math.isnan(x) else max(-1.0, min(1.0, x)) for x in r.tolist()]
        return pd.DataFrame({"unit": rows["unit"].iloc[0], "dx": dx, "dy": dy, "r": pd.Series(value, dtype=object), "n": n.astype(int)})

    schema = f"unit {rates.schema['unit'].dataType.simpleString()}, dx long, dy long, r double, n long"
    return placed.groupBy("unit").applyInPandas(shifts, schema)


def peaks(correlogram: DataFrame, shape: tuple[int, int], width: tuple[float, float], apart: int = 2, threshold: float = 0.1, center: float | None = None, most: int = 7) -> DataFrame:
    """(unit, place, dx, dy, x, y, distance, r): the peaks of each unit's correlogram, the nearest to the middle first.

    A peak is the largest within ``apart`` bins in both directions, above ``threshold`` times
    the correlogram's range, ``apart`` bins from its rim, and farther than ``center`` from its
    middle (a tenth of its smaller side, if not given).  At most ``most`` of a unit are kept.
    """
    nx, ny = shape
    center = 0.1 * min((2 * nx - 1) * width[0], (2 * ny - 1) * width[1]) if center is None else center
    known = correlogram.where("r is not null")
    steps = F.explode(F.sequence(F.lit(-apart), F.lit(apart)))
    # The largest around: along one axis, and of that along the other.
    along = known.withColumn("step", steps).select("unit", (F.col("dx") + F.col("step")).alias("dx"), "dy", "r").groupBy("unit", "dx", "dy").agg(F.max("r").alias("r"))
    around = along.withColumn("step", steps).select("unit", "dx", (F.col("dy") + F.col("step")).alias("dy"), "r").groupBy("unit", "dx", "dy").agg(F.max("r").alias("top"))
    whole = known.groupBy("unit").agg((F.max("r") - F.min("r")).alias("range"))
    d = known.join(around, ["unit", "dx", "dy"]).join(whole, "unit")
    inside = (F.abs("dx") < nx - apart) & (F.abs("dy") < ny - apart)
    x, y = F.col("dx") * width[0], F.col("dy") * width[1]
    d = d.where((F.col("r") >= F.col("top")) & (F.col("r") > threshold * F.col("range")) & inside).select("unit", "dx", "dy", x.alias("x"), y.alias("y"), F.sqrt(x * x + y * y).alias("distance"), "r")
    place = F.row_number().over(Window.partitionBy("unit").orderBy(F.round("distance", 9), "dx", "dy"))
    return d.where(F.col("distance") > center).withColumn("place", place).where(F.col("place") <= most).select("unit", "place", "dx", "dy", "x", "y", "distance", "r")


def grid_properties(found: DataFrame, n_peaks: int = 6, least: int = 3) -> DataFrame:
    """(unit, n_peaks, scale, orientation, orientation_std, major, minor) from ``peaks``; null for fewer than ``least``.

    scale is the median distance of the ``n_peaks`` nearest; orientation, in degrees from 0
    to 60, their mean direction where a sixth of a turn is none, with its circular deviation;
    major and minor the half axes of the ellipse whose spread they have.
    """
    d = found.where(F.col("place") <= n_peaks)
    six = 6 * F.atan2("y", "x")
    m = d.groupBy("unit").agg(
        F.count("*").alias("n_peaks"), F.expr("percentile(distance, 0.5)").alias("scale"), F.avg(F.sin(six)).alias("s"), F.avg(F.cos(six)).alias("c"),
        F.avg(F.col("x") * F.col("x")).alias("xx"), F.avg(F.col("y") * F.col("y")).alias("yy"), F.avg(F.col("x") * F.col("y")).alias("xy"),
    )
    length = F.least(F.lit(1.0), F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")))
    turn = F.degrees(F.atan2("s", "c") / 6)
    turn = F.when(F.round(turn, 9) < 0, turn + 60).otherwise(F.greatest(turn, F.lit(0.0)))
    spread = F.degrees(F.sqrt(F.greatest(F.lit(0.0), -2 * F.log(F.greatest(length, F.lit(1e-12))))) / 6)
    root = F.sqrt((F.col("xx") - F.col("yy")) * (F.col("xx") - F.col("yy")) / 4 + F.col("xy") * F.col("xy"))
    mid = (F.col("xx") + F.col("yy")) / 2
    enough = lambda v, name: F.when(F.col("n_peaks") >= least, v).alias(name)
    return m.select(
        "unit", "n_peaks", enough(F.col("scale"), "scale"), enough(turn, "orientation"), enough(spread, "orientation_std"),
        enough(F.sqrt(2 * (mid + root)), "major"), enough(F.sqrt(F.greatest(F.lit(0.0), 2 * (mid - root))), "minor"),
    )


def profile_peaks(profile: DataFrame, prominence: float = 0.1) -> DataFrame:
    """(unit, ring, r, prominence): the peaks of a profile (unit, ring, r), from its second ring on.

    A peak is above both its neighbours, and stands out by ``prominence`` times the profile's
    range: above the higher of the lowest places between it and the next higher ones on either
    side, or the profile's end.  A profile has as many rings as the arena has.
    """
    p = profile.where("r is not null")
    order = Window.partitionBy("unit").orderBy("ring")
    p = p.withColumn("k", F.row_number().over(order) - 1).where("k > 0")
    near = p.withColumns({"before": F.lag("r").over(order), "after": F.lead("r").over(order)})
    whole = p.groupBy("unit").agg((F.max("r") - F.min("r")).alias("range"), F.collect_list(F.struct("k", "r")).alias("all"))
    tops = near.where((F.col("r") > F.col("before")) & (F.col("r") > F.col("after"))).join(whole, "unit")
    # Where the profile is higher again, on either side.
    left = F.array_max(F.transform(F.filter("all", lambda o: (o["k"] < F.col("k")) & (o["r"] > F.col("r"))), lambda o: o["k"]))
    right = F.array_min(F.transform(F.filter("all", lambda o: (o["k"] > F.col("k")) & (o["r"] > F.col("r"))), lambda o: o["k"]))
    tops = tops.withColumns({"left": F.coalesce(left, F.lit(-1)), "right": F.coalesce(right, F.lit(1 << 30))})
    low = lambda keep: F.array_min(F.transform(F.filter("all", keep), lambda o: o["r"]))
    base = F.greatest(low(lambda o: (o["k"] <= F.col("k")) & (o["k"] > F.col("left"))), low(lambda o: (o["k"] >= F.col("k")) & (o["k"] < F.col("right"))))
    stands = tops.withColumn("prominence", F.col("r") - base)
    return stands.where(F.col("prominence") >= prominence * F.col("range")).select("unit", "ring", "r", "prominence")


def periodicity(profile: DataFrame, prominence: float = 0.1, least: int = 3) -> DataFrame:
    """(unit, n_peaks, score): 1 less the variation of the spacing of a profile's peaks, from 0 to 1; null for fewer than ``least`` peaks or 2 spacings."""
    order = Window.partitionBy("unit").orderBy("ring")
    d = profile_peaks(profile, prominence).withColumn("gap", F.col("ring") - F.lag("ring").over(order))
    m = d.groupBy("unit").agg(F.count("*").alias("n_peaks"), F.count("gap").alias("gaps"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("sd"), F.col("mean"))))
    m = profile.select("unit").distinct().join(m, "unit", "left")
    return m.select("unit", F.coalesce("n_peaks", F.lit(0)).alias("n_peaks"), F.when((F.col("n_peaks") >= least) & (F.col("gaps") >= 2), score).alias("score"))
