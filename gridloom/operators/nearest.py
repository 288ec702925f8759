"""The nearest bin of every point, however far it is, by cells of doubling size.

Bins are listed in cells of about one bin each, and in those of twice, four times ... the
size.  A place's cell takes the smallest size at which it or one of its eight neighbours
holds a bin.  The nearest of the bins there is the nearest of all if it is no farther than
one such cell; else the nearest of all is among the nine cells of four times the size.
Which size a cell takes is found for the cells in which there are points, not for points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Doublings at most: beyond them a point is farther than any number can tell.
LEVELS = 60


def _shifted(c: Column, level: Column) -> Column:
    """A cell's index among those that are 2**level times as large."""
    return F.floor(c / F.pow(F.lit(2.0), level)).cast("long")


def _around(bins: DataFrame, levels: list[int]) -> DataFrame:
    """Bins (_bin, _x, _y) in their cell (_level, _cx, _cy) and its neighbours, for some levels."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    b = bins.withColumn("_level", F.explode(F.array(*map(F.lit, levels))))
    b = b.select("_bin", "_x", "_y", "_level", _shifted(F.col("_cx"), F.col("_level")).alias("_cx"), _shifted(F.col("_cy"), F.col("_level")).alias("_cy"), steps.alias("s"))
    return b.select("_bin", "_x", "_y", "_level", (F.col("_cx") + F.col("s.i")).alias("_cx"), (F.col("_cy") + F.col("s.j")).alias("_cy"))


def nearest_bin(points: DataFrame, bins: DataFrame, out: str = "bin_id") -> DataFrame:
    """``points`` (x, y) with the bin (bin_id, x, y) whose center is nearest, the smallest id of equally near ones.

    -1 for a point without finite coordinates, and where there are no bins.
    """
    spark = points.sparkSession
    extent = bins.agg(*[f(c).alias(f"{k}{c}") for c in "xy" for k, f in (("l", F.min), ("h", F.max))], F.count("*").alias("n")).first()
    if not extent.n:
        return points.withColumn(out, F.lit(-1).cast("long"))
    w, h = extent.hx - extent.lx, extent.hy - extent.ly
    size = max(math.sqrt(w * h / extent.n), w / extent.n, h / extent.n) or 1.0
    cell = lambda x, y: (F.floor((x - extent.lx) / size).cast("long"), F.floor((y - extent.ly) / size).cast("long"))
    named = bins.select(F.col("bin_id").alias("_bin"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    cx, cy = cell(F.col("_x"), F.col("_y"))
    named = named.withColumns({"_cx": cx, "_cy": cy})
    finite = F.coalesce((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")), F.lit(False))
    px, py = cell(F.when(finite, F.col("x")), F.when(finite, F.col("y")))
    p = points.select(F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_p"), F.monotonically_increasing_id().alias("_row"), F.col("x").alias("_px"), F.col("y").alias("_py"), px.alias("_ux"), py.alias("_uy"))

    scratch = Scratch(spark, "nearest")
    open_cells = p.where("_ux is not null and _uy is not null").select("_ux", "_uy").distinct()
    levels, k = None, 0
    while k < LEVELS and (k == 0 or not open_cells.isEmpty()):
        held = _around(named, [k]).select("_cx", "_cy").distinct()
        at = open_cells.select("_ux", "_uy", _shifted(F.col("_ux"), F.lit(k)).alias("_cx"), _shifted(F.col("_uy"), F.lit(k)).alias("_cy"))
        # Each round is written, so that the cells left over are not searched for again.
        both = scratch.keep(f"level-{k}", at.join(held.withColumn("_held", F.lit(True)), ["_cx", "_cy"], "left").select("_ux", "_uy", F.coalesce("_held", F.lit(False)).alias("_held")))
        found = both.where("_held").select("_ux", "_uy", F.lit(k).alias("_level"))
        levels = found if levels is None else levels.union(found)
        open_cells = both.where("not _held").select("_ux", "_uy")
        k += 1
    used = list(range(k))
    apart = F.sqrt((F.col("_px") - F.col("_x")) * (F.col("_px") - F.col("_x")) + (F.col("_py") - F.col("_y")) * (F.col("_py") - F.col("_y")))
    best = F.min(F.when(F.col("_bin").isNotNull(), F.struct(F.round(apart, 9).alias("d"), F.col("_bin").alias("bin"))))

    def among(rows: DataFrame, level: Column, index: DataFrame) -> DataFrame:
        at = rows.withColumns({"_level": level, "_cx": _shifted(F.col("_ux"), level), "_cy": _shifted(F.col("_uy"), level)})
        return at.join(index, ["_level", "_cx", "_cy"], "left").groupBy("_row").agg(F.first("_p").alias("_p"), best.alias("_best"), *[F.first(c).alias(c) for c in ("_px", "_py", "_ux", "_uy", "_own")])

    placed = p.join(levels.withColumnRenamed("_level", "_own"), ["_ux", "_uy"], "left")
    first = among(placed, F.col("_own"), _around(named, used))
    sure = F.col("_own").isNull() | (F.col("_best.d") <= F.pow(F.lit(2.0), F.col("_own")) * size)
    second = among(first.where(~sure).drop("_best"), F.col("_own") + 2, _around(named, [k + 2 for k in used]))
    done = first.where(sure).select("_p", "_best").union(second.select("_p", "_best"))
    return done.select("_p.*", F.coalesce("_best.bin", F.lit(-1)).alias(out))
