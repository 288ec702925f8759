"""Outlines of masks: rings of cell sides with holes, traced by pointer jumping.

A side that two cells share lies inside, so sides that only one cell has are the outline; each
runs with its cell to the left.  Sides learn their ring and their place in it in as many joins
as the logarithm of the longest ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Sides run right, up, left and down: where each starts on its cell, and its step.
_STARTS, _STEPS = ((0, 0), (1, 0), (1, 1), (0, 1)), ((1, 0), (0, 1), (-1, 0), (0, -1))


def _of(values: tuple[tuple[int, int], ...], k: int, way: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v[k]) for v in values]), (way + 1).cast("int"))


def sides(mask: DataFrame, by: list[str]) -> DataFrame:
    """(*by, x, y, way): start and direction of the outline's sides, in cells."""
    cells = mask.where("ix is not null and iy is not null").select(*by, F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy")).distinct()
    around = [F.struct((F.col("ix") + s[0]).alias("x"), (F.col("iy") + s[1]).alias("y"), F.lit(way).alias("way")) for way, s in enumerate(_STARTS)]
    all_sides = cells.select(*by, F.explode(F.array(*around)).alias("s")).select(*by, "s.*")
    # Both runs of a shared side have one lower end and one axis.
    low = [F.least(F.col(c), F.col(c) + _of(_STEPS, k, F.col("way"))) for k, c in enumerate("xy")]
    single = all_sides.groupBy(*by, low[0].alias("_x"), low[1].alias("_y"), (F.col("way") % 2).alias("_axis")).agg(F.count("*").alias("n"), F.first("x").alias("x"), F.first("y").alias("y"), F.first("way").alias("way"))
    return single.where("n = 1").select(*by, "x", "y", "way")


def outlines(mask: DataFrame, lo: tuple[float, float], width: tuple[float, float], by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, x, y, hole, n_corners, length, area, verts): the rings around a mask's cells.

    ``mask``: (*by, ix, iy), rows of cells of a grid that begins at ``lo``; repeated rows count
    once, rows with a null in any of these not at all.  Cells that touch at a corner alone have
    rings of their own.  Outer rings run against the clock, holes with it,
    and areas of holes are negative, so that areas add up to the mask's.  ``verts`` are the
    corners in order from (x, y), the ring's leftmost and then lowest one.  A ring is collected
    as one row, as long as the arena's outline at most.  Runs jobs when it is called.
    """
    keys, kept = list(by), Scratch(mask.sparkSession, "outlines")
    e = sides(mask, keys).where(" and ".join([f"`{k}` is not null" for k in keys]) or "true")
    start = F.struct("x", "y", "way")
    ways = e.groupBy(*keys, "x", "y").agg(F.collect_list("way").alias("ways")).withColumnsRenamed({"x": "_x", "y": "_y"})
    ends = [F.col(c) + _of(_STEPS, k, F.col("way")) for k, c in enumerate("xy")]
    left = (F.col("way") + 1) % 4
    turn = F.when(F.array_contains("ways", left), left).otherwise(F.element_at("ways", 1))
    linked = e.withColumns({"_x": ends[0], "_y": ends[1]}).join(ways, [*keys, "_x", "_y"])
    linked = linked.select(*keys, start.alias("id"), F.struct(F.col("_x").alias("x"), F.col("_y").alias("y"), turn.alias("way")).alias("next"))
    linked = kept.keep("linked", linked)

    # The least side of a ring names it.
    d = linked.select(*keys, "id", F.col("next").alias("jump"), F.least("id", "next").alias("head"))
    for step in range(64):
        other = d.select(*keys, F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("head").alias("_head"))
        d = d.join(other, [*keys, "jump"]).select(*keys, "id", F.col("_jump").alias("jump"), F.least("head", "_head").alias("head"), (F.col("_head") < F.col("head")).alias("moved"))
        d = kept.keep(f"head{step}", d)
        if d.where("moved").isEmpty():
            break
    # Sides count how many are left to the end, which is before the head.
    r = linked.join(d.select(*keys, "id", "head"), [*keys, "id"])
    r = kept.keep("ring", r.select(*keys, "id", "head", "next", F.when(F.col("next") != F.col("head"), F.col("next")).alias("jump"), F.lit(1).cast("long").alias("ahead")))
    for step in range(64):
        other = r.select(*keys, F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("ahead").alias("_ahead"))
        r = r.join(other, [*keys, "jump"], "left").select(*keys, "id", "head", "next", F.col("_jump").alias("jump"), (F.col("ahead") + F.coalesce("_ahead", F.lit(0))).alias("ahead"))
        r = kept.keep(f"ring{step}", r)
        if r.where("jump is not null").isEmpty():
            break
    # A corner is where the next side starts another way.
    x, y = (F.lit(float(o)) + F.col(f"next.{c}") * F.lit(float(w)) for c, o, w in zip("xy", lo, width))
    cross = (F.col("id.x") * F.col("next.y") - F.col("id.y") * F.col("next.x")) / 2
    side = F.when(F.col("id.way") % 2 == 0, float(width[0])).otherwise(float(width[1]))
    corner = F.when(F.col("id.way") != F.col("next.way"), F.struct(F.when(F.col("next") == F.col("head"), 0).otherwise(-F.col("ahead") + 1).alias("place"), (F.col("next") != F.col("head")).alias("later"), x.alias("x"), y.alias("y")))
    found = r.groupBy(*keys, "head").agg(F.sum(cross).alias("cells"), F.sum(side).alias("length"), F.collect_list(corner).alias("corners"))
    ordered = F.sort_array(F.transform("corners", lambda c: F.struct(c["later"], c["place"], c["x"], c["y"])))
    verts = F.transform(ordered, lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))
    out = found.withColumn("verts", verts)
    return out.select(*keys, F.col("verts")[0]["x"].alias("x"), F.col("verts")[0]["y"].alias("y"), (F.col("cells") < 0).alias("hole"), F.size("verts").alias("n_corners"), "length", (F.col("cells") * float(width[0] * width[1])).alias("area"), "verts")
