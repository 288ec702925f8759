"""Triangulated layouts: Delaunay triangles of scattered points, their links, and points placed in them.

A triangle belongs to the triangulation if no point lies in its circle.  With circles of at
most ``reach``, all that can lie in one is within twice that of each of its corners, so each
point decides on its own triangles from the points around it: a join on cells of that size,
and no triangulation is held as a whole anywhere.  Circles beyond ``reach`` are those across
gaps and along the rim; leaving them out is what makes the outline follow the points.

Of points on one circle any triangulation will do: points are lifted by their squares and a
minute draw by their ids, so that every task takes the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry

#: Of the square of ``reach``: what the lift of a point is drawn from, and how flat a triangle may be.
LIFT = 1e-9
FLAT = 1e-9



def lattice_points(spark: SparkSession, polygon: Sequence[tuple[float, float]], spacing: float) -> DataFrame:
    """(id, x, y) of a square lattice inside a polygon."""
    xs, ys = zip(*polygon)
    n = [int((max(v) - min(v)) // spacing) + 1 for v in (xs, ys)]
    p = spark.range(n[0] * n[1]).select(F.col("id"), (min(xs) + F.floor(F.col("id") / n[1]) * spacing).alias("x"), (min(ys) + F.pmod("id", F.lit(n[1])) * spacing).alias("y"))
    return p.where(geometry.in_polygon(F.col("x"), F.col("y"), polygon))


def _stars(reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for row in batch.to_pylist():
                near = sorted(row["near"], key=lambda p: p["id"])
                at = np.array([(p["x"] - row["x"], p["y"] - row["y"], p["lift"] - row["lift"]) for p in near]).reshape(-1, 3)
                # Around this point its own lift is 0.
                z = at[:, 0] ** 2 + at[:, 1] ** 2 + at[:, 2]
                later = [k for k, p in enumerate(near) if p["id"] > row["id"]]
                i, j = np.array([(a, b) for n, a in enumerate(later) for b in later[n + 1 :]], dtype=int).reshape(-1, 2).T
                (ax, ay), (bx, by), az, bz = at[i, :2].T, at[j, :2].T, z[i], z[j]
                det = ax * by - ay * bx
                good = np.abs(det) > FLAT * reach * reach
                i, j, ax, ay, bx, by, az, bz, det = (v[good] for v in (i, j, ax, ay, bx, by, az, bz, det))
                # The plane z = u x + w y through this point and both others; its circle has the center (u, w) / 2.
                u, w = (az * by - bz * ay) / det, (ax * bz - bx * az) / det
                small = np.hypot(u, w) / 2 <= reach
                i, j, u, w = (v[small] for v in (i, j, u, w))
                above = z[None, :] - u[:, None] * at[None, :, 0] - w[:, None] * at[None, :, 1]
                above[np.arange(len(i)), i] = above[np.arange(len(j)), j] = 1.0
                free = (above > 0).all(1)
                out += [(row["id"], near[a]["id"], near[b]["id"]) for a, b in zip(i[free], j[free])]
            ids = np.array(out, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in ids.T], names=["a", "b", "c"])

    return run


def delaunay(points: DataFrame, reach: float) -> DataFrame:
    """(a, b, c) with a < b < c of points (id, x, y): the triangles of circles of at most ``reach``.

    Ids are whole numbers; of points at the same place the smallest id counts.
    """
    lift = (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)) * (LIFT * reach * reach)
    p = points.groupBy("x", "y").agg(F.min("id").alias("id")).select(F.col("id").cast("long"), "x", "y", lift.alias("lift"))
    cell = lambda c: F.floor(F.col(c) / (2 * reach))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    here = p.select(F.struct("id", "x", "y", "lift").alias("p"), cell("x").alias("cx"), cell("y").alias("cy"), steps.alias("s"))
    here = here.select("p", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    there = p.select(F.struct("id", "x", "y", "lift").alias("q"), cell("x").alias("cx"), cell("y").alias("cy"))
    apart = geometry.distance(F.col("p.x"), F.col("p.y"), F.col("q.x"), F.col("q.y"))
    near = here.join(there, ["cx", "cy"]).where((F.col("p.id") != F.col("q.id")) & (apart <= 2 * reach))
    stars = near.groupBy("p").agg(F.collect_list("q").alias("near")).select("p.*", "near")
    return stars.mapInArrow(_stars(reach), "a long, b long, c long")


def mesh(points: DataFrame, reach: float, inside: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Bins and faces of the triangles of points (id, x, y) whose centers lie ``inside`` (of x, y).

    Bins are (bin_id, a, b, c, ax, ay, bx, by, cx, cy, x, y, area), numbered in the order of
    their corners; faces (src, dst, distance, face) are the sides that two bins share, and
    serve as links as well.
    """
    t = delaunay(points, reach)
    for k in "abc":
        t = t.join(points.select(F.col("id").cast("long").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")), k)
    area = F.abs((F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("cx") - F.col("ax")) * (F.col("by") - F.col("ay"))) / 2
    t = t.select("a", "b", "c", *[f"{k}{v}" for k in "abc" for v in "xy"], *[((F.col(f"a{v}") + F.col(f"b{v}") + F.col(f"c{v}")) / 3).alias(v) for v in "xy"], area.alias("area"))
    t = t if inside is None else t.where(inside)
    # As many as the arena has corners.
    bins = t.withColumn("bin_id", (F.row_number().over(Window.orderBy("a", "b", "c")) - 1).cast("long"))
    side = lambda i, j: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), geometry.distance(F.col(f"{i}x"), F.col(f"{i}y"), F.col(f"{j}x"), F.col(f"{j}y")).alias("face"))
    sides = bins.select("bin_id", "x", "y", F.explode(F.array(side("a", "b"), side("a", "c"), side("b", "c"))).alias("s")).select("bin_id", "x", "y", "s.*")
    other = sides.select(F.col("bin_id").alias("dst"), F.col("x").alias("ox"), F.col("y").alias("oy"), "i", "j")
    both = sides.join(other, ["i", "j"]).where("bin_id <> dst")
    faces = both.select(F.col("bin_id").alias("src"), "dst", geometry.distance(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")).alias("distance"), "face")
    return bins, faces


def skewed_share(bins: DataFrame, faces: DataFrame, degrees: float = 30.0) -> DataFrame:
    """(share): of sides that the line of centers meets farther than ``degrees`` from upright.

    Heat over a mesh of many such sides is only about right.
    """
    # The face's part that is upright to the line of centers, by the distance of the corners
    # that both share from that line.
    corner = lambda k: F.struct(F.col(k).alias("id"), F.col(f"{k}x").alias("x"), F.col(f"{k}y").alias("y"))
    of = lambda name: bins.select(F.col("bin_id").alias(name), F.array(*map(corner, "abc")).alias(f"{name}_c"), F.col("x").alias(f"{name}_x"), F.col("y").alias(f"{name}_y"))
    e = faces.where("src < dst").join(of("src"), "src").join(of("dst"), "dst").withColumn("shared", F.array_intersect("src_c", "dst_c"))
    dx, dy = F.col("dst_x") - F.col("src_x"), F.col("dst_y") - F.col("src_y")
    sx, sy = F.col("shared")[1]["x"] - F.col("shared")[0]["x"], F.col("shared")[1]["y"] - F.col("shared")[0]["y"]
    along = F.abs(dx * sx + dy * sy) / (F.col("distance") * F.col("face"))
    return e.agg(F.avg((along > math.sin(math.radians(degrees))).cast("double")).alias("share"))


def mesh_bin_at(points: DataFrame, bins: DataFrame, cell: float, out: str = "bin_id") -> DataFrame:
    """``points`` (x, y) with the triangle that holds each, the first of those that share a side it lies on; -1 elsewhere.

    Triangles are listed in all cells of size ``cell`` that their extents meet, and each cell's
    are one row that its points are joined to, so that points stay where they are.
    """
    corners = [f"{k}{v}" for k in "abc" for v in "xy"]
    ends = lambda v: (F.floor(F.least(*[F.col(f"{k}{v}") for k in "abc"]) / cell), F.floor(F.greatest(*[F.col(f"{k}{v}") for k in "abc"]) / cell))
    index = bins.select(F.struct(F.col("bin_id").alias("bin"), *corners).alias("_t"), F.explode(F.sequence(*ends("x"))).alias("_i"), F.sequence(*ends("y")).alias("_js"))
    index = index.select("_t", "_i", F.explode("_js").alias("_j")).groupBy("_i", "_j").agg(F.sort_array(F.collect_list("_t")).alias("_ts"))
    # As many cells as the arena's mesh meets, whatever the number of points.
    at = lambda v: F.floor(F.nullif(F.col(v), F.lit(float("nan"))) / cell)
    p = points.withColumns({"_i": at("x"), "_j": at("y")}).join(F.broadcast(index), ["_i", "_j"], "left")

    def within(t: Column) -> Column:
        cross = lambda i, j: (t[f"{j}x"] - t[f"{i}x"]) * (F.col("y") - t[f"{i}y"]) - (t[f"{j}y"] - t[f"{i}y"]) * (F.col("x") - t[f"{i}x"])
        sides = [cross("a", "b"), cross("b", "c"), cross("c", "a")]
        return (F.least(*sides) >= 0) | (F.greatest(*sides) <= 0)

    # A side is in two triangles at most, a corner in a few; the first in order has the least number.
    hit = F.get(F.filter("_ts", within), F.lit(0))["bin"]
    return p.select(*points.columns, F.coalesce(hit, F.lit(-1)).alias(out))
