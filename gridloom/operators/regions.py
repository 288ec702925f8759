"""Regions: named points and polygons, and which points and bins they hold.

``regions`` are a dict from name to a list of vertices, or to one point as a tuple; they
are drawn by hand, so there are few, and become column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry

Region = list[tuple[float, float]] | tuple[float, float]


def contains(x: Column, y: Column, region: Region, boundary: bool = True, tolerance: float = 1e-8) -> Column:
    """Whether a region holds a point; a point region holds those within ``tolerance`` on each axis."""
    if isinstance(region, tuple):
        return (F.abs(x - region[0]) <= tolerance) & (F.abs(y - region[1]) <= tolerance)
    return geometry.in_polygon(x, y, region, boundary)


def buffered(x: Column, y: Column, region: Region, reach: float) -> Column:
    """Whether a point lies within ``reach`` of a region, its corners rounded; a negative
    ``reach`` takes that much off a polygon, and leaves nothing of a point."""
    verts = [region] if isinstance(region, tuple) else list(region)
    gaps = []
    for (ax, ay), (bx, by) in zip(verts, [*verts[1:], verts[0]]):
        dx, dy = bx - ax, by - ay
        square = dx * dx + dy * dy
        along = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - ax) * dx + (y - ay) * dy) / square)) if square else F.lit(0.0)
        gaps.append(geometry.distance(x, y, ax + along * dx, ay + along * dy))
    gap = F.least(*gaps) if len(gaps) > 1 else gaps[0]
    inside = F.lit(False) if isinstance(region, tuple) else geometry.in_polygon(x, y, region, True)
    return inside & (gap >= -reach) if reach < 0 else inside | (gap <= reach)


def label_points(points: DataFrame, regions: dict[str, Region], boundary: bool = True) -> DataFrame:
    """``points`` with regions: the sorted names of those that hold each."""
    names = [F.when(contains(F.col("x"), F.col("y"), r, boundary), F.lit(n)) for n, r in sorted(regions.items())]
    return points.withColumn("regions", F.array_compact(F.array(*names)) if names else F.array().cast("array<string>"))


def membership(bins: DataFrame, regions: dict[str, Region], boundary: bool = False) -> DataFrame:
    """(region, bin_id) of the bins whose center a polygon holds; point regions have none."""
    polygons = {n: r for n, r in regions.items() if not isinstance(r, tuple)}
    return label_points(bins, polygons, boundary).select(F.explode("regions").alias("region"), "bin_id")


def to_dataframe(spark: SparkSession, regions: dict[str, Region]) -> DataFrame:
    """(name, kind, verts, area, x, y): area 0 for points; x, y is the center."""
    rows = []
    for name, r in sorted(regions.items()):
        point = isinstance(r, tuple)
        verts = [r] if point else r
        center = r if point else geometry.polygon_centroid(r)
        rows.append((name, "point" if point else "polygon", [(float(a), float(b)) for a, b in verts], 0.0 if point else geometry.polygon_area(r), *map(float, center)))
    return spark.createDataFrame(rows, "name string, kind string, verts array<struct<x: double, y: double>>, area double, x double, y double")


def from_dataframe(table: DataFrame) -> dict[str, Region]:
    out: dict[str, Region] = {}
    for r in table.select("name", "kind", "verts").collect():
        verts = [(v["x"], v["y"]) for v in r["verts"]]
        out[r["name"]] = verts[0] if r["kind"] == "point" else verts
    return out
