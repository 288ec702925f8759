"""Environments: space cut into bins joined by a neighbour graph.

``bins`` has a row for each active bin (bin_id, ix, iy, x, y, area) and ``edges`` both
directions of each link (src, dst, distance).  Their sizes depend on the arena and the bin
width alone, not on the samples, so the number of bins has a bound that is checked before
they are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import binning, geometry
from ..session import Scratch

#: Bins up to which their table goes to every task.
BROADCAST_BINS = 1_000_000


class Grid(NamedTuple):
    """A regular grid: active bins, their links, and what places a point in it."""

    bins: DataFrame
    edges: DataFrame
    lo: tuple[float, float]
    width: tuple[float, float]
    shape: tuple[int, int]

    @property
    def n_cells(self) -> int:
        return self.shape[0] * self.shape[1]

    def small(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if self.n_cells <= BROADCAST_BINS else table

    def cell(self, x: Column, y: Column) -> Column:
        """The flat cell of a point, active or not; null outside."""
        ix = binning.bin_index(x, self.lo[0], self.width[0], self.shape[0])
        iy = binning.bin_index(y, self.lo[1], self.width[1], self.shape[1])
        return ix * self.shape[1] + iy


def grid_edges(bins: DataFrame, diagonal: bool = True) -> DataFrame:
    """Links of neighbouring active bins, from an equi-join on shifted indices."""
    steps = [(1, 0), (0, 1), (-1, 0), (0, -1)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * diagonal
    shifts = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in steps]))
    here = bins.select(F.col("bin_id").alias("src"), "ix", "iy", F.col("x").alias("sx"), F.col("y").alias("sy"), shifts.alias("s"))
    here = here.select("src", "sx", "sy", (F.col("ix") + F.col("s.dx")).alias("ix"), (F.col("iy") + F.col("s.dy")).alias("iy"))
    found = here.join(bins.select(F.col("bin_id").alias("dst"), "ix", "iy", "x", "y"), ["ix", "iy"])
    distance = geometry.distance(F.col("sx"), F.col("sy"), F.col("x"), F.col("y"))
    return found.select("src", "dst", distance.alias("distance"))


def regular_grid(
    spark: SparkSession,
    lo: tuple[float, float],
    width: tuple[float, float],
    shape: tuple[int, int],
    samples: DataFrame | None = None,
    min_count: int = 1,
    diagonal: bool = True,
) -> Grid:
    """A grid over ``shape`` cells; with ``samples`` (x, y), cells of ``min_count`` of them are active.

    bin_id numbers active bins in the order of their cells.
    """
    cells = spark.range(shape[0] * shape[1]).select(
        F.col("id").alias("cell"),
        F.floor(F.col("id") / shape[1]).alias("ix"),
        F.pmod("id", F.lit(shape[1])).alias("iy"),
    )
    cells = cells.select(
        "cell", "ix", "iy",
        (lo[0] + (F.col("ix") + 0.5) * width[0]).alias("x"),
        (lo[1] + (F.col("iy") + 0.5) * width[1]).alias("y"),
        F.lit(width[0] * width[1]).alias("area"),
    )
    place = Grid(cells, cells, lo, width, shape)
    if samples is not None:
        seen = samples.groupBy(place.cell(F.col("x"), F.col("y")).alias("cell")).count()
        cells = cells.join(seen.where(F.col("count") >= min_count).select("cell"), "cell", "left_semi")
    bins = cells.withColumn("bin_id", F.row_number().over(Window.orderBy("cell")) - 1)
    bins = bins.select(F.col("bin_id").cast("long"), "cell", "ix", "iy", "x", "y", "area")
    if samples is not None:
        # Written once: every use of the bins would scan all samples anew.
        bins = Scratch(spark, "bins").keep("bins", bins)
    return place._replace(bins=bins, edges=grid_edges(bins, diagonal))


def fit_extent(samples: DataFrame, width: tuple[float, float]) -> tuple[tuple[float, float], tuple[int, int]]:
    """(lo, shape) of the smallest grid of that bin width over all samples (x, y)."""
    r = samples.agg(*[f(c).alias(f"{c}{k}") for c in "xy" for k, f in ((0, F.min), (1, F.max))]).first()
    if r["x0"] is None:
        raise ValueError("no samples to fit a grid to")
    shape = tuple(max(1, math.floor((r[f"{c}1"] - r[f"{c}0"]) / w) + 1) for c, w in zip("xy", width))
    return (r["x0"], r["y0"]), shape


def bin_at(points: DataFrame, grid: Grid, out: str = "bin_id", x: str = "x", y: str = "y") -> DataFrame:
    """``points`` with the active bin that holds each; -1 elsewhere."""
    known = grid.small(grid.bins.select(F.col("cell").alias("_cell"), F.col("bin_id").alias("_bin")))
    placed = points.withColumn("_at", grid.cell(F.col(x), F.col(y)))
    placed = placed.join(known, F.col("_at") == F.col("_cell"), "left")
    return placed.withColumn(out, F.coalesce("_bin", F.lit(-1))).drop("_at", "_cell", "_bin")


def boundary_bins(grid: Grid) -> DataFrame:
    """Active bins with an orthogonal neighbour that is inactive or outside."""
    near = grid_edges(grid.bins, diagonal=False).groupBy("src").count()
    found = grid.bins.join(near, F.col("bin_id") == F.col("src"), "left")
    return found.where(F.coalesce("count", F.lit(0)) < 4).select("bin_id")


def rebin(spark: SparkSession, grid: Grid, factor: int) -> Grid:
    """A coarser grid over whole groups of ``factor`` cells; all its cells are active."""
    shape = tuple(n // factor for n in grid.shape)
    return regular_grid(spark, grid.lo, tuple(w * factor for w in grid.width), shape)


def subset(grid: Grid, keep: Column) -> Grid:
    """The bins where ``keep`` (of their columns) holds, numbered anew, and the links among them."""
    bins = grid.bins.where(keep).withColumn("bin_id", F.row_number().over(Window.orderBy("cell")) - 1)
    bins = bins.withColumn("bin_id", F.col("bin_id").cast("long"))
    ids = bins.select("bin_id", "cell")
    old = grid.bins.select(F.col("bin_id").alias("old"), "cell").join(ids, "cell").select("old", "bin_id")
    edges = grid.edges.join(old.select(F.col("old").alias("src"), F.col("bin_id").alias("s")), "src")
    edges = edges.join(old.select(F.col("old").alias("dst"), F.col("bin_id").alias("d")), "dst")
    return grid._replace(bins=bins, edges=edges.select(F.col("s").alias("src"), F.col("d").alias("dst"), "distance"))


def transform(grid_bins: DataFrame, edges: DataFrame, matrix: Sequence[Sequence[float]]) -> tuple[DataFrame, DataFrame]:
    """Bins moved by an affine matrix, and their links with the new lengths."""
    x, y = geometry.affine(F.col("x"), F.col("y"), matrix)
    bins = grid_bins.withColumns({"x": x, "y": y})
    at = lambda k: bins.select(F.col("bin_id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    moved = edges.select("src", "dst").join(at("src"), "src").join(at("dst"), "dst")
    length = geometry.distance(F.col("srcx"), F.col("srcy"), F.col("dstx"), F.col("dsty"))
    return bins, moved.select("src", "dst", length.alias("distance"))


def polar_bins(spark: SparkSession, distances: tuple[float, float, int], n_angles: int) -> DataFrame:
    """Bins of an observer-centred polar grid: (bin_id, i_distance, i_angle, distance, angle, area)."""
    near, far, n = distances
    step, turn = (far - near) / n, 2 * math.pi / n_angles
    b = spark.range(n * n_angles).select(
        F.col("id").alias("bin_id"), F.floor(F.col("id") / n_angles).alias("i_distance"), F.pmod("id", F.lit(n_angles)).alias("i_angle")
    )
    r0 = near + F.col("i_distance") * step
    return b.select(
        "*", (r0 + step / 2).alias("distance"), ((F.col("i_angle") + 0.5) * turn - math.pi).alias("angle"),
        (0.5 * ((r0 + step) * (r0 + step) - r0 * r0) * turn).alias("area"),
    )


def track_bins(segments: DataFrame, bin_size: float) -> DataFrame:
    """Bins along the segments (segment, x0, y0, x1, y1) of a track, in segment order.

    Each segment is cut into equal bins of about ``bin_size``; position is the distance
    along the track.
    """
    length = geometry.distance(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    s = segments.withColumn("length", length).withColumn("n", F.greatest(F.lit(1), F.round(F.col("length") / bin_size).cast("int")))
    order = Window.orderBy("segment")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("before", before).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    share = (F.col("k") + 0.5) / F.col("n")
    b = s.select(
        "segment", "k", (F.col("x0") + share * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + share * (F.col("y1") - F.col("y0"))).alias("y"),
        (F.col("before") + share * F.col("length")).alias("position"), (F.col("length") / F.col("n")).alias("length"),
    )
    return b.withColumn("bin_id", (F.row_number().over(Window.orderBy("segment", "k")) - 1).cast("long"))


def union_environments(parts: Sequence[tuple[DataFrame, DataFrame]], bridges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Several environments as one: bins numbered on from each other, with ``bridges`` (src, dst, distance)."""
    offset, all_bins, all_edges = 0, [], []
    for k, (bins, edges) in enumerate(parts):
        all_bins.append(bins.withColumns({"bin_id": F.col("bin_id") + offset, "part": F.lit(k)}))
        all_edges.append(edges.select((F.col("src") + offset).alias("src"), (F.col("dst") + offset).alias("dst"), "distance"))
        offset += bins.count()
    if bridges is not None:
        all_edges.append(bridges.select("src", "dst", "distance"))
        all_edges.append(bridges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance"))
    bins, edges = all_bins[0], all_edges[0]
    for b in all_bins[1:]:
        bins = bins.unionByName(b)
    for e in all_edges[1:]:
        edges = edges.unionByName(e)
    return bins, edges


def mutual_nearest(a: DataFrame, b: DataFrame, max_distance: float) -> DataFrame:
    """Pairs (src, dst, distance) of bins that are each other's nearest, from cells of ``max_distance``."""
    cell = lambda c, d: (F.floor(F.col(c) / max_distance) + d).alias(f"c{c}")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = a.select(F.col("bin_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), "x", "y", steps.alias("s"))
    left = left.select("src", "ax", "ay", (F.floor(F.col("x") / max_distance) + F.col("s.i")).alias("cx"), (F.floor(F.col("y") / max_distance) + F.col("s.j")).alias("cy"))
    right = b.select(F.col("bin_id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x", 0), cell("y", 0))
    pairs = left.join(right, ["cx", "cy"]).withColumn("distance", geometry.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    pairs = pairs.where(F.col("distance") <= max_distance).select("src", "dst", "distance")
    nearest = lambda k, o: F.min_by(o, F.struct("distance", o)).over(Window.partitionBy(k))
    found = pairs.withColumns({"best_dst": nearest("src", "dst"), "best_src": nearest("dst", "src")})
    return found.where((F.col("dst") == F.col("best_dst")) & (F.col("src") == F.col("best_src"))).select("src", "dst", "distance")
