"""Links of hexagons and polar bins, masked and polygonal grids, tracks as lines, and ways between bins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import binning, geometry
from ..session import Scratch
from .grid import Grid, grid_edges, regular_grid


def _numbered(cells: DataFrame, *order: str) -> DataFrame:
    """``cells`` with bin_id in the order of their columns; their number depends on the arena alone."""
    return cells.withColumn("bin_id", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def _linked(bins: DataFrame, keys: tuple[str, str], steps: Sequence[tuple[int, int]], wrap: int | None = None) -> DataFrame:
    """(src, dst) of bins that are ``steps`` of the two keys apart; the second key goes round at ``wrap``."""
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps]))
    second = F.col(keys[1]) + F.col("s.b")
    here = bins.select(F.col("bin_id").alias("src"), *keys, moves.alias("s"))
    here = here.select("src", (F.col(keys[0]) + F.col("s.a")).alias(keys[0]), (second if wrap is None else F.pmod(second, F.lit(wrap))).alias(keys[1]))
    return here.join(bins.select(F.col("bin_id").alias("dst"), *keys), list(keys)).where("src <> dst").select("src", "dst").distinct()


def _with_distance(links: DataFrame, bins: DataFrame) -> DataFrame:
    at = lambda k: bins.select(F.col("bin_id").alias(k), F.col("x").alias(f"{k}_x"), F.col("y").alias(f"{k}_y"))
    length = geometry.distance(F.col("src_x"), F.col("src_y"), F.col("dst_x"), F.col("dst_y"))
    return links.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", length.alias("distance"))


def hex_environment(samples: DataFrame, size: float, min_count: int = 1) -> tuple[DataFrame, DataFrame]:
    """Bins (bin_id, q, r, x, y, area) of the hexagons of radius ``size`` with ``min_count`` samples, and their links."""
    q, r = binning.hex_axial(F.col("x"), F.col("y"), size)
    seen = samples.select(q.alias("q"), r.alias("r")).groupBy("q", "r").count().where(F.col("count") >= min_count)
    x, y = binning.hex_center(F.col("q"), F.col("r"), size)
    bins = _numbered(seen.select("q", "r", x.alias("x"), y.alias("y"), F.lit(1.5 * math.sqrt(3) * size * size).alias("area")), "r", "q")
    return bins, _with_distance(_linked(bins, ("q", "r"), [(1, 0), (0, 1), (-1, 0), (0, -1), (1, -1), (-1, 1)]), bins)


def hex_counts(samples: DataFrame, bins: DataFrame, size: float) -> DataFrame:
    """(bin_id, v): samples in each bin of ``hex_environment``."""
    q, r = binning.hex_axial(F.col("x"), F.col("y"), size)
    seen = samples.select(q.alias("q"), r.alias("r")).groupBy("q", "r").agg(F.count("*").cast("double").alias("v"))
    return bins.select("bin_id", "q", "r").join(seen, ["q", "r"]).select("bin_id", "v")


def polar_edges(bins: DataFrame, n_angles: int) -> DataFrame:
    """(src, dst, distance) of ``polar_bins``: rings next to each other, and angles round the seam along their arc."""
    links = _linked(bins, ("i_distance", "i_angle"), [(1, 0), (-1, 0), (0, 1), (0, -1)], n_angles)
    at = lambda k: bins.select(F.col("bin_id").alias(k), F.col("distance").alias(f"{k}_r"), F.col("i_angle").alias(f"{k}_i"))
    d = links.join(at("src"), "src").join(at("dst"), "dst")
    length = F.when(F.col("src_i") == F.col("dst_i"), F.abs(F.col("src_r") - F.col("dst_r"))).otherwise(F.col("src_r") * (2 * math.pi / n_angles))
    return d.select("src", "dst", length.alias("distance"))


def polar_bin(distance: Column, angle: Column, distances: tuple[float, float, int], n_angles: int) -> Column:
    """The bin of ``polar_bins`` that holds a distance and a bearing; -1 nearer or farther than all."""
    near, far, n = distances
    ring = binning.bin_index(distance, near, (far - near) / n, n)
    turn = F.pmod(F.floor((angle + math.pi) / (2 * math.pi / n_angles)), F.lit(n_angles))
    return F.coalesce(ring * n_angles + turn, F.lit(-1))


def masked_grid(spark: SparkSession, lo: tuple[float, float], width: tuple[float, float], shape: tuple[int, int], mask: DataFrame, diagonal: bool = True) -> Grid:
    """A grid whose active cells ``mask`` (ix, iy, active) names, as those of an image do."""
    whole = regular_grid(spark, lo, width, shape)
    kept = whole.bins.join(mask.where("active").select("ix", "iy").distinct(), ["ix", "iy"], "left_semi")
    return _active(whole, kept, diagonal)


def polygon_grid(spark: SparkSession, polygon: Sequence[tuple[float, float]], width: tuple[float, float], holes: Sequence[Sequence[tuple[float, float]]] = (), diagonal: bool = True) -> Grid:
    """A grid over a polygon's extent whose cells are active where their center lies inside and in no hole."""
    xs, ys = zip(*polygon)
    shape = tuple(max(1, math.ceil((max(v) - min(v)) / w - 1e-9)) for v, w in zip((xs, ys), width))
    whole = regular_grid(spark, (float(min(xs)), float(min(ys))), width, shape)
    inside = geometry.in_polygon(F.col("x"), F.col("y"), polygon)
    for hole in holes:
        inside = inside & ~geometry.in_polygon(F.col("x"), F.col("y"), hole)
    # Written once: each use of the bins would go through the polygon's sides anew.
    return _active(whole, Scratch(spark, "bins").keep("inside", whole.bins.where(inside)), diagonal)


def corridor_grid(spark: SparkSession, segments: DataFrame, corridor: float, width: tuple[float, float], diagonal: bool = True) -> Grid:
    """A grid over a maze (segments): cells are active whose center is within half a ``corridor`` of one of them."""
    r = segments.agg(*[f(F.least(f"{c}0", f"{c}1") if f is F.min else F.greatest(f"{c}0", f"{c}1")).alias(f"{c}_{f.__name__}") for c in "xy" for f in (F.min, F.max)]).first()
    lo = tuple(r[f"{c}_min"] - corridor / 2 for c in "xy")
    shape = tuple(max(1, math.ceil((r[f"{c}_max"] + corridor / 2 - a) / w - 1e-9)) for c, a, w in zip("xy", lo, width))
    whole = regular_grid(spark, lo, width, shape)
    near = to_linear(whole.bins, segments).where(F.col("offset") <= corridor / 2 + 1e-9)
    return _active(whole, near.select(*whole.bins.columns), diagonal)


def _active(whole: Grid, kept: DataFrame, diagonal: bool) -> Grid:
    bins = _numbered(kept, "cell").select("bin_id", "cell", "ix", "iy", "x", "y", "area")
    return whole._replace(bins=bins, edges=grid_edges(bins, diagonal))


def full_grid_values(field: DataFrame, grid: Grid) -> DataFrame:
    """(ix, iy, v) of every cell of the grid, active or not; null where inactive."""
    spark = grid.bins.sparkSession
    cells = spark.range(grid.n_cells).select(F.col("id").alias("cell"), F.floor(F.col("id") / grid.shape[1]).alias("ix"), F.pmod("id", F.lit(grid.shape[1])).alias("iy"))
    return cells.join(grid.bins.select("cell", "bin_id"), "cell", "left").join(field.select("bin_id", "v"), "bin_id", "left").select("ix", "iy", "v")


def track_edges(bins: DataFrame, tolerance: float) -> DataFrame:
    """(src, dst, distance) of ``track_bins``: neighbours on a segment, and the end bins that meet where segments join.

    Bins of two segments meet where their ends are no farther than half of both lengths and
    ``tolerance`` apart.
    """
    here = bins.select("segment", "k", F.col("bin_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("length").alias("al"))
    there = bins.select(F.col("segment").alias("seg"), F.col("k").alias("j"), F.col("bin_id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("length").alias("bl"))
    apart = geometry.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    along = here.join(there, (F.col("segment") == F.col("seg")) & (F.col("j") == F.col("k") + 1)).select("src", "dst", apart.alias("distance"))
    last = F.max("k").over(Window.partitionBy("segment"))
    ends = bins.withColumn("_last", last).where("k = 0 or k = _last").select("bin_id")
    a, b = here.join(ends.withColumnRenamed("bin_id", "src"), "src"), there.join(ends.withColumnRenamed("bin_id", "dst"), "dst")
    # Ends of segments are drawn by hand and few.
    across = a.join(b, F.col("segment") < F.col("seg")).withColumn("distance", apart)
    across = across.where(F.col("distance") <= (F.col("al") + F.col("bl")) / 2 + tolerance).select("src", "dst", "distance")
    one_way = along.union(across)
    return one_way.union(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")).distinct()


def _segments_as_array(segments: DataFrame) -> Column:
    """The segments with the length before each, as one constant; they are few and drawn by hand."""
    before, out = 0.0, []
    for s in segments.orderBy("segment").collect():
        length = math.hypot(s["x1"] - s["x0"], s["y1"] - s["y0"])
        values = {"x0": s["x0"], "y0": s["y0"], "dx": s["x1"] - s["x0"], "dy": s["y1"] - s["y0"], "length": length, "before": before}
        out.append(F.struct(F.lit(s["segment"]).alias("segment"), *[F.lit(float(v)).alias(k) for k, v in values.items()]))
        before += length
    return F.array(*out)


def to_linear(points: DataFrame, segments: DataFrame) -> DataFrame:
    """``points`` (x, y) with segment, position along the track and offset: of the nearest place on it, the first of equal ones."""

    def nearest(s: Column) -> Column:
        square = s["length"] * s["length"]
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide((F.col("x") - s["x0"]) * s["dx"] + (F.col("y") - s["y0"]) * s["dy"], square), F.lit(0.0))))
        off = geometry.distance(F.col("x"), F.col("y"), s["x0"] + share * s["dx"], s["y0"] + share * s["dy"])
        return F.struct(off.alias("offset"), s["segment"].alias("segment"), (s["before"] + share * s["length"]).alias("position"))

    found = points.withColumn("_on", F.array_min(F.transform(_segments_as_array(segments), nearest)))
    return found.withColumns({c: F.col(f"_on.{c}") for c in ("segment", "position", "offset")}).drop("_on")


def from_linear(points: DataFrame, segments: DataFrame) -> DataFrame:
    """``points`` (position) with x and y on the track; those before its start or after its end go to the ends."""
    track = _segments_as_array(segments)
    holding = F.filter(track, lambda s: s["before"] <= F.greatest(F.lit(0.0), F.col("position")))
    d = points.withColumn("_on", F.element_at(holding, -1))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("position") - F.col("_on.before"), F.col("_on.length")), F.lit(0.0))))
    return d.withColumns({"x": F.col("_on.x0") + share * F.col("_on.dx"), "y": F.col("_on.y0") + share * F.col("_on.dy")}).drop("_on")


def path_between(edges: DataFrame, distance: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, step, bin_id): the bins of a shortest way from each target back to where ``distance`` is 0, step 0 being the target.

    ``distance`` (bin_id, distance) is a ``distance_field``.  Of equally short ways each step
    takes the smallest bin.  Unreachable targets give no rows.
    """
    at = distance.select(F.col("bin_id").alias("src"), F.col("distance").alias("from_d"))
    to = distance.select(F.col("bin_id").alias("dst"), F.col("distance").alias("to_d"))
    shorter = edges.select("src", "dst", F.col("distance").cast("double").alias("length")).join(at, "src").join(to, "dst")
    shorter = shorter.where(F.abs(F.col("to_d") + F.col("length") - F.col("from_d")) <= 1e-9 * (1 + F.col("from_d"))).where("to_d < from_d")
    scratch = Scratch(edges.sparkSession, "paths")
    back = scratch.keep("back", shorter.groupBy("src").agg(F.min("dst").alias("before")))
    now = targets.select(F.col("bin_id").alias("target"), F.lit(0).alias("step"), "bin_id").join(distance.select("bin_id"), "bin_id", "left_semi")
    now = scratch.keep("step-0", now.select("target", "step", "bin_id").distinct())
    found, k = now, 0
    while not now.isEmpty():
        k += 1
        now = now.join(back, F.col("bin_id") == F.col("src")).select("target", F.lit(k).alias("step"), F.col("before").alias("bin_id"))
        now = scratch.keep(f"step-{k}", now)
        found = found.union(now)
    return found


def interpolate_linear(points: DataFrame, field: DataFrame, grid: Grid) -> DataFrame:
    """``points`` (x, y) with v: bilinear between the centers of the four bins around each; null where one has no value."""
    u, w = (F.col("x") - grid.lo[0]) / grid.width[0] - 0.5, (F.col("y") - grid.lo[1]) / grid.width[1] - 0.5
    values = grid.small(grid.bins.join(field.select("bin_id", "v"), "bin_id").where("v is not null").select("ix", "iy", "v"))
    d = points.withColumns({"_i": F.floor(u), "_j": F.floor(w), "_u": u - F.floor(u), "_w": w - F.floor(w)})
    total = F.lit(0.0)
    for k, (a, b) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1)]):
        here = values.select((F.col("ix") - a).alias("_i"), (F.col("iy") - b).alias("_j"), F.col("v").alias(f"_v{k}"))
        d = d.join(here, ["_i", "_j"], "left")
        weight = (F.col("_u") if a else 1 - F.col("_u")) * (F.col("_w") if b else 1 - F.col("_w"))
        # A bin without weight needs no value.
        total = total + F.when(weight > 0, weight * F.col(f"_v{k}")).otherwise(0.0)
    return d.withColumn("v", total).select(*points.columns, "v")


def edge_distance(grid: Grid) -> DataFrame:
    """Bins with fewer links than the bin that has most: where walls or gaps are."""
    n = grid.edges.groupBy("src").count()
    counted = grid.bins.join(n, F.col("bin_id") == F.col("src"), "left").select("bin_id", F.coalesce("count", F.lit(0)).alias("n"))
    return counted.join(F.broadcast(counted.agg(F.max("n").alias("most"))), F.col("n") < F.col("most")).select("bin_id")
