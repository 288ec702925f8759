"""Queries on environments of other shapes, their links, tracks as lines, ways and affine maps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import affine
from ..operators import fields, grid as grids, layouts, trajectory
from ..sources import mazes
from .catalog import LO, MAX_GAP, SHAPE, SPAN, WIDTH, grid, named, samples
from .spatial import _field

PI = f"{math.pi}::DOUBLE"
HEX = """SELECT row_number() OVER (ORDER BY r, q) - 1 AS bin_id, q, r, 15.0 * sqrt(3) * (q + r / 2) AS x, (22.5 * r)::DOUBLE AS y, 1.5 * sqrt(3) * 225.0 AS area FROM (SELECT q, r FROM (
  SELECT CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END::BIGINT AS q, CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END::BIGINT AS r FROM (
    SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM (
      SELECT *, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(s, 0) AS rs FROM (
        SELECT q, r, -q - r AS s FROM (SELECT (sqrt(3) / 3 * x - y / 3) / 15.0 AS q, (2.0::DOUBLE / 3 * y) / 15.0 AS r FROM samples))))) GROUP BY q, r HAVING count(*) >= 3)"""


@named(f"SELECT bin_id, q, r, x, y, area FROM ({HEX})", "x y area")
def hex_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.hex_environment(samples(spark, sf_dir), 15.0, 3)[0]


@named(f"""WITH h AS ({HEX}) SELECT a.bin_id AS src, b.bin_id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance
  FROM h a JOIN h b ON (b.q - a.q, b.r - a.r) IN ((1, 0), (0, 1), (-1, 0), (0, -1), (1, -1), (-1, 1))""", "distance")
def hex_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.hex_environment(samples(spark, sf_dir), 15.0, 3)[1]


@named(f"""SELECT idx, CASE WHEN r < 50 THEN floor(r / 10.0)::BIGINT * 12 + floor((b + {PI}) / (2 * {PI} / 12))::BIGINT % 12 ELSE -1 END AS bin_id FROM (
  SELECT idx, sqrt((x - 100) * (x - 100) + (y - 50) * (y - 50)) AS r, atan2(y - 50, x - 100) AS b FROM samples)""")
def polar_bin_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    dx, dy = F.col("x") - 100.0, F.col("y") - 50.0
    return samples(spark, sf_dir).select("idx", layouts.polar_bin(F.sqrt(dx * dx + dy * dy), F.atan2(dy, dx), (0.0, 50.0, 5), 12).alias("bin_id"))


@named("SELECT range // 10 AS ix, range % 10 AS iy, f.v FROM range(0, 100) LEFT JOIN bins b ON b.cell = range LEFT JOIN field f USING (bin_id)", "v")
def full_grid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.full_grid_values(_field(spark, sf_dir), grid(spark, sf_dir))


@named("""WITH s(segment, x0, y0, dx, dy, len, before) AS (VALUES (0, 100.0, 0.0, 0.0, 50.0, 50.0, 0.0), (1, 100.0, 50.0, -80.0, 0.0, 80.0, 50.0), (2, 100.0, 50.0, 80.0, 0.0, 80.0, 130.0)), p AS (
    SELECT idx, x, y, segment, x0, y0, dx, dy, len, before, least(1.0, greatest(0.0, ((x - x0) * dx + (y - y0) * dy) / (len * len))) AS u FROM samples CROSS JOIN s), q AS (
    SELECT *, sqrt((x0 + u * dx - x) * (x0 + u * dx - x) + (y0 + u * dy - y) * (y0 + u * dy - y)) AS off FROM p)
  SELECT idx, arg_min(segment, (off, segment)) AS segment, arg_min(before + u * len, (off, segment))::DOUBLE AS position, min(off)::DOUBLE AS off_track FROM q GROUP BY idx""", "position off_track")
def to_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = mazes.segments(spark, [((100.0, 0.0), (100.0, 50.0)), ((100.0, 50.0), (20.0, 50.0)), ((100.0, 50.0), (180.0, 50.0))])
    return layouts.to_linear(samples(spark, sf_dir).select("idx", "x", "y"), track).select("idx", "segment", "position", F.col("offset").alias("off_track"))


@named("""WITH RECURSIVE h(bin_id, h) AS (SELECT 0::BIGINT, 0 UNION SELECT e.dst, h + 1 FROM h JOIN edges e ON e.src = h.bin_id WHERE h < 30), d AS (SELECT bin_id, min(h) AS d FROM h GROUP BY bin_id),
  back AS (SELECT src, min(dst) AS before FROM edges JOIN d a ON a.bin_id = src JOIN d b ON b.bin_id = dst WHERE b.d = a.d - 1 GROUP BY src),
  way(target, step, bin_id) AS (SELECT bin_id, 0, bin_id FROM d UNION ALL SELECT target, step + 1, before FROM way JOIN back ON back.src = way.bin_id) SELECT * FROM way""")
def path_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins on the ways from every bin to bin 0, by links."""
    g = grid(spark, sf_dir)
    hops = fields.distance_field(g.edges, g.bins.where("bin_id = 0").select("bin_id"), hops=True)
    return layouts.path_between(g.edges.withColumn("distance", F.lit(1.0)), hops, g.bins.select("bin_id"))


@named("""WITH p AS (SELECT idx, floor(x / 20.0 - 0.5)::BIGINT AS i, floor(y / 10.0 - 0.5)::BIGINT AS j, x / 20.0 - 0.5 - floor(x / 20.0 - 0.5) AS u, y / 10.0 - 0.5 - floor(y / 10.0 - 0.5) AS w FROM samples),
  f AS (SELECT ix, iy, v FROM bins JOIN field USING (bin_id)), c AS (
  SELECT idx, abs(1 - a.range - u) * abs(1 - b.range - w) AS weight, f.v FROM p CROSS JOIN range(0, 2) a CROSS JOIN range(0, 2) b LEFT JOIN f ON f.ix = i + a.range AND f.iy = j + b.range)
  SELECT idx, CASE WHEN count_if(weight > 0 AND v IS NULL) = 0 THEN sum(CASE WHEN weight > 0 THEN weight * v ELSE 0 END) END AS v FROM c GROUP BY idx""", "v")
def interpolated_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.interpolate_linear(samples(spark, sf_dir).select("idx", "x", "y"), _field(spark, sf_dir), grid(spark, sf_dir)).select("idx", "v")


@named("""WITH n AS (SELECT bin_id, count(e.dst) AS n FROM bins LEFT JOIN edges e ON e.src = bin_id GROUP BY bin_id), w AS (SELECT b.x, b.y FROM n JOIN bins b USING (bin_id) WHERE n < (SELECT max(n) FROM n))
  SELECT bin_id, (SELECT min(sqrt((b.x - w.x) * (b.x - w.x) + (b.y - w.y) * (b.y - w.y))) FROM w) AS distance FROM bins b""", "distance")
def distance_to_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight distance of each bin from the nearest with fewer links than others: few, as bins are."""
    g = grid(spark, sf_dir)
    edge = g.bins.join(layouts.edge_distance(g), "bin_id", "left_semi")
    return fields.euclidean_distance(g.bins, [(r.x, r.y) for r in edge.select("x", "y").collect()])


@named("SELECT idx, 0.25 * x AS cx, 0.25 * (480 - y) AS cy, x AS px, y AS py FROM samples", "cx cy px py")
def calibrated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels to centimetres by a scale bar, and back."""
    c = affine.by_scale_bar((10.0, 20.0), (90.0, 80.0), 25.0, (640, 480))
    d = samples(spark, sf_dir).select("idx", *[v.alias(n) for n, v in zip(("cx", "cy"), c.to_cm(F.col("x"), F.col("y")))])
    return d.select("*", *[v.alias(n) for n, v in zip(("px", "py"), affine.Calibration.from_dict(c.as_dict()).to_px(F.col("cx"), F.col("cy")))])


@named("SELECT idx, 0.5 * (480 - y) + 3 AS u, 0.5 * x - 7 AS v FROM samples", "u v")
def landmark_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibration from four landmarks that are turned, scaled and shifted."""
    pixels = [(0.0, 0.0), (100.0, 0.0), (100.0, 200.0), (30.0, 70.0)]
    c = affine.by_landmarks(pixels, [(0.5 * (480 - y) + 3, 0.5 * x - 7) for x, y in pixels], (640, 480), "affine")
    return samples(spark, sf_dir).select("idx", *[v.alias(n) for n, v in zip("uv", c.to_cm(F.col("x"), F.col("y")))])


@named("SELECT idx, -2 * y + 5 AS u, 2 * x - 1 AS v, 3 * t / 86400 AS w, x AS bx, y AS by_ FROM samples", "u v w bx by_")
def composed_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn, scale and shift in three dimensions, and the way back."""
    turn = affine.rotation([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])
    m = affine.translate(5.0, -1.0, 0.0) @ affine.scale(2.0, 2.0, 3.0) @ turn @ affine.identity(3)
    d = samples(spark, sf_dir).select("idx", *[v.alias(n) for n, v in zip("uvw", m(F.col("x"), F.col("y"), F.col("t") / 86400))])
    bx, by, _ = m.inverse()(F.col("u"), F.col("v"), F.col("w"))
    return d.select("*", bx.alias("bx"), by.alias("by_"))


@named(f"""SELECT bin_id, sum(dt) AS seconds, count(*) AS n FROM (SELECT dt, CASE WHEN r < 50 THEN floor(r / 10.0)::BIGINT * 12 + floor((b + {PI}) / (2 * {PI} / 12))::BIGINT % 12 END AS bin_id FROM (
  SELECT dt, sqrt((x - 100) * (x - 100) + (y - 50) * (y - 50)) AS r, atan2(y - 50, x - 100) AS b FROM stepped WHERE dt <= {MAX_GAP})) WHERE bin_id IS NOT NULL GROUP BY bin_id""", "seconds")
def polar_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time in each polar bin around a point."""
    d = trajectory.steps(samples(spark, sf_dir), SPAN).where(F.col("dt") <= MAX_GAP)
    dx, dy = F.col("x") - 100.0, F.col("y") - 50.0
    d = d.withColumn("bin_id", layouts.polar_bin(F.sqrt(dx * dx + dy * dy), F.atan2(dy, dx), (0.0, 50.0, 5), 12))
    return d.where("bin_id >= 0").groupBy("bin_id").agg(F.sum("dt").alias("seconds"), F.count("*").alias("n"))


# Shapes with the events that they hold

#: The polar bin of every event around a point.
POLAR_AT = f"""SELECT idx, CASE WHEN r < 50 THEN floor(r / 10.0)::BIGINT * 12 + floor((b + {PI}) / (2 * {PI} / 12))::BIGINT % 12 ELSE -1 END AS bin_id FROM (
  SELECT idx, sqrt((x - 100) * (x - 100) + (y - 50) * (y - 50)) AS r, atan2(y - 50, x - 100) AS b FROM samples)"""


def _polar_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    dx, dy = F.col("x") - 100.0, F.col("y") - 50.0
    at = samples(spark, sf_dir).select(layouts.polar_bin(F.sqrt(dx * dx + dy * dy), F.atan2(dy, dx), (0.0, 50.0, 5), 12).alias("bin_id"))
    return grids.polar_bins(spark, (0.0, 50.0, 5), 12), at.groupBy("bin_id").agg(F.count("*").alias("n"))


def _held(bins: DataFrame, counts: DataFrame) -> DataFrame:
    return bins.join(counts, "bin_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@named(f"""SELECT range AS bin_id, (range // 12 + 0.5) * 10.0::DOUBLE AS distance, (range % 12 + 0.5) * (2 * {PI} / 12) - {PI} AS angle, 0.5 * (pow((range // 12 + 1) * 10.0, 2) - pow((range // 12) * 10.0, 2)) * (2 * {PI} / 12) AS area,
  (SELECT count(*) FROM ({POLAR_AT}) WHERE bin_id = range) AS n FROM range(0, 60)""", "distance angle area")
def polar_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins around a point, with the events in each."""
    return _held(*_polar_counts(spark, sf_dir)).select("bin_id", "distance", "angle", "area", "n")


@named(f"""WITH n AS MATERIALIZED (SELECT bin_id, count(*) AS n FROM ({POLAR_AT}) GROUP BY bin_id), p AS (SELECT range AS b, range // 12 AS i, range % 12 AS j, coalesce(n, 0) AS n FROM range(0, 60) LEFT JOIN n ON bin_id = range)
  SELECT a.b AS src, c.b AS dst, CASE WHEN a.j = c.j THEN 10.0 ELSE (a.i + 0.5) * 10.0 * (2 * {PI} / 12) END AS distance, c.n - a.n AS more FROM p a JOIN p c ON (a.j = c.j AND abs(a.i - c.i) = 1) OR (a.i = c.i AND abs(a.j - c.j) IN (1, 11))""", "distance")
def polar_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of polar bins, with how many more events the second holds than the first."""
    bins, counts = _polar_counts(spark, sf_dir)
    n = _held(bins, counts).select("bin_id", "n")
    e = layouts.polar_edges(bins, 12)
    for k in ("src", "dst"):
        e = e.join(n.select(F.col("bin_id").alias(k), F.col("n").alias(f"n_{k}")), k)
    return e.select("src", "dst", "distance", (F.col("n_dst") - F.col("n_src")).alias("more"))


@named(f"""WITH f AS (SELECT arg_min(bin_id, (-n, bin_id)) AS b FROM (SELECT bin_id, count(*) AS n FROM ({POLAR_AT}) WHERE bin_id BETWEEN 24 AND 35 GROUP BY bin_id))
  SELECT range AS bin_id, CASE WHEN d > 6 THEN 12 - d ELSE d END * 25.0 * (2 * {PI} / 12) AS distance FROM (SELECT range, abs(range - b) AS d FROM range(24, 36), f)""", "distance")
def polar_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest ways along one ring, round the seam, from its bin with the most events."""
    bins, counts = _polar_counts(spark, sf_dir)
    ring = bins.where("i_distance = 2")
    fullest = ring.join(counts, "bin_id").agg(F.max_by("bin_id", F.struct("n", -F.col("bin_id"))).alias("bin_id"))
    return fields.distance_field(layouts.polar_edges(ring, 12), fullest)


@named("""WITH n AS (SELECT range AS cell, coalesce(n, 0) AS n FROM range(0, 100) LEFT JOIN (SELECT cell, count(*) AS n FROM cells WHERE cell IS NOT NULL GROUP BY cell) c ON c.cell = range)
  SELECT row_number() OVER (ORDER BY cell) - 1 AS bin_id, cell, (cell // 10 + 0.5) * 20.0::DOUBLE AS x, (cell % 10 + 0.5) * 10.0::DOUBLE AS y FROM n WHERE n >= (SELECT avg(n) FROM n)""", "x y")
def masked_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask as an image of the events gives it: cells of at least the mean brightness."""
    whole = grids.regular_grid(spark, LO, WIDTH, SHAPE)
    seen = grids.bin_at(samples(spark, sf_dir), whole).where("bin_id >= 0").groupBy("bin_id").agg(F.count("*").alias("n"))
    image = _held(whole.bins.select("bin_id", "ix", "iy"), seen)
    mean = image.agg(F.avg("n").alias("mean"))  # one row
    mask = image.crossJoin(F.broadcast(mean)).select("ix", "iy", (F.col("n") >= F.col("mean")).alias("active"))
    return layouts.masked_grid(spark, LO, WIDTH, SHAPE, mask).bins.select("bin_id", "cell", "x", "y")


def _with_events(spark: SparkSession, sf_dir: str, g: grids.Grid, x: float = 0.0, y: float = 0.0) -> DataFrame:
    """Bins of a grid with the events in each, the grid laid with its origin at a place."""
    s = samples(spark, sf_dir).select((F.col("x") - x).alias("x"), (F.col("y") - y).alias("y"))
    return _held(g.bins, grids.bin_at(s, g).where("bin_id >= 0").groupBy("bin_id").agg(F.count("*").alias("n")))


def _count_sql(width: float, height: float, x: float = 0.0, y: float = 0.0) -> str:
    """Events in the cell whose center is (x, y) of the row."""
    return f"(SELECT count(*) FROM samples s WHERE s.x - {x} >= b.x - {width / 2} AND s.x - {x} < b.x + {width / 2} AND s.y - {y} >= b.y - {height / 2} AND s.y - {y} < b.y + {height / 2}) AS n"


@named(f"""WITH c AS (SELECT (range // 9 + 0.5) * 20.0::DOUBLE AS x, (range % 9 + 0.5) * 10.0::DOUBLE AS y, range AS cell FROM range(0, 81)),
  b AS (SELECT row_number() OVER (ORDER BY cell) - 1 AS bin_id, x, y FROM c WHERE x / 180.0 + y / 90.0 <= 1 + 1e-9 AND NOT (x BETWEEN 20 AND 60 AND y BETWEEN 20 AND 40)) SELECT bin_id, x, y, {_count_sql(20, 10)} FROM b""", "x y")
def polygon_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle with a rectangular hole, and the events in its bins."""
    hole = [(20.0, 20.0), (60.0, 20.0), (60.0, 40.0), (20.0, 40.0)]
    g = layouts.polygon_grid(spark, [(0.0, 0.0), (180.0, 0.0), (0.0, 90.0)], (20.0, 10.0), [hole])
    return _with_events(spark, sf_dir, g).select("bin_id", "x", "y", "n")


@named(f"""WITH c AS (SELECT range AS cell, range // 9 AS ix, range % 9 AS iy, (range // 9 + 0.5) * 10.0 - 48.30127018922193 AS x, (range % 9 + 0.5) * 10.0 - 55.0 AS y FROM range(0, 90)),
  s(dx, dy) AS (VALUES (cos(-{PI} / 2) * 50, sin(-{PI} / 2) * 50), (cos({PI} / 6) * 50, sin({PI} / 6) * 50), (cos(5 * {PI} / 6) * 50, sin(5 * {PI} / 6) * 50)),
  o AS (SELECT cell, ix, iy, x, y, least(1.0, greatest(0.0, (x * dx + y * dy) / 2500)) AS u, dx, dy FROM c CROSS JOIN s),
  b AS (SELECT row_number() OVER (ORDER BY cell) - 1 AS bin_id, ix, iy, x, y FROM (SELECT cell, ix, iy, x, y, min(sqrt((u * dx - x) * (u * dx - x) + (u * dy - y) * (u * dy - y))) AS off FROM o GROUP BY ALL) WHERE off <= 5.0 + 1e-9)
  SELECT bin_id, ix, iy, {_count_sql(10, 10, 100.0, 50.0)} FROM b""")
def corridor_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of a Y maze with corridors 10 wide, laid over the events."""
    g = layouts.corridor_grid(spark, mazes.y_maze(spark, 50.0), 10.0, (10.0, 10.0))
    return _with_events(spark, sf_dir, g, 100.0, 50.0).select("bin_id", "ix", "iy", "n")


@named(f"""WITH c AS (SELECT range AS cell, (range // 15 + 0.5) * 10.0 - 75 AS x, (range % 15 + 0.5) * 10.0 - 75 AS y FROM range(0, 225)), b AS (SELECT row_number() OVER (ORDER BY cell) - 1 AS bin_id, x, y FROM c WHERE (
    SELECT count_if(((y1 > y) <> (y2 > y)) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) FROM (SELECT 75 * cos(2 * pi() * range / 64) AS x1, 75 * sin(2 * pi() * range / 64) AS y1, 75 * cos(2 * pi() * (range + 1) / 64) AS x2, 75 * sin(2 * pi() * (range + 1) / 64) AS y2 FROM range(0, 64)) WHERE y1 <> y2) % 2 = 1)
  SELECT bin_id, x::DOUBLE AS x, y::DOUBLE AS y, CASE WHEN x > 0 THEN 'e' ELSE 'w' END AS half, {_count_sql(10, 10, 100.0, 50.0)} FROM b""", "x y")
def watermaze_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of a round pool laid over the events."""
    pool, _ = mazes.watermaze()
    g = layouts.polygon_grid(spark, pool, (10.0, 10.0))
    return _with_events(spark, sf_dir, g, 100.0, 50.0).select("bin_id", "x", "y", F.when(F.col("x") > 0, "e").otherwise("w").alias("half"), "n")
