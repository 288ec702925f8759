"""A track laid through the events, and the queries on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import grid as grids, layouts
from .catalog import named, samples

#: Strips of x whose events' mean places are the nodes of the track.
STRIP = 40.0

TRACK = """SELECT row_number() OVER (ORDER BY i) - 1 AS segment, x AS x0, y AS y0, nx AS x1, ny AS y1 FROM (SELECT i, x, y, lead(x) OVER (ORDER BY i) AS nx, lead(y) OVER (ORDER BY i) AS ny FROM (
    SELECT floor(x / 40.0)::BIGINT AS i, avg(x) AS x, avg(y) AS y FROM samples WHERE x >= 0 AND x < 200 GROUP BY ALL)) WHERE nx IS NOT NULL"""
TRACK_BINS = f"""SELECT row_number() OVER (ORDER BY segment, k) - 1 AS bin_id, segment, k, x0 + (k + 0.5) / n * (x1 - x0) AS x, y0 + (k + 0.5) / n * (y1 - y0) AS y, before + (k + 0.5) / n * length AS position, length / n AS length FROM (
    SELECT *, unnest(range(n)) AS k FROM (SELECT *, greatest(1, round(length / 5.0))::BIGINT AS n, coalesce(sum(length) OVER (ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
      SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS length FROM ({TRACK}))))"""
_ONE_WAY = """SELECT a.bin_id AS src, b.bin_id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance, a.length AS al, b.length AS bl, a.segment AS sa, b.segment AS sb FROM tb a JOIN tb b
    ON (a.segment = b.segment AND b.k = a.k + 1) OR (a.segment < b.segment AND (a.k = 0 OR a.k = (SELECT max(k) FROM tb c WHERE c.segment = a.segment)) AND (b.k = 0 OR b.k = (SELECT max(k) FROM tb c WHERE c.segment = b.segment))
      AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= (a.length + b.length) / 2 + 0.1)"""
#: Over a table ``tb`` of TRACK_BINS.
TRACK_LINKS = f"SELECT src, dst, distance, al, bl, sa, sb FROM ({_ONE_WAY}) UNION SELECT dst, src, distance, bl, al, sb, sa FROM ({_ONE_WAY})"
#: Over a table ``tl`` of TRACK_LINKS: the way along the track at its bends.
CROSSED = "SELECT src, dst, CASE WHEN sa = sb THEN distance ELSE (al + bl) / 2 END AS distance FROM tl"


def derived_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments (segment, x0, y0, x1, y1) from the mean place of the events of each strip of x to that of the next."""
    s = samples(spark, sf_dir).where((F.col("x") >= 0) & (F.col("x") < 200))
    nodes = s.groupBy(F.floor(F.col("x") / STRIP).alias("i")).agg(F.avg("x").alias("x0"), F.avg("y").alias("y0"))
    order = Window.orderBy("i")  # a node for each strip
    d = nodes.select("i", "x0", "y0", F.lead("x0").over(order).alias("x1"), F.lead("y0").over(order).alias("y1")).where("x1 is not null")
    return d.select((F.row_number().over(order) - 1).alias("segment"), "x0", "y0", "x1", "y1")


@named(f"SELECT bin_id, x, y, position FROM ({TRACK_BINS})", "x y position")
def track_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.track_bins(derived_track(spark, sf_dir), 5.0).select("bin_id", "x", "y", "position")


@named(f"WITH tb AS ({TRACK_BINS}) SELECT src, dst, distance FROM ({TRACK_LINKS})", "distance")
def track_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.track_edges(grids.track_bins(derived_track(spark, sf_dir), 5.0), 0.1)


_PLACED = f"""SELECT idx, segment, least(1.0, greatest(0.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / (length * length))) AS u, x, y, x0, y0, x1, y1, length, before FROM samples CROSS JOIN (
    SELECT *, coalesce(sum(length) OVER (ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS length FROM ({TRACK})))"""


@named(f"""WITH p AS ({_PLACED}), q AS (SELECT *, x0 + u * (x1 - x0) AS px, y0 + u * (y1 - y0) AS py FROM p)
  SELECT idx, arg_min(px, (sqrt((px - x) * (px - x) + (py - y) * (py - y)), segment)) AS x, arg_min(py, (sqrt((px - x) * (px - x) + (py - y) * (py - y)), segment)) AS y FROM q GROUP BY idx""", "x y")
def from_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's nearest place on the track: to a distance along it, and back."""
    track = derived_track(spark, sf_dir)
    along = layouts.to_linear(samples(spark, sf_dir).select("idx", "x", "y"), track).select("idx", "position")
    return layouts.from_linear(along, track).select("idx", "x", "y")
