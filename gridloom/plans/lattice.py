"""Queries on autocorrelograms and their peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.moments import correlation_sql
from ..operators import lattice
from .activity import _unit_rates
from .catalog import SHAPE, WIDTH, grid, named

SHIFTS = f"""SELECT p.unit, b.ix - a.ix AS dx, b.iy - a.iy AS dy, count(*) AS n, {correlation_sql("p.rate", "q.rate")} AS r FROM unit_rates p JOIN unit_rates q USING (unit) JOIN bins a ON a.bin_id = p.bin_id JOIN bins b ON b.bin_id = q.bin_id
  WHERE p.rate IS NOT NULL AND q.rate IS NOT NULL GROUP BY ALL HAVING count(*) >= 10"""
PEAKS = f"""SELECT unit, row_number() OVER (PARTITION BY unit ORDER BY round(distance, 9), dx, dy) AS place, dx, dy, distance, r FROM (
    SELECT s.unit, s.dx, s.dy, s.r, sqrt(pow(s.dx * 20.0, 2) + pow(s.dy * 10.0, 2))::DOUBLE AS distance FROM shifts s JOIN (SELECT unit, max(r) - min(r) AS range FROM shifts GROUP BY unit) w USING (unit)
    WHERE s.r > 0.1 * range AND abs(s.dx) < 9 AND abs(s.dy) < 9 AND NOT EXISTS (SELECT 1 FROM shifts o WHERE o.unit = s.unit AND abs(o.dx - s.dx) <= 1 AND abs(o.dy - s.dy) <= 1 AND o.r > s.r + 1e-9))
  WHERE distance > 19.0 QUALIFY place <= 7"""


def _correlogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.autocorrelogram(_unit_rates(spark, sf_dir), grid(spark, sf_dir))


@named(f"SELECT unit, dx, dy, n, r FROM ({SHIFTS})", "r")
def autocorrelogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit's rate map against itself, shifted."""
    return _correlogram(spark, sf_dir)


def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rounded, so that what is equal but for the order of sums is equal.
    return lattice.peaks(_correlogram(spark, sf_dir).withColumn("r", F.round("r", 9)), SHAPE, WIDTH, apart=1)


@named(f"WITH shifts AS MATERIALIZED (SELECT * REPLACE (round(r, 9) AS r) FROM ({SHIFTS})) SELECT unit, place, dx, dy, distance, r FROM ({PEAKS})", "distance r")
def autocorrelogram_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _peaks(spark, sf_dir).select("unit", "place", "dx", "dy", "distance", "r")


@named(f"""WITH shifts AS MATERIALIZED (SELECT * REPLACE (round(r, 9) AS r) FROM ({SHIFTS})), p AS (SELECT *, 6 * atan2(dy * 10.0, dx * 20.0) AS six FROM ({PEAKS}) WHERE place <= 6),
  m AS (SELECT unit, count(*) AS n_peaks, median(distance) AS scale, avg(sin(six)) AS s, avg(cos(six)) AS c, avg(pow(dx * 20.0, 2)) AS xx, avg(pow(dy * 10.0, 2)) AS yy, avg(dx * 20.0 * dy * 10.0) AS xy FROM p GROUP BY unit)
  SELECT unit, n_peaks, scale, sqrt(2 * ((xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + xy * xy))) AS major, sqrt(greatest(0.0, 2 * ((xx + yy) / 2 - sqrt(pow((xx - yy) / 2, 2) + xy * xy)))) AS minor FROM m WHERE n_peaks >= 3""", "scale major minor")
def grid_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale and ellipse of the nearest six peaks; directions are tested on planted lattices."""
    return lattice.grid_properties(_peaks(spark, sf_dir)).where("n_peaks >= 3").select("unit", "n_peaks", "scale", "major", "minor")


PROFILE = f"""SELECT a.unit, floor(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) / 12.0)::BIGINT AS ring, {correlation_sql("a.rate", "b.rate")} AS r FROM unit_rates a JOIN unit_rates b ON a.unit = b.unit AND a.bin_id < b.bin_id
  JOIN bins p ON p.bin_id = a.bin_id JOIN bins q ON q.bin_id = b.bin_id WHERE a.rate IS NOT NULL AND b.rate IS NOT NULL GROUP BY ALL HAVING count(*) >= 2"""


@named(f"""WITH f AS MATERIALIZED (SELECT unit, ring, r, row_number() OVER (PARTITION BY unit ORDER BY ring) - 1 AS k FROM (SELECT unit, ring, round(r, 9) AS r FROM ({PROFILE})) WHERE r IS NOT NULL), g AS MATERIALIZED (SELECT * FROM f WHERE k > 0),
  t AS (SELECT * FROM (SELECT *, lag(r) OVER w AS b, lead(r) OVER w AS a FROM g WINDOW w AS (PARTITION BY unit ORDER BY ring)) WHERE r > b AND r > a),
  s AS (SELECT *, coalesce((SELECT max(k) FROM g WHERE g.unit = t.unit AND g.k < t.k AND g.r > t.r), -1) AS l, coalesce((SELECT min(k) FROM g WHERE g.unit = t.unit AND g.k > t.k AND g.r > t.r), 1000000) AS h FROM t),
  v AS (SELECT *, r - greatest((SELECT min(r) FROM g WHERE g.unit = s.unit AND g.k <= s.k AND g.k > s.l), (SELECT min(r) FROM g WHERE g.unit = s.unit AND g.k >= s.k AND g.k < s.h)) AS prominence FROM s),
  x AS (SELECT v.unit, ring, ring - lag(ring) OVER (PARTITION BY v.unit ORDER BY ring) AS gap FROM v JOIN (SELECT unit, max(r) - min(r) AS range FROM g GROUP BY unit) USING (unit) WHERE prominence >= 0.1 * range)
  SELECT u.unit, coalesce(n, 0) AS n_peaks, CASE WHEN n >= 3 AND gaps >= 2 THEN least(1.0, greatest(0.0, 1 - sd / m)) END AS score FROM (SELECT DISTINCT unit FROM f) u
  LEFT JOIN (SELECT unit, count(*) AS n, count(gap) AS gaps, avg(gap) AS m, stddev_pop(gap) AS sd FROM x GROUP BY unit) USING (unit)""", "score")
def periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How even the spacing of the peaks of each unit's radial autocorrelation is."""
    from ..operators import cells

    g = grid(spark, sf_dir)
    a, b = (g.bins.select(F.col("bin_id").alias(k), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k in "ab")
    apart = F.sqrt((F.col("xa") - F.col("xb")) * (F.col("xa") - F.col("xb")) + (F.col("ya") - F.col("yb")) * (F.col("ya") - F.col("yb")))
    rings = cells.radial_autocorrelation(_unit_rates(spark, sf_dir), a.join(b, F.col("a") < F.col("b")).select("a", "b", apart.alias("distance")), 12.0)
    return lattice.periodicity(rings.withColumn("r", F.round("r", 9)))
