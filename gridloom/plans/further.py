"""Queries on views, alignment, scores and further decoding."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment, decoding, encoding, grid as grids, stats, trajectory, visibility
from ..sources import mazes
from .activity import _post, _rates, _truth
from .catalog import MAX_GAP, SPAN, grid, named, samples
from .spatial import _field

HEADED = "SELECT *, atan2(next_y - y, next_x - x) AS heading FROM stepped WHERE dt IS NOT NULL"
SEEN = """SELECT DISTINCT idx, bin_id FROM (
  SELECT *, min(CASE WHEN bin_id IS NULL THEN k END) OVER (PARTITION BY idx, ray) AS stop FROM (
    SELECT p.idx, p.ray, p.k, b.bin_id FROM (
      SELECT h.idx, r.range AS ray, s.range AS k, h.x + s.range * 3.0 * cos(h.heading - 0.5 + (r.range + 0.5) * 0.1) AS px, h.y + s.range * 3.0 * sin(h.heading - 0.5 + (r.range + 0.5) * 0.1) AS py
      FROM ({h}) h CROSS JOIN range(0, 10) r CROSS JOIN range(0, 20) s) p
    LEFT JOIN bins b ON px >= 0 AND px < 200 AND py >= 0 AND py < 100 AND b.cell = floor(px / 20.0)::BIGINT * 10 + floor(py / 10.0)::BIGINT)) WHERE stop IS NULL OR k < stop""".replace("{h}", HEADED)


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.steps(samples(spark, sf_dir), SPAN).where("dt is not null").select("session", "idx", "t", "x", "y", "heading")


@named(SEEN)
def viewshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.viewshed(_headed(spark, sf_dir).select("idx", "x", "y", "heading"), grid(spark, sf_dir), 10, 0.5, 60.0, 20).select("idx", "bin_id").distinct()


@named(SEEN)
def viewshed_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``viewshed``, under the name that it had beside a part of it."""
    return viewshed(spark, sf_dir)


@named("""SELECT idx, bool_and(b.bin_id IS NOT NULL) AS clear FROM (
  SELECT idx, x + k.range / 19.0::DOUBLE * (100.0 - x) AS px, y + k.range / 19.0::DOUBLE * (50.0 - y) AS py FROM samples CROSS JOIN range(0, 20) k) p
  LEFT JOIN bins b ON px >= 0 AND px < 200 AND py >= 0 AND py < 100 AND b.cell = floor(px / 20.0)::BIGINT * 10 + floor(py / 10.0)::BIGINT GROUP BY idx""")
def clear_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = samples(spark, sf_dir).select("idx", "x", "y", F.lit(100.0).alias("to_x"), F.lit(50.0).alias("to_y"))
    return visibility.clear_line(d, grid(spark, sf_dir)).select("idx", "clear")


@named("SELECT idx, x + 25.0 * cos(heading) AS vx, y + 25.0 * sin(heading) AS vy, abs(heading) <= 1.0 AS seen FROM (SELECT *, atan2(next_y - y, next_x - x) AS heading FROM stepped WHERE dt IS NOT NULL)", "vx vy")
def view_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = trajectory.steps(samples(spark, sf_dir), SPAN).where("dt is not null")
    vx, vy = visibility.view_point(F.col("x"), F.col("y"), F.col("heading"), 25.0)
    return d.select("idx", vx.alias("vx"), vy.alias("vy"), visibility.in_field_of_view(F.col("heading"), 1.0, -1.0).alias("seen"))


COARSE = "SELECT range AS bin_id, (range // 4 + 0.5) * 50.0::DOUBLE AS x, (range % 4 + 0.5) * 25.0::DOUBLE AS y FROM range(0, 16)"


def _coarse(spark: SparkSession) -> grids.Grid:
    return grids.regular_grid(spark, (0.0, 0.0), (50.0, 25.0), (4, 4))


@named(f"""SELECT c.bin_id, coalesce(p, 0.0) AS p FROM ({COARSE}) c LEFT JOIN (
  SELECT target, sum(v / (SELECT sum(v) FROM field)) AS p FROM (SELECT b.bin_id, c.bin_id AS target, row_number() OVER (PARTITION BY b.bin_id ORDER BY sqrt((b.x - c.x) * (b.x - c.x) + (b.y - c.y) * (b.y - c.y)), c.bin_id) AS k
    FROM bins b CROSS JOIN ({COARSE}) c) JOIN field USING (bin_id) WHERE k = 1 GROUP BY target) ON target = c.bin_id""", "p")
def mapped_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import fields

    p = fields.normalize(_field(spark, sf_dir)).withColumnRenamed("v", "p")
    return alignment.map_probabilities(p, grid(spark, sf_dir).bins, _coarse(spark).bins, 60.0)


@named(f"""SELECT c.bin_id, v FROM (SELECT c.bin_id, b.bin_id AS source, row_number() OVER (PARTITION BY c.bin_id ORDER BY sqrt((b.x - c.x) * (b.x - c.x) + (b.y - c.y) * (b.y - c.y)), b.bin_id) AS k
  FROM ({COARSE}) c CROSS JOIN bins b) c JOIN field f ON f.bin_id = c.source WHERE k = 1""", "v")
def resampled_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.resample(_field(spark, sf_dir), grid(spark, sf_dir).bins, _coarse(spark).bins, 60.0)


@named("""SELECT regr_slope(u, x) AS slope, regr_intercept(u, x) AS intercept FROM (SELECT x, 2 * x + 7 AS u FROM samples)""", "slope intercept")
def fitted_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = samples(spark, sf_dir).select("x", "y", (2 * F.col("x") + 7).alias("u"), (0.5 * F.col("y") - 1).alias("v"))
    m = alignment.fit_transform(d)
    return spark.createDataFrame([(float(m[0][0]), float(m[0][2]))], "slope double, intercept double")


@named("""SELECT unit, (cover - depth) / (cover + depth) AS score FROM (SELECT unit, greatest(count_if(ix = 0) / 10.0::DOUBLE, count_if(ix = 9) / 10.0::DOUBLE, count_if(iy = 0) / 10.0::DOUBLE, count_if(iy = 9) / 10.0::DOUBLE) AS cover,
  sum(rate * least(least(ix, 9 - ix) * 20.0::DOUBLE, least(iy, 9 - iy) * 10.0::DOUBLE)) / sum(rate) / 45.0 AS depth
  FROM (SELECT *, max(rate) OVER (PARTITION BY unit) AS peak FROM rates WHERE rate IS NOT NULL) JOIN bins USING (bin_id) WHERE rate >= 0.3 * peak AND peak > 0 GROUP BY unit)""", "score")
def border_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.border_scores(_rates(spark, sf_dir), grid(spark, sf_dir))


@named()
def grid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.grid_scores(_rates(spark, sf_dir), grid(spark, sf_dir))


@named("""SELECT (r0 + r1) / 2 AS r FROM (SELECT (sum(w * a * x) - sum(w * a) * sum(w * x) / sum(w)) / sqrt((sum(w * a * a) - sum(w * a) * sum(w * a) / sum(w)) * (sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w))) AS r0,
  (sum(w * b * y) - sum(w * b) * sum(w * y) / sum(w)) / sqrt((sum(w * b * b) - sum(w * b) * sum(w * b) / sum(w)) * (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w))) AS r1
  FROM (SELECT t_idx, max(p) AS w, sum(p * bins.x) AS a, sum(p * bins.y) AS b FROM post JOIN bins USING (bin_id) GROUP BY t_idx) JOIN truth USING (t_idx))""", "r")
def decoding_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.decoding_correlation(decoding.estimates(_post(spark, sf_dir), grid(spark, sf_dir).bins), _truth(spark, sf_dir))


@named()
def radon_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.radon_line(_post(spark, sf_dir), 100, 21)


@named()
def isotonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decoding.estimates(_post(spark, sf_dir), grid(spark, sf_dir).bins)
    return decoding.isotonic_fit(d.select("t_idx", F.col("mean_x").alias("s"), F.col("peak").alias("p")))


@named("SELECT bin_id, CASE WHEN bin_id >= (SELECT count(*) FROM bins) THEN 1 ELSE 0 END AS part, x FROM (SELECT bin_id, x FROM bins UNION ALL SELECT bin_id + (SELECT count(*) FROM bins), x FROM bins)", "x")
def union_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return grids.union_environments([(g.bins, g.edges), (g.bins, g.edges)])[0].select("bin_id", "part", "x")


@named("""SELECT src, dst, distance FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS a, row_number() OVER (PARTITION BY dst ORDER BY distance, src) AS b FROM (
  SELECT s.bin_id AS src, c.bin_id AS dst, sqrt((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y)) AS distance FROM bins s CROSS JOIN ({coarse}) c) WHERE distance <= 30.0) WHERE a = 1 AND b = 1""".replace("{coarse}", COARSE), "distance")
def mutual_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.mutual_nearest(grid(spark, sf_dir).bins, _coarse(spark).bins, 30.0)


@named()
def jittered_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).where("event_type = 'click'").select(F.pmod("session", F.lit(4)).alias("unit"), "t")
    return stats.jittered(s, 60.0, 3).groupBy("surrogate", "unit").agg(F.count("*").alias("n"), F.avg("t").alias("mean_t"))


@named("SELECT bin_id, 20.0 * exp(-least(sqrt((x - 30) * (x - 30) + (y - 40) * (y - 40)), 1e9) / 20.0) AS v FROM bins", "v")
def reward_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import behavior, fields

    g = grid(spark, sf_dir)
    return behavior.reward_field(g.bins, fields.euclidean_distance(g.bins, [(30.0, 40.0)]), 20.0)


@named("SELECT idx, label FROM (SELECT s.idx, s.session, s.t, arg_max(i.n, i.start_t) AS label FROM samples s LEFT JOIN (SELECT session, t AS start_t, lead(t) OVER (PARTITION BY session ORDER BY t) AS stop_t, idx AS n FROM samples WHERE event_type = 'purchase') i ON i.session = s.session AND s.t >= i.start_t AND s.t <= i.stop_t WHERE s.event_type = 'view' GROUP BY ALL)")
def interval_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import events
    from ..operators import timeseries as ts

    bought = samples(spark, sf_dir).where("event_type = 'purchase'").select("session", "idx", "t")
    spans = ts.with_next(bought, ["session"], ["t", "idx"], ["t"], SPAN).where("next_t is not null")
    spans = spans.select("session", F.col("t").alias("ord"), F.col("t").alias("start_t"), F.col("next_t").alias("stop_t"), F.col("idx").alias("purchase"))
    viewed = samples(spark, sf_dir).where("event_type = 'view'").select("session", "idx", "t")
    return events.label_by_intervals(viewed, spans, F.col("purchase"), MAX_GAP, "idx", ["session"])


@named(f"SELECT idx, count(*) AS n, count(*) / (SELECT count(*) FROM bins) AS share FROM ({SEEN}) GROUP BY idx", "share")
def visible_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the arena every moving sample sees."""
    g = grid(spark, sf_dir)
    seen = visibility.viewshed(_headed(spark, sf_dir).select("idx", "x", "y", "heading"), g, 10, 0.5, 60.0, 20)
    return visibility.visible_share(seen, g, ["idx"])


@named(f"SELECT v.bin_id, sum(h.dt) AS seconds FROM ({SEEN}) v JOIN stepped h USING (idx) GROUP BY v.bin_id", "seconds")
def view_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long every bin was in view."""
    headed = trajectory.steps(samples(spark, sf_dir), SPAN).select("session", "idx", "t", "x", "y", "heading")
    return visibility.view_occupancy(headed, grid(spark, sf_dir), 10, 0.5, 60.0, 20, SPAN)
