"""Queries on efficiency, goals, windows before decisions, labels of directions and shuffled maps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import behavior, grid as grids, navigation, regions
from .activity import ENTRIES, _rates
from .catalog import SPAN, grid, named, samples
from .spatial import BOX

PI = f"{math.pi}::DOUBLE"
DAY = 86_400.0
FIRST_LAST = "SELECT session, arg_min(x, (t, idx)) AS ax, arg_min(y, (t, idx)) AS ay, arg_max(x, (t, idx)) AS bx, arg_max(y, (t, idx)) AS by_, min(t) AS start_t, max(t) AS stop_t, count(*) AS n FROM samples GROUP BY session"
TURNS = """SELECT session, idx, t, atan2(ax * by_ - ay * bx + 0.0, ax * bx + ay * by_) AS turn FROM (
  SELECT session, idx, t, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_ FROM (
    SELECT session, idx, t, x, y FROM stepped WHERE prev_x IS NULL OR prev_x <> x OR prev_y <> y) WINDOW w AS (PARTITION BY session ORDER BY t, idx)) WHERE ax IS NOT NULL AND bx IS NOT NULL"""


@named(f"SELECT session, CASE WHEN n > 1 AND stop_t > start_t THEN sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) / 0.0001 / (stop_t - start_t) END AS time_efficiency FROM ({FIRST_LAST})", "time_efficiency")
def time_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.time_efficiency(samples(spark, sf_dir), geometry.distance(F.col("start_x"), F.col("start_y"), F.col("stop_x"), F.col("stop_y")), 0.0001)


@named(f"""SELECT session, CASE WHEN n < 3 THEN 1.0 WHEN extent >= 1e-10 THEN 1 - coalesce(turn, 0.0) / {PI} END AS angular_efficiency
  FROM (SELECT session, count(*) AS n, greatest(max(x) - min(x), max(y) - min(y)) AS extent FROM samples GROUP BY session) LEFT JOIN (SELECT session, avg(abs(turn)) AS turn FROM ({TURNS}) GROUP BY session) USING (session)""", "angular_efficiency")
def angular_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.angular_efficiency(samples(spark, sf_dir), SPAN)


@named("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, idx) AS k FROM samples), w AS (SELECT session, k, x, y, sum(coalesce(step, 0.0)) OVER (PARTITION BY session ORDER BY k) AS upto FROM (
    SELECT *, sqrt((x - lag(x) OVER s) * (x - lag(x) OVER s) + (y - lag(y) OVER s) * (y - lag(y) OVER s)) AS step FROM n WINDOW s AS (PARTITION BY session ORDER BY k))),
  a AS (SELECT session, arg_min(k, (sqrt((50 - x) * (50 - x) + (20 - y) * (20 - y)), k)) AS k FROM w GROUP BY session),
  b AS (SELECT w.session, arg_min(w.k, (sqrt((90 - x) * (90 - x) + (70 - y) * (70 - y)), w.k)) AS k FROM w JOIN a ON a.session = w.session AND w.k >= a.k GROUP BY w.session),
  s AS (SELECT session, 0 AS subgoal, 1 AS k0, k AS k1, 50.0 AS gx, 20.0 AS gy FROM a UNION ALL SELECT a.session, 1, a.k, b.k, 90.0, 70.0 FROM a JOIN b USING (session)),
  r AS (SELECT s.session, subgoal, CASE WHEN k0 < k1 THEN q.upto - p.upto ELSE 0.0 END AS traveled, CASE WHEN k0 < k1 THEN sqrt((gx - p.x) * (gx - p.x) + (gy - p.y) * (gy - p.y)) ELSE 0.0 END AS straight
    FROM s JOIN w p ON p.session = s.session AND p.k = k0 JOIN w q ON q.session = s.session AND q.k = k1)
  SELECT session, subgoal, traveled, straight, CASE WHEN traveled > 0 THEN straight / traveled END AS efficiency FROM r""", "traveled straight efficiency")
def subgoal_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.subgoal_efficiency(samples(spark, sf_dir), [(50.0, 20.0), (90.0, 70.0)], SPAN)


@named("""WITH d AS (SELECT *, sqrt((60 - x) * (60 - x) + (50 - y) * (50 - y)) AS d, atan2(50 - y, 60 - x) AS way, atan2(next_y - y, next_x - x) AS h FROM stepped),
  r AS (SELECT session, avg((d - pd) / nullif(t - pt, 0)) AS mean_approach FROM (SELECT *, lag(d) OVER w AS pd, lag(t) OVER w AS pt FROM d WINDOW w AS (PARTITION BY session ORDER BY t, idx)) GROUP BY session)
  SELECT session, avg(CASE WHEN dt IS NOT NULL THEN cos(h - way) END) AS bias, any_value(mean_approach) * 1e6 AS approach_e6, min(CASE WHEN d <= 20 THEN t END) - min(t) AS time_to_goal, min(d) AS nearest, arg_min(d, (t, idx)) AS at_start, arg_max(d, (t, idx)) AS at_end
  FROM d JOIN r USING (session) GROUP BY session""", "bias approach_e6 time_to_goal nearest at_start at_end")
def goal_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = navigation.goal_directed(samples(spark, sf_dir), (60.0, 50.0), 20.0, 0.0, SPAN)
    return d.withColumn("approach_e6", F.col("mean_approach") * 1e6).drop("mean_approach")


@named("""SELECT session, start_t, stop_t, progress / traveled AS directedness, progress FROM (SELECT session, min(t) AS start_t, max(t) AS stop_t, arg_min(d, (t, idx)) - arg_max(d, (t, idx)) AS progress, sum(length) AS traveled
  FROM (SELECT *, sqrt((60 - x) * (60 - x) + (50 - y) * (50 - y)) AS d FROM stepped) GROUP BY session) WHERE progress / traveled >= 0.001 AND progress >= 1.0""", "start_t stop_t directedness progress")
def directed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geometry.distance(F.col("x"), F.col("y"), F.lit(60.0), F.lit(50.0))
    return navigation.directed_runs(samples(spark, sf_dir), d, 0.001, 1.0, SPAN)


WINDOWS = f"SELECT s.session, s.idx, s.t, s.x, s.y FROM samples s JOIN (SELECT session, min(t) AS entry_t FROM ({ENTRIES}) GROUP BY session) e USING (session) WHERE s.t >= entry_t - 345600.0 AND s.t < entry_t"
WINDOW_STEPS = f"""SELECT *, nt - t AS dt, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS len, atan2(ny - y, nx - x) AS h FROM (
  SELECT *, lead(t) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM ({WINDOWS}) WINDOW w AS (PARTITION BY session ORDER BY t, idx))"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.decision_window(samples(spark, sf_dir), regions.contains(F.col("x"), F.col("y"), BOX), 4 * DAY, SPAN).select("session", "idx", "t", "x", "y")


@named(f"""SELECT session, n, duration, mean_speed * 1e6 AS mean_e6, min_speed * 1e6 AS min_e6, direction, 1 - length AS variance, length FROM (
  SELECT session, count(*) AS n, max(t) - min(t) AS duration, coalesce(avg(s), 0.0) AS mean_speed, coalesce(min(s), 0.0) AS min_speed, coalesce(atan2(sum(sin(h)), sum(cos(h))), 0.0) AS direction, coalesce(sqrt(pow(sum(sin(h)), 2) + pow(sum(cos(h)), 2)) / count(h), 0.0) AS length
  FROM (SELECT session, t, CASE WHEN dt > 0 THEN len / dt WHEN dt = 0 THEN 0.0 END AS s, h FROM ({WINDOW_STEPS})) GROUP BY session)""", "duration mean_e6 min_e6 direction variance length")
def pre_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = navigation.pre_decision(_windows(spark, sf_dir), 0.0, SPAN)
    return d.withColumns({"mean_e6": F.col("mean_speed") * 1e6, "min_e6": F.col("min_speed") * 1e6}).drop("mean_speed", "min_speed")


@named(f"""SELECT session AS trial, coalesce(sum(abs(fmod(fmod(h - ph + {PI}, 2 * {PI}) + 2 * {PI}, 2 * {PI}) - {PI})), 0.0) AS sweep, avg(s) * 1e6 AS speed_e6 FROM (
  SELECT session, h, CASE WHEN dt > 0 THEN len / dt ELSE 0.0 END AS s, lag(h) OVER (PARTITION BY session ORDER BY t, idx) AS ph FROM ({WINDOW_STEPS}) WHERE dt IS NOT NULL) GROUP BY session""", "sweep speed_e6")
def vicarious_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = navigation.vicarious_trials(_windows(spark, sf_dir), SPAN)
    return d.select("trial", "sweep", (F.col("speed") * 1e6).alias("speed_e6"))


RUNS = """SELECT session, t AS start_t, CASE WHEN coalesce(stop_t <= t + 259200.0, false) THEN stop_t ELSE t + 259200.0 END AS stop_t, coalesce(stop_t <= t + 259200.0, false) AS success FROM (
  SELECT s.session, s.t, (SELECT min(e.t) FROM (SELECT session, t FROM (SELECT *, lag(inside) OVER (PARTITION BY session ORDER BY t, idx) AS before FROM (SELECT *, {to} AS inside FROM samples)) WHERE inside AND NOT before) e WHERE e.session = s.session AND e.t >= s.t) AS stop_t
  FROM (SELECT session, t FROM (SELECT *, lag(inside) OVER (PARTITION BY session ORDER BY t, idx) AS before FROM (SELECT *, {start} AS inside FROM samples)) WHERE before AND NOT inside) s)"""
OUT, BACK = RUNS.replace("{start}", "x < 30").replace("{to}", "x > 60"), RUNS.replace("{start}", "x > 60").replace("{to}", "x < 30")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.runs_between(samples(spark, sf_dir), F.col("x") < 30, F.col("x") > 60, 3 * DAY, SPAN)


@named(f"SELECT s.session, s.idx, arg_max(CASE WHEN success THEN stop_t - s.t END, (start_t, stop_t)) AS remaining FROM samples s JOIN ({OUT}) r ON r.session = s.session AND s.t BETWEEN start_t AND stop_t GROUP BY ALL".replace("arg_max(CASE", "arg_max_null(CASE"), "remaining")
def time_to_goal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.time_to_goal(samples(spark, sf_dir), _runs(spark, sf_dir), 3 * DAY)


@named(f"""SELECT s.session, s.idx, coalesce(way, 'other') AS label FROM samples s LEFT JOIN (SELECT s.session, s.idx, arg_max(way, (start_t, stop_t, way)) AS way
  FROM samples s JOIN (SELECT *, 'outbound' AS way FROM ({OUT}) UNION ALL SELECT *, 'inbound' FROM ({BACK})) r ON success AND r.session = s.session AND s.t BETWEEN start_t AND stop_t GROUP BY ALL) USING (session, idx)""")
def running_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.running_direction(samples(spark, sf_dir), F.col("x") < 30, F.col("x") > 60, 3 * DAY, 3 * DAY, SPAN)


LAPS = f"SELECT session, t AS start_t, n AS stop_t FROM (SELECT session, t, lead(t) OVER (PARTITION BY session ORDER BY t, idx) AS n FROM ({ENTRIES})) WHERE n IS NOT NULL"


@named(f"""SELECT s.session, s.idx, coalesce(label, 'none') AS label FROM samples s LEFT JOIN (SELECT s.session, s.idx, arg_max(label, (start_t, stop_t, label)) AS label
  FROM samples s JOIN (SELECT *, CASE WHEN stop_t - start_t > 172800 THEN 'long' ELSE 'short' END AS label FROM ({LAPS})) r ON r.session = s.session AND s.t BETWEEN start_t AND stop_t GROUP BY ALL) USING (session, idx)""")
def lap_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    laps = behavior.laps(samples(spark, sf_dir), regions.contains(F.col("x"), F.col("y"), BOX), SPAN)
    label = F.when(F.col("stop_t") - F.col("start_t") > 2 * DAY, "long").otherwise("short")
    return navigation.interval_direction_labels(samples(spark, sf_dir), laps, label, 3 * DAY, "none")


@named("""WITH v AS (SELECT p.session, p.idx, p.t, b.x, b.y FROM (SELECT *, lag(bin_id) OVER (PARTITION BY session ORDER BY t, idx) AS pb FROM placed WHERE bin_id >= 0) p JOIN bins b USING (bin_id) WHERE pb IS NULL OR pb <> bin_id),
  c AS (SELECT session, idx, t, (ax * by_ - ay * bx) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_)) AS c FROM (
    SELECT *, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_ FROM v WINDOW w AS (PARTITION BY session ORDER BY t, idx)) WHERE ax IS NOT NULL AND bx IS NOT NULL)
  SELECT session, string_agg(CASE WHEN c < 0 THEN 'left' ELSE 'right' END, '-' ORDER BY t, idx) AS turns FROM c WHERE abs(c) > 0.1 GROUP BY session""")
def turn_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return navigation.turn_sequence(grids.bin_at(samples(spark, sf_dir), g).select("session", "idx", "t", "bin_id"), g.bins, span=SPAN)


@named("""SELECT idx, cos(heading) AS ahead_x, sin(heading) AS ahead_y FROM (SELECT idx, CASE WHEN n IS NULL THEN p WHEN p IS NULL THEN n ELSE p + CASE WHEN nt > pt THEN (t - pt) / (nt - pt) ELSE 0 END * d - CASE WHEN p + CASE WHEN nt > pt THEN (t - pt) / (nt - pt) ELSE 0 END * d >= {PI} THEN 2 * {PI} WHEN p + CASE WHEN nt > pt THEN (t - pt) / (nt - pt) ELSE 0 END * d < -{PI} THEN -2 * {PI} ELSE 0 END END AS heading FROM (
  SELECT *, fmod(fmod(n - p + {PI}, 2 * {PI}) + 2 * {PI}, 2 * {PI}) - {PI} AS d FROM (
    SELECT idx, t, last_value(h IGNORE NULLS) OVER b AS p, last_value(ht IGNORE NULLS) OVER b AS pt, first_value(h IGNORE NULLS) OVER f AS n, first_value(ht IGNORE NULLS) OVER f AS nt
    FROM (SELECT *, CASE WHEN h IS NOT NULL THEN t END AS ht FROM (SELECT *, CASE WHEN idx % 4 <> 0 THEN atan2(y - 50.0, x - 60.0) END AS h FROM samples))
    WINDOW b AS (PARTITION BY session ORDER BY t, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY session ORDER BY t, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))))""".replace("{PI}", PI), "ahead_x ahead_y")
def body_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a marker at (60, 50) to the sample; each fourth is taken as unseen."""
    seen = F.pmod("idx", F.lit(4)) != 0
    d = samples(spark, sf_dir).withColumns({"bx": F.when(seen, F.lit(60.0)), "by_": F.lit(50.0)})
    return navigation.body_heading(d, ("bx", "by_"), ("x", "y"), span=SPAN).select("idx", F.cos("heading").alias("ahead_x"), F.sin("heading").alias("ahead_y"))


@named()
def shifted_place_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.shifted_place_fields(_rates(spark, sf_dir), grid(spark, sf_dir).bins, (10, 10), 5)
