"""What the named queries share: their samples, grid and the SQL that names the same tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import Grid, regular_grid
from ..sources.tables import event_samples

#: Gaps between a user's events are hours, so an interval may last up to two days.
MAX_GAP = 172_800.0
#: Stretches of time that a session's rows are cut into.
SPAN = 864_000.0
LO, WIDTH, SHAPE = (0.0, 0.0), (20.0, 10.0), (10, 10)
MIN_COUNT = 3
START, STOP = 1_704_067_200.0, 1_706_659_200.0

Query = Callable[[SparkSession, str], DataFrame]


class Named(NamedTuple):
    query: Query
    sql: str | None


CATALOG: dict[str, Named] = {}


def named(sql: str | None = None, doubles: str = "") -> Callable[[Query], Query]:
    """Register a query under its function's name; ``doubles`` lists columns that both sides round to 6 places."""
    columns = doubles.split()

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            d = f(spark, sf_dir)
            return d.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})

        run.__name__ = f.__name__
        run.__doc__ = f.__doc__
        text = None
        if sql is not None:
            replaced = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)
            text = f"WITH RECURSIVE {BASE} SELECT *{f' REPLACE ({replaced})' if replaced else ''} FROM ({sql})"
        CATALOG[f.__name__] = Named(run, text)
        return f

    return add


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_samples(spark, sf_dir)


def grid(spark: SparkSession, sf_dir: str) -> Grid:
    return regular_grid(spark, LO, WIDTH, SHAPE, samples(spark, sf_dir), MIN_COUNT)


def path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectory: events that are not spikes."""
    return samples(spark, sf_dir).where(F.col("event_type").isin("view", "click", "signup")).drop("event_type")


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).where(F.col("event_type").isin("purchase", "error"))
    return s.select("session", F.col("event_type").alias("unit"), "t")


BASE = """
samples AS (
  SELECT user_id AS session, event_id AS idx, epoch_us(ts) / 1e6 AS t, value AS x,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, event_type FROM events
), cells AS (
  SELECT *, CASE WHEN x >= 0 AND x < 200 AND y >= 0 AND y < 100
                 THEN floor(x / 20.0)::BIGINT * 10 + floor(y / 10.0)::BIGINT END AS cell FROM samples
), bins AS (
  SELECT row_number() OVER (ORDER BY cell) - 1 AS bin_id, cell, cell // 10 AS ix, cell % 10 AS iy,
         (cell // 10 + 0.5) * 20.0::DOUBLE AS x, (cell % 10 + 0.5) * 10.0::DOUBLE AS y, 200.0::DOUBLE AS area
  FROM (SELECT cell FROM cells WHERE cell IS NOT NULL GROUP BY cell HAVING count(*) >= 3)
), edges AS (
  SELECT a.bin_id AS src, b.bin_id AS dst, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS distance
  FROM bins a JOIN bins b ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND a.bin_id <> b.bin_id
), placed AS (
  SELECT c.*, coalesce(b.bin_id, -1) AS bin_id FROM cells c LEFT JOIN bins b USING (cell)
), stepped AS (
  SELECT *, next_t - t AS dt, sqrt((next_x - x) * (next_x - x) + (next_y - y) * (next_y - y)) AS length
  FROM (SELECT *, lead(t) OVER w AS next_t, lead(x) OVER w AS next_x, lead(y) OVER w AS next_y, lead(bin_id) OVER w AS next_bin,
               lag(t) OVER w AS prev_t, lag(x) OVER w AS prev_x, lag(y) OVER w AS prev_y, lag(bin_id) OVER w AS prev_bin
        FROM placed WINDOW w AS (PARTITION BY session ORDER BY t, idx))
), valid AS (
  SELECT * FROM stepped WHERE dt IS NOT NULL AND bin_id >= 0 AND dt <= 172800.0
), occupied AS (
  SELECT b.bin_id, coalesce(sum(v.dt), 0.0) AS seconds, count(v.dt) AS n FROM bins b LEFT JOIN valid v USING (bin_id) GROUP BY b.bin_id
), path AS (
  SELECT *, next_t - t AS dt FROM (
    SELECT session, idx, t, x, y, bin_id, lead(t) OVER w AS next_t, lead(x) OVER w AS next_x, lead(y) OVER w AS next_y
    FROM placed WHERE event_type IN ('view', 'click', 'signup') WINDOW w AS (PARTITION BY session ORDER BY t, idx))
), path_valid AS (
  SELECT * FROM path WHERE dt IS NOT NULL AND bin_id >= 0 AND dt <= 172800.0
), path_occupied AS (
  SELECT b.bin_id, coalesce(sum(v.dt), 0.0) AS seconds FROM bins b LEFT JOIN path_valid v USING (bin_id) GROUP BY b.bin_id
), spikes AS (
  SELECT session, event_type AS unit, t FROM samples WHERE event_type IN ('purchase', 'error')
), located AS (
  SELECT s.session, s.unit, s.t, p.x + (s.t - p.t) / p.dt * (p.next_x - p.x) AS x, p.y + (s.t - p.t) / p.dt * (p.next_y - p.y) AS y,
         p.bin_id AS from_bin, p.dt
  FROM spikes s ASOF JOIN path p ON s.session = p.session AND s.t >= p.t
  WHERE p.dt IS NOT NULL AND p.bin_id >= 0 AND p.dt <= 172800.0
), spike_bins AS (
  SELECT l.unit, l.session, l.t, b.bin_id FROM located l
  JOIN bins b ON l.x >= 0 AND l.x < 200 AND l.y >= 0 AND l.y < 100 AND b.cell = floor(l.x / 20.0)::BIGINT * 10 + floor(l.y / 10.0)::BIGINT
), rates AS (
  SELECT u.unit, o.bin_id, coalesce(c.n, 0) AS n, o.seconds, CASE WHEN o.seconds > 0 THEN coalesce(c.n, 0) / o.seconds END AS rate
  FROM path_occupied o CROSS JOIN (SELECT DISTINCT unit FROM spikes) u
  LEFT JOIN (SELECT unit, bin_id, count(*) AS n FROM spike_bins GROUP BY ALL) c ON c.unit = u.unit AND c.bin_id = o.bin_id
), shares AS (
  SELECT *, sum(p * rate) OVER (PARTITION BY unit) AS mean FROM (
    SELECT *, CASE WHEN rate IS NOT NULL THEN seconds END / sum(CASE WHEN rate IS NOT NULL THEN seconds END) OVER (PARTITION BY unit) AS p FROM rates)
), unit_counts AS (
  SELECT f.t_idx, f.unit, coalesce(c.n, 0) AS n
  FROM (SELECT u.unit, r.range AS t_idx FROM (SELECT DISTINCT session % 8 AS unit FROM samples) u CROSS JOIN range(0, 120) r) f
  LEFT JOIN (SELECT CASE WHEN t = 1706659200.0 THEN 119 ELSE floor((t - 1704067200.0) / 21600.0)::BIGINT END AS t_idx, session % 8 AS unit, count(*) AS n
             FROM samples GROUP BY ALL) c ON c.t_idx = f.t_idx AND c.unit = f.unit
), unit_rates AS (
  SELECT u.unit, o.bin_id, CASE WHEN o.seconds > 0 THEN coalesce(c.n, 0) / o.seconds * 20.0 END AS rate
  FROM occupied o CROSS JOIN (SELECT DISTINCT session % 8 AS unit FROM samples) u
  LEFT JOIN (SELECT session % 8 AS unit, bin_id, count(*) AS n FROM placed GROUP BY ALL) c ON c.unit = u.unit AND c.bin_id = o.bin_id
), floored AS (
  SELECT unit, bin_id, greatest(coalesce(rate, 0.0), 1e-10) AS rate FROM unit_rates
), ll AS (
  SELECT c.t_idx, r.bin_id, sum(c.n * ln(r.rate * 21600.0)) - sum(r.rate * 21600.0) AS ll
  FROM unit_counts c JOIN floored r USING (unit) GROUP BY ALL
), post AS (
  SELECT t_idx, bin_id, e / sum(e) OVER (PARTITION BY t_idx) AS p
  FROM (SELECT *, exp(ll - max(ll) OVER (PARTITION BY t_idx)) AS e FROM ll)
), best AS (
  SELECT t_idx, arg_max(bin_id, (p, -bin_id)) AS map_bin FROM post GROUP BY t_idx
), truth AS (
  SELECT CASE WHEN t = 1706659200.0 THEN 119 ELSE floor((t - 1704067200.0) / 21600.0)::BIGINT END AS t_idx, avg(x) AS x, avg(y) AS y, min(bin_id) AS bin_id
  FROM placed WHERE bin_id >= 0 GROUP BY ALL
), field AS (
  SELECT bin_id, seconds AS v FROM occupied
)
"""
