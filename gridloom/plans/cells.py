"""Queries on cell types, tuning to objects and views, fields and populations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.moments import correlation_sql
from ..operators import cells, encoding, grid as grids
from .activity import INSIDE, TUNING, _counts, _rates, _tuning, _unit_rates, fields_sql
from .catalog import MAX_GAP, SPAN, grid, named, path, samples, spikes

PI = f"{math.pi}::DOUBLE"
OBJECTS = [(40.0, 50.0), (120.0, 50.0)]
RINGS, TURNS = (0.0, 100.0, 5), 8
def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.place_fields(_rates(spark, sf_dir), grid(spark, sf_dir).edges, 0.5)


#: Of a table of rates: (unit, information).
INFORMATION = """SELECT unit, greatest(0.0, coalesce(sum(CASE WHEN rate > 0 THEN p * rate / mean * log2(rate / mean) END), 0.0)) AS information, max(mean) AS mean FROM (
  SELECT *, sum(p * rate) OVER (PARTITION BY unit) AS mean FROM (SELECT *, CASE WHEN rate IS NOT NULL THEN seconds END / sum(CASE WHEN rate IS NOT NULL THEN seconds END) OVER (PARTITION BY unit) AS p FROM ({rates}))) GROUP BY unit"""
STATE_RATES = """SELECT u.unit, b.bin_id, coalesce(c.n, 0) AS n, coalesce(o.seconds, 0.0) AS seconds, CASE WHEN o.seconds > 0 THEN coalesce(c.n, 0) / o.seconds END AS rate
  FROM ({bins}) b CROSS JOIN (SELECT DISTINCT unit FROM spikes) u LEFT JOIN (SELECT bin_id, sum(dt) AS seconds FROM ({states}) WHERE bin_id >= 0 GROUP BY bin_id) o ON o.bin_id = b.bin_id
  LEFT JOIN (SELECT unit, bin_id, count(*) AS n FROM spikes s ASOF JOIN ({states}) p ON s.session = p.session AND s.t >= p.t WHERE bin_id >= 0 AND s.t <= p.t + p.dt GROUP BY ALL) c ON c.unit = u.unit AND c.bin_id = b.bin_id"""
EGO_STATES = f"""SELECT session, t, dt, CASE WHEN r < 100 THEN floor(r / 20.0)::BIGINT * 8 + floor((b + {PI}) / (2 * {PI} / 8))::BIGINT % 8 ELSE -1 END AS bin_id FROM (
  SELECT session, t, dt, CASE WHEN r1 <= r2 THEN r1 ELSE r2 END AS r, CASE WHEN r1 <= r2 THEN b1 ELSE b2 END AS b FROM (
    SELECT session, t, dt, sqrt((40 - x) * (40 - x) + (50 - y) * (50 - y)) AS r1, sqrt((120 - x) * (120 - x) + (50 - y) * (50 - y)) AS r2,
           atan2(cos(h) * (50 - y) - sin(h) * (40 - x), cos(h) * (40 - x) + sin(h) * (50 - y)) AS b1, atan2(cos(h) * (50 - y) - sin(h) * (120 - x), cos(h) * (120 - x) + sin(h) * (50 - y)) AS b2
    FROM (SELECT *, atan2(next_y - y, next_x - x) AS h FROM path WHERE dt IS NOT NULL)))"""
EGO_RATES = STATE_RATES.replace("{bins}", "SELECT range AS bin_id FROM range(0, 40)").replace("{states}", EGO_STATES)
VIEW_STATES = """SELECT session, t, dt, coalesce(b.bin_id, -1) AS bin_id FROM (SELECT session, t, dt, x + 25.0 * cos(h) AS vx, y + 25.0 * sin(h) AS vy FROM (SELECT *, atan2(next_y - y, next_x - x) AS h FROM path WHERE dt IS NOT NULL)) v
  LEFT JOIN bins b ON vx >= 0 AND vx < 200 AND vy >= 0 AND vy < 100 AND b.cell = floor(vx / 20.0)::BIGINT * 10 + floor(vy / 10.0)::BIGINT"""
VIEW_RATES = STATE_RATES.replace("{bins}", "SELECT bin_id FROM bins").replace("{states}", VIEW_STATES)


def _ego(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bins = grids.polar_bins(spark, RINGS, TURNS)
    states = cells.egocentric_states(path(spark, sf_dir), OBJECTS, RINGS, TURNS, SPAN)
    return cells.egocentric_rates(spikes(spark, sf_dir), states, bins, span=SPAN), bins


@named(f"SELECT unit, bin_id, n, seconds, rate * 1e6 AS rate_e6 FROM ({EGO_RATES})", "seconds rate_e6")
def egocentric_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ego(spark, sf_dir)[0].withColumn("rate_e6", F.col("rate") * 1e6).drop("rate")


@named(f"""SELECT unit, preferred_distance, preferred_direction, information, coalesce(s * r, 0.0) AS score, information > 0.3 AS object_vector FROM (
  SELECT unit, (arg_min(bin_id, (-rate, bin_id)) // 8 + 0.5) * 20.0::DOUBLE AS preferred_distance, (arg_min(bin_id, (-rate, bin_id)) % 8 + 0.5) * (2 * {PI} / 8) - {PI} AS preferred_direction,
    least(1.0, greatest(0.0, (max(rate) / avg(rate) - 1) / 9.0)) AS s, sqrt(pow(sum(rate * sin(a)), 2) + pow(sum(rate * cos(a)), 2)) / sum(rate) AS r
  FROM (SELECT *, (bin_id % 8 + 0.5) * (2 * {PI} / 8) - {PI} AS a FROM ({EGO_RATES})) WHERE rate IS NOT NULL GROUP BY unit) JOIN ({INFORMATION.replace("{rates}", EGO_RATES)}) USING (unit)""", "preferred_distance preferred_direction information score")
def object_vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.object_vector_cells(*_ego(spark, sf_dir))


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return cells.view_rates(spikes(spark, sf_dir), cells.view_states(path(spark, sf_dir), g, 25.0, SPAN), g, span=SPAN)


@named(f"SELECT unit, bin_id, n, seconds, rate * 1e6 AS rate_e6 FROM ({VIEW_RATES})", "seconds rate_e6")
def view_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir).withColumn("rate_e6", F.col("rate") * 1e6).drop("rate")


@named(f"""SELECT unit, x, y, rate * 1e6 AS peak_e6, information, information > 0.5 AS spatial_view FROM (SELECT unit, arg_min(bin_id, (-rate, bin_id)) AS bin_id, max(rate) AS rate FROM ({VIEW_RATES}) WHERE rate IS NOT NULL GROUP BY unit)
  JOIN bins USING (bin_id) JOIN ({INFORMATION.replace("{rates}", VIEW_RATES)}) USING (unit)""", "x y peak_e6 information")
def view_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cells.view_cells(_views(spark, sf_dir), grid(spark, sf_dir))
    return d.withColumn("peak_e6", F.col("peak_rate") * 1e6).drop("peak_rate")


@named(f"""SELECT unit, preferred, length, CASE WHEN n >= 3 THEN least(1.0, greatest(0.0, exp(-z) * CASE WHEN n < 50 THEN 1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z * z + 76 * pow(z, 3) - 9 * pow(z, 4)) / (288 * n * n) ELSE 1.0 END)) END AS p,
    coalesce(length > 0.1 AND exp(-z) < 0.05, false) AS head_direction FROM (
  SELECT unit, atan2(sum(r * sin(c)), sum(r * cos(c))) AS preferred, sqrt(pow(sum(r * sin(c)), 2) + pow(sum(r * cos(c)), 2)) / sum(r) AS length, sum(k) AS n, (pow(sum(k * sin(c)), 2) + pow(sum(k * cos(c)), 2)) / sum(k) AS z
  FROM (SELECT unit, (bin + 0.5) * (2 * {PI} / 12) AS c, coalesce(rate, 0.0) AS r, CASE WHEN rate IS NULL THEN 0 ELSE n END AS k FROM ({TUNING})) GROUP BY unit)""", "preferred length p")
def direction_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.direction_cells(_tuning(spark, sf_dir), 12, min_length=0.1).select("unit", "preferred", "length", "p", "head_direction")


@named(f"""WITH t AS (SELECT unit, bin, rate FROM ({TUNING}) WHERE rate IS NOT NULL), pk AS (SELECT unit, max(rate) AS top, arg_min(bin, (-rate, bin)) AS top_bin FROM t GROUP BY unit),
  s AS (SELECT unit, side, ((side * (bin - top_bin)) % 12 + 12) % 12 AS k, rate, top / 2 AS half FROM t JOIN pk USING (unit) CROSS JOIN (VALUES (1), (-1)) v(side)),
  f AS (SELECT unit, side, min(k) AS k FROM s WHERE k BETWEEN 1 AND 6 AND rate < half GROUP BY ALL),
  w AS (SELECT f.unit, f.side, (a.k + (a.half - a.rate) / (b.rate - a.rate) * (f.k - a.k)) * (2 * {PI} / 12) AS w FROM f JOIN s b ON b.unit = f.unit AND b.side = f.side AND b.k = f.k
    JOIN (SELECT f.unit, f.side, max(s.k) AS k FROM f JOIN s ON s.unit = f.unit AND s.side = f.side AND s.k < f.k GROUP BY ALL) l ON l.unit = f.unit AND l.side = f.side JOIN s a ON a.unit = l.unit AND a.side = l.side AND a.k = l.k)
  SELECT pk.unit, avg(w) AS width FROM pk LEFT JOIN w USING (unit) GROUP BY pk.unit""", "width")
def tuning_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.tuning_width(_tuning(spark, sf_dir), 12)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path(spark, sf_dir).select("session", "idx", F.when(F.pmod("idx", F.lit(5)) != 0, F.when(F.pmod("idx", F.lit(2)) == 0, "left").otherwise("right")).alias("label"))


LABELLED = "SELECT *, CASE WHEN idx % 5 <> 0 THEN CASE WHEN idx % 2 = 0 THEN 'left' ELSE 'right' END END AS label FROM path"
DIRECTED = f"""WITH d AS (SELECT * FROM ({LABELLED}) WHERE dt <= {MAX_GAP} AND label IS NOT NULL AND bin_id >= 0), o AS (SELECT label, bin_id, sum(dt) AS seconds FROM d GROUP BY ALL),
  s AS (SELECT unit, label, x + (s.t - d.t) / dt * (next_x - x) AS x, y + (s.t - d.t) / dt * (next_y - y) AS y FROM spikes s ASOF JOIN d ON s.session = d.session AND s.t >= d.t WHERE s.t <= d.t + dt),
  c AS (SELECT label, unit, b.bin_id, count(*) AS n FROM s JOIN bins b ON s.x >= 0 AND s.x < 200 AND s.y >= 0 AND s.y < 100 AND b.cell = floor(s.x / 20.0)::BIGINT * 10 + floor(s.y / 10.0)::BIGINT GROUP BY ALL)
  SELECT l.label, u.unit, b.bin_id, coalesce(c.n, 0) AS n, coalesce(o.seconds, 0.0) AS seconds, CASE WHEN o.seconds > 0 THEN coalesce(c.n, 0) / o.seconds END AS rate
  FROM bins b CROSS JOIN (SELECT DISTINCT label FROM o) l CROSS JOIN (SELECT DISTINCT unit FROM spikes) u LEFT JOIN o ON o.label = l.label AND o.bin_id = b.bin_id LEFT JOIN c ON c.label = l.label AND c.unit = u.unit AND c.bin_id = b.bin_id"""


def _directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.directional_rates(spikes(spark, sf_dir), path(spark, sf_dir), grid(spark, sf_dir), _labels(spark, sf_dir), MAX_GAP, SPAN)


@named(f"SELECT label, unit, bin_id, n, seconds, rate * 1e6 AS rate_e6 FROM ({DIRECTED})", "seconds rate_e6")
def directional_place_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _directed(spark, sf_dir).withColumn("rate_e6", F.col("rate") * 1e6).drop("rate")


@named(f"""SELECT a.unit, corr(a.rate, b.rate) AS r, avg(CASE WHEN a.rate + b.rate > 0 THEN abs(a.rate - b.rate) / (a.rate + b.rate) END) AS directionality
  FROM ({DIRECTED}) a JOIN ({DIRECTED}) b ON a.unit = b.unit AND a.bin_id = b.bin_id AND a.label = 'left' AND b.label = 'right' WHERE a.rate IS NOT NULL AND b.rate IS NOT NULL GROUP BY a.unit""", "r directionality")
def directionality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.compare_directions(_directed(spark, sf_dir), "left", "right")


@named(f"""SELECT unit, mean * 1e6 AS mean_e6, information, coalesce(k, 0) AS fields, coalesce(k, 0) > 0 AS place, information > 0.5 AS informative
  FROM ({INFORMATION.replace("{rates}", "SELECT * FROM rates")}) LEFT JOIN (SELECT unit, count(DISTINCT field) AS k FROM ({fields_sql(0.5)}) GROUP BY unit) USING (unit)""", "mean_e6 information")
def cell_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cells.cell_types(_rates(spark, sf_dir), grid(spark, sf_dir).edges, share=0.5)
    return d.withColumn("mean_e6", F.col("mean_rate") * 1e6).drop("mean_rate")


@named(f"SELECT bin_id, count(DISTINCT unit) AS n FROM bins LEFT JOIN ({INSIDE.replace('{share}', '0.5')}) USING (bin_id) GROUP BY bin_id")
def field_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.field_density(_fields(spark, sf_dir), grid(spark, sf_dir).bins)


@named(f"""WITH f AS ({fields_sql(0.5)}), d AS (SELECT bin_id, count(DISTINCT unit) AS n FROM bins LEFT JOIN f USING (bin_id) GROUP BY bin_id)
  SELECT (SELECT count_if(n > 0) / count(*) FROM d) AS coverage, (SELECT count(DISTINCT unit) FROM f) / (SELECT count(DISTINCT unit) FROM spikes) AS place_share,
    (SELECT avg(k) FROM (SELECT count(DISTINCT field) AS k FROM f GROUP BY unit)) AS fields_a_cell, (SELECT avg(n) FROM d WHERE n > 0) AS redundancy""", "coverage place_share fields_a_cell redundancy")
def population_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.population_coverage(_fields(spark, sf_dir), grid(spark, sf_dir).bins, spikes(spark, sf_dir))


@named(f"""WITH f AS ({INSIDE.replace('{share}', '0.5').replace('FROM rates', 'FROM unit_rates')}), n AS (SELECT unit, count(*) AS n FROM f GROUP BY unit)
  SELECT unit_a, unit_b, k / (a.n + b.n - k) AS jaccard FROM (SELECT p.unit AS unit_a, q.unit AS unit_b, count(*) AS k FROM f p JOIN f q ON p.bin_id = q.bin_id AND p.unit < q.unit GROUP BY ALL) JOIN n a ON a.unit = unit_a JOIN n b ON b.unit = unit_b""", "jaccard")
def field_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.field_overlap(encoding.field_bins(_unit_rates(spark, sf_dir), 0.5))


@named(f"""WITH m AS (SELECT unit, field, sum(rate * x) / sum(rate) AS x, sum(rate * y) / sum(rate) AS y, sum(rate * x * x) / sum(rate) AS xx, sum(rate * y * y) / sum(rate) AS yy, sum(rate * x * y) / sum(rate) AS xy, count(*) AS n_bins FROM ({fields_sql(0.5)}) JOIN bins USING (bin_id) GROUP BY ALL),
  e AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS large, greatest(0.0, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b)) AS small FROM (SELECT *, xx - x * x AS a, xy - x * y AS b, yy - y * y AS c FROM m))
  SELECT unit, field, x, y, n_bins, large AS across_large, small AS across_small FROM e""".replace("across_large", "large").replace("across_small", "small"), "x y large small")
def field_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centers and the squares of half the axes, which keep their digits near zero."""
    d = cells.field_shapes(_fields(spark, sf_dir), grid(spark, sf_dir).bins)
    return d.select("unit", "field", "x", "y", "n_bins", F.pow(F.col("major") / 2, 2).alias("large"), F.pow(F.col("minor") / 2, 2).alias("small"))


@named("""WITH c AS (SELECT unit, k, sum(rate * x) / sum(rate) AS x, sum(rate * y) / sum(rate) AS y FROM (SELECT unit, k.range AS k, CASE WHEN k.range = 0 OR x > 60 THEN rate END AS rate, x, y FROM rates JOIN bins USING (bin_id) CROSS JOIN range(0, 2) k) WHERE rate IS NOT NULL GROUP BY ALL)
  SELECT a.unit, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS shift FROM c a JOIN c b ON a.unit = b.unit AND a.k = 0 AND b.k = 1""", "shift")
def field_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each map against its part right of x = 60."""
    g, r = grid(spark, sf_dir), _rates(spark, sf_dir)
    right = r.join(g.bins.where("x > 60").select("bin_id"), "bin_id", "left_semi")
    return cells.field_shift(r, right, g.bins)


@named("""WITH p AS (SELECT unit, (bin_id * 5.0)::DOUBLE AS position, bin_id, coalesce(rate, 0.0) AS ra, CASE WHEN bin_id % 2 = 0 THEN coalesce(rate, 0.0) ELSE 0.0 END AS rb FROM rates),
  q AS (SELECT *, ra / sum(ra) OVER w - rb / sum(rb) OVER w AS d, lead(position) OVER (PARTITION BY unit ORDER BY position) - position AS gap FROM p WINDOW w AS (PARTITION BY unit))
  SELECT unit, sum(abs(s) * gap) AS cost FROM (SELECT *, sum(d) OVER (PARTITION BY unit ORDER BY position) AS s FROM q) GROUP BY unit""", "cost")
def track_shift_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each map, its bins taken as a track, against its even bins alone."""
    r = _rates(spark, sf_dir)
    even = r.withColumn("rate", F.when(F.col("bin_id") % 2 == 0, F.col("rate")))
    return cells.track_shift_cost(r, even, r.select("bin_id").distinct().withColumn("position", F.col("bin_id") * 5.0))


@named(f"""WITH f AS ({INSIDE.replace('{share}', '0.5')}), r AS (SELECT bin_id, CASE WHEN x < 60 THEN 'west' ELSE 'east' END AS region FROM bins)
  SELECT u.unit, z.region, count(f.bin_id) / z.n AS coverage FROM (SELECT DISTINCT unit FROM f) u CROSS JOIN (SELECT region, count(*) AS n FROM r GROUP BY region) z LEFT JOIN (SELECT f.unit, f.bin_id, r.region FROM f JOIN r USING (bin_id)) f ON f.unit = u.unit AND f.region = z.region GROUP BY u.unit, z.region, z.n""", "coverage")
def region_field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    member = grid(spark, sf_dir).bins.select(F.when(F.col("x") < 60, "west").otherwise("east").alias("region"), "bin_id")
    return cells.region_coverage(_fields(spark, sf_dir), member)


@named(f"""SELECT unit, ring, r, n FROM (SELECT a.unit, floor(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) / 25.0)::BIGINT AS ring, {correlation_sql("a.rate", "b.rate")} AS r, count(*) AS n
  FROM rates a JOIN rates b ON a.unit = b.unit AND a.bin_id < b.bin_id JOIN bins p ON p.bin_id = a.bin_id JOIN bins q ON q.bin_id = b.bin_id WHERE a.rate IS NOT NULL AND b.rate IS NOT NULL GROUP BY ALL) WHERE n >= 2""", "r")
def radial_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of bins by straight distance; their number is the square of the bins', whatever the samples."""
    g = grid(spark, sf_dir)
    a, b = (g.bins.select(F.col("bin_id").alias(k), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k in "ab")
    apart = F.sqrt((F.col("xa") - F.col("xb")) * (F.col("xa") - F.col("xb")) + (F.col("ya") - F.col("yb")) * (F.col("ya") - F.col("yb")))
    return cells.radial_autocorrelation(_rates(spark, sf_dir), a.join(b, F.col("a") < F.col("b")).select("a", "b", apart.alias("distance")), 25.0)


@named(f"""WITH s AS (SELECT session % 4 AS unit, x / 100 AS position, y / 100 * 2 * {PI} AS phase FROM samples), g AS (SELECT unit, range AS k, -2.0 + range * 0.1 AS slope, phase - (-2.0 + range * 0.1) * position AS a FROM s CROSS JOIN range(0, 41)),
  r AS (SELECT unit, k, sqrt(pow(sum(sin(a)), 2) + pow(sum(cos(a)), 2)) / count(*) AS r FROM g GROUP BY ALL), b AS (SELECT unit, arg_min(k, (-round(r, 12), k)) AS k, max(r) AS r FROM r GROUP BY unit),
  c AS (SELECT unit, count(*) AS n, corr(position, cos(phase)) AS rc, corr(position, sin(phase)) AS rs, corr(sin(phase), cos(phase)) AS cs FROM s GROUP BY unit)
  SELECT unit, n, -2.0 + k * 0.1::DOUBLE AS slope, r, sqrt(least(1.0, greatest(0.0, (rc * rc + rs * rs - 2 * rc * rs * cs) / (1 - cs * cs)))) AS correlation FROM b JOIN c USING (unit)""", "slope r correlation")
def phase_precession(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).select(F.pmod("session", F.lit(4)).alias("unit"), (F.col("x") / 100).alias("position"), (F.col("y") / 100 * (2 * math.pi)).alias("phase"))
    return cells.phase_precession(rows, (-2.0, 2.0, 41)).select("unit", "n", "slope", "r", "correlation")


@named("""WITH b AS (SELECT unit, avg(n) AS m, stddev_pop(n) AS sd FROM unit_counts WHERE t_idx < 60 GROUP BY unit), a AS (SELECT t_idx, abs(sum((unit + 1) / 8.0 * (n - m) / CASE WHEN sd > 1e-10 THEN sd ELSE 1 END)) AS a FROM unit_counts JOIN b USING (unit) GROUP BY t_idx)
  SELECT avg(CASE WHEN t_idx >= 60 THEN a END) / avg(CASE WHEN t_idx < 60 THEN a END) AS strength FROM a""", "strength")
def reactivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of the recording against the first, for one made-up assembly."""
    c = _counts(spark, sf_dir)
    units = spark.range(8).select(F.col("id").alias("unit"), ((F.col("id") + 1) / 8.0).alias("w"))
    frame = spark.range(120).select(F.col("id").alias("t_idx")).crossJoin(units.select("unit")).join(c, ["t_idx", "unit"], "left").select("t_idx", "unit", F.coalesce("n", F.lit(0)).alias("n"))
    return cells.reactivation(frame.where("t_idx < 60"), frame.where("t_idx >= 60"), units)
