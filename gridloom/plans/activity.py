"""Queries on events, rate maps, decoding, circular statistics and behaviour."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.moments import correlation, correlation_sql
from ..operators import behavior, circular, decoding, encoding, events, regions, stats, tiles, trajectory
from ..operators import timeseries as ts
from .catalog import MAX_GAP, SPAN, START, STOP, grid, named, path, samples, spikes
from .spatial import BOX, IN_BOX, KERNEL

DAY = 86_400.0


def _typed(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    return samples(spark, sf_dir).where(F.col("event_type").isin(*types))


@named("""SELECT a.idx, b.idx AS ref_idx, a.t - b.t AS relative_t FROM samples a JOIN samples b ON a.session = b.session AND a.t >= b.t - 86400.0 AND a.t <= b.t + 172800.0
  WHERE a.event_type = 'click' AND b.event_type = 'signup'""", "relative_t")
def align_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _typed(spark, sf_dir, "signup").select("session", "idx", "t")
    return events.align(_typed(spark, sf_dir, "click"), refs, (-DAY, 2 * DAY), ["session"]).select("idx", "ref_idx", "relative_t")


PERI = """SELECT a.event_type AS unit, b.idx AS ref_id, CASE WHEN a.t - b.t = 172800.0 THEN 7 ELSE floor((a.t - b.t + 172800.0) / 43200.0)::BIGINT END AS bin
  FROM samples a JOIN samples b ON a.session = b.session AND a.t >= b.t - 172800.0 AND a.t <= b.t + 172800.0 WHERE a.event_type IN ('click', 'view') AND b.event_type = 'signup'"""


@named(f"""SELECT unit, bin, -172800.0::DOUBLE + (bin + 0.5) * 43200.0 AS center, sum(n) / count(*) AS mean, stddev_samp(n) / sqrt(count(*)) AS sem, sum(n) / count(*) / 43200.0 * 1e6 AS rate_e6, count(*) AS n_events FROM (
  SELECT u.unit, k.range AS bin, r.idx, coalesce(c.n, 0) AS n FROM (SELECT unnest(['click', 'view']) AS unit) u CROSS JOIN range(0, 8) k
  CROSS JOIN (SELECT idx FROM samples WHERE event_type = 'signup') r
  LEFT JOIN (SELECT unit, ref_id, bin, count(*) AS n FROM ({PERI}) GROUP BY ALL) c ON c.unit = u.unit AND c.bin = k.range AND c.ref_id = r.idx) GROUP BY unit, bin""", "center mean sem rate_e6")
def population_psth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _typed(spark, sf_dir, "click", "view").select("session", F.col("event_type").alias("unit"), "t")
    refs = _typed(spark, sf_dir, "signup").select("session", F.col("idx").alias("ref_id"), "t")
    d = events.psth(s, refs, (-2 * DAY, 2 * DAY), DAY / 2, ["session"])
    return d.select("unit", "bin", "center", "mean", "sem", (F.col("rate") * 1e6).alias("rate_e6"), "n_events")


@named(f"SELECT u.unit, k.range AS bin, coalesce(c.n, 0) AS n FROM (SELECT unnest(['click', 'view']) AS unit) u CROSS JOIN range(0, 8) k LEFT JOIN (SELECT unit, bin, count(*) AS n FROM ({PERI}) GROUP BY ALL) c ON c.unit = u.unit AND c.bin = k.range")
def peri_event_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _typed(spark, sf_dir, "click", "view").select("session", F.col("event_type").alias("unit"), "t")
    refs = _typed(spark, sf_dir, "signup").select("session", F.col("idx").alias("ref_id"), "t")
    return events.peri_event_counts(s, refs, (-2 * DAY, 2 * DAY), DAY / 2, ["session"]).groupBy("unit", "bin").agg(F.sum("n").alias("n"))


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = _typed(spark, sf_dir, "purchase")
    return events.events_to_intervals(bought, bought, ["session"], 3 * DAY, SPAN)


INTERVALS = """SELECT session, t AS start_t, n AS stop_t, n - t AS duration FROM (SELECT session, t, lead(t) OVER (PARTITION BY session ORDER BY t) AS n FROM samples WHERE event_type = 'purchase') WHERE n - t <= 259200.0"""


@named(INTERVALS, "start_t stop_t duration")
def events_to_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(spark, sf_dir)


@named(f"SELECT session, 'start' AS boundary, start_t AS t FROM ({INTERVALS}) UNION ALL SELECT session, 'stop', stop_t FROM ({INTERVALS})", "t")
def intervals_to_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.intervals_to_events(_intervals(spark, sf_dir)).select("session", "boundary", "t")


def _filtered(include: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return events.filter_by_intervals(_typed(spark, sf_dir, "view"), _intervals(spark, sf_dir), include, DAY, ["session"]).select("idx")

    run.__name__ = f"filter_intervals_{'in' if include else 'out'}"
    return run


for _include in (True, False):
    named(f"SELECT idx FROM samples s WHERE event_type = 'view' AND {'' if _include else 'NOT '}EXISTS (SELECT 1 FROM ({INTERVALS}) i WHERE i.session = s.session AND s.t >= i.start_t AND s.t <= i.stop_t)")(_filtered(_include))


@named("""SELECT idx, CASE WHEN after IS NULL THEN -before WHEN before IS NULL OR after <= before THEN after ELSE -before END AS nearest_dt FROM (
  SELECT s.idx, s.t - (SELECT max(t) FROM samples e WHERE e.event_type = 'error' AND e.session = s.session AND e.t < s.t) AS after,
         (SELECT min(t) FROM samples e WHERE e.event_type = 'error' AND e.session = s.session AND e.t >= s.t) - s.t AS before FROM samples s WHERE event_type = 'view')""", "nearest_dt")
def time_to_nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.time_to_nearest(_typed(spark, sf_dir, "view"), _typed(spark, sf_dir, "error"), ["session"], True, SPAN).select("idx", "nearest_dt")


COUNTED = "SELECT idx, (SELECT count(*) FROM samples e WHERE e.event_type = 'click' AND e.session = s.session AND e.t >= s.t - 86400.0 AND e.t <= s.t + 86400.0) AS n FROM samples s WHERE event_type = 'view'"


@named(COUNTED)
def event_count_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.counts_in_window(_typed(spark, sf_dir, "view"), _typed(spark, sf_dir, "click"), (-DAY, DAY), "idx", ["session"])


@named(f"SELECT idx, n > 0 AS near FROM ({COUNTED})")
def event_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events.counts_in_window(_typed(spark, sf_dir, "view"), _typed(spark, sf_dir, "click"), (-DAY, DAY), "idx", ["session"])
    return d.select("idx", (F.col("n") > 0).alias("near"))


@named("""SELECT s.idx, CASE WHEN p.t = s.t THEN p.x ELSE p.x + (s.t - p.t) / (p.next_t - p.t) * (p.next_x - p.x) END AS at_x, CASE WHEN p.t = s.t THEN p.y ELSE p.y + (s.t - p.t) / (p.next_t - p.t) * (p.next_y - p.y) END AS at_y
  FROM (SELECT * FROM samples WHERE event_type IN ('purchase', 'error')) s ASOF LEFT JOIN path p ON s.session = p.session AND s.t >= p.t""", "at_x at_y")
def event_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _typed(spark, sf_dir, "purchase", "error").select("session", "idx", "t")
    return ts.interpolate(s, path(spark, sf_dir), ["session"], "t", ["x", "y"], SPAN).select("idx", "at_x", "at_y")


@named("SELECT idx, t - lag(t) OVER (PARTITION BY session ORDER BY t, idx) AS interval FROM samples", "interval")
def inter_event_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.inter_event(samples(spark, sf_dir), ["session"], SPAN).select("idx", "interval")


# Rate maps


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.rate_map(spikes(spark, sf_dir), path(spark, sf_dir), grid(spark, sf_dir), MAX_GAP, span=SPAN)


@named("SELECT unit, bin_id, n, seconds, rate * 1e6 AS rate_e6 FROM rates", "seconds rate_e6")
def rate_map_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: spikes a second of each unit in each bin."""
    return _rates(spark, sf_dir).select("unit", "bin_id", "n", "seconds", (F.col("rate") * 1e6).alias("rate_e6"))


@named("""SELECT unit, max(mean) * 1e6 AS mean_rate, max(rate) * 1e6 AS peak_rate, greatest(0.0, sum(CASE WHEN rate > 0 THEN p * rate / mean * log2(rate / mean) END)) AS information,
  greatest(0.0, sum(CASE WHEN rate > 0 THEN p * rate / mean * log2(rate / mean) END)) * max(mean) * 1e6 AS information_per_second,
  pow(sum(p * rate), 2) / sum(p * rate * rate) AS sparsity, max(rate) / max(mean) AS selectivity, count_if(rate > 0) / count(*) AS coverage FROM shares GROUP BY unit""",
  "mean_rate peak_rate information information_per_second sparsity selectivity coverage")
def map_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = encoding.map_measures(_rates(spark, sf_dir))
    return d.withColumns({c: F.col(c) * 1e6 for c in ("mean_rate", "peak_rate", "information_per_second")})


@named(f"SELECT unit, {correlation_sql('rate', 'around')} AS coherence FROM rates JOIN (SELECT unit, src AS bin_id, avg(rate) AS around FROM edges JOIN rates ON dst = bin_id GROUP BY ALL) USING (unit, bin_id) WHERE rate IS NOT NULL AND around IS NOT NULL GROUP BY unit", "coherence")
def coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.coherence(_rates(spark, sf_dir), grid(spark, sf_dir).edges)


@named("SELECT unit, avg(CASE WHEN bin_id < 30 THEN rate END) / avg(CASE WHEN bin_id >= 30 THEN rate END) AS ratio FROM rates GROUP BY unit", "ratio")
def in_out_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.in_out_ratio(_rates(spark, sf_dir), F.col("bin_id") < 30)


@named("SELECT unit, sum(x * rate) / sum(rate) AS x, sum(y * rate) / sum(rate) AS y FROM rates JOIN bins USING (bin_id) WHERE rate IS NOT NULL GROUP BY unit", "x y")
def rate_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.centroid(_rates(spark, sf_dir), grid(spark, sf_dir).bins)


@named("SELECT unit, arg_max(bin_id, (rate, -bin_id)) AS bin_id, max(rate) * 1e6 AS rate_e6 FROM rates WHERE rate IS NOT NULL GROUP BY unit", "rate_e6")
def peak_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.peak_bins(_rates(spark, sf_dir)).select("unit", "bin_id", (F.col("rate") * 1e6).alias("rate_e6"))


@named(f"""SELECT unit, r.bin_id, CASE WHEN r.seconds > 0 THEN wn / ws END * 1e6 AS rate_e6 FROM rates r JOIN (
  SELECT unit, src AS bin_id, sum(w * n) AS wn, sum(w * seconds) AS ws FROM ({KERNEL}) JOIN rates ON dst = bin_id GROUP BY ALL) USING (unit, bin_id)""", "rate_e6")
def rate_map_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import fields

    kernel = fields.gaussian_kernel(grid(spark, sf_dir).bins, 20.0)
    return encoding.smoothed_rate_map(_rates(spark, sf_dir), kernel).select("unit", "bin_id", (F.col("rate") * 1e6).alias("rate_e6"))


@named(f"SELECT unit, {correlation_sql('ra', 'rb')} AS r FROM (SELECT a.unit, a.rate AS ra, coalesce(b.rate, NULL) AS rb FROM rates a JOIN (SELECT unit, rate, bin_id + 1 AS bin_id FROM rates) b USING (unit, bin_id)) WHERE ra IS NOT NULL AND rb IS NOT NULL GROUP BY unit", "r")
def map_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each map against itself moved by one bin."""
    r = _rates(spark, sf_dir)
    return encoding.stability(r, r.withColumn("bin_id", F.col("bin_id") + 1))


INSIDE = "SELECT unit, bin_id, rate FROM (SELECT *, max(rate) OVER (PARTITION BY unit) AS peak FROM rates WHERE rate IS NOT NULL) WHERE peak > 0 AND rate >= {share} * peak"
#: Place fields as reachable bins: (unit, field, bin_id, rate).
FIELDS = """WITH RECURSIVE inside AS ({inside}), reach(unit, bin_id, other) AS (SELECT unit, bin_id, bin_id FROM inside UNION
  SELECT r.unit, r.bin_id, e.dst FROM reach r JOIN edges e ON e.src = r.other JOIN inside i ON i.unit = r.unit AND i.bin_id = e.dst)
  SELECT unit, min(other) AS field, bin_id, any_value(rate) AS rate FROM reach JOIN inside USING (unit, bin_id) GROUP BY unit, bin_id"""


def fields_sql(share: float) -> str:
    return FIELDS.replace("{inside}", INSIDE.replace("{share}", str(share)))


@named(f"SELECT unit, field, bin_id, rate * 1e6 AS rate_e6 FROM ({fields_sql(0.5)})", "rate_e6")
def place_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoding.place_fields(_rates(spark, sf_dir), grid(spark, sf_dir).edges, 0.5)
    return found.select("unit", "field", "bin_id", (F.col("rate") * 1e6).alias("rate_e6"))


HEADED = "SELECT *, atan2(next_y - y, next_x - x) AS h FROM path WHERE dt IS NOT NULL"
SECTOR = "(floor(fmod(fmod(h, 2 * 3.141592653589793) + 2 * 3.141592653589793, 2 * 3.141592653589793) / (2 * 3.141592653589793 / 12))::BIGINT % 12)"
TUNING = f"""SELECT u.unit, k.range AS bin, coalesce(c.n, 0) AS n, coalesce(o.seconds, 0.0) AS seconds, CASE WHEN o.seconds > 0 THEN coalesce(c.n, 0) / o.seconds END AS rate
  FROM (SELECT DISTINCT unit FROM spikes) u CROSS JOIN range(0, 12) k
  LEFT JOIN (SELECT unit, {SECTOR} AS bin, count(*) AS n FROM spikes s ASOF JOIN (SELECT session, t, dt, CASE WHEN dt IS NOT NULL THEN atan2(next_y - y, next_x - x) END AS h FROM path) p ON s.session = p.session AND s.t >= p.t WHERE p.dt IS NOT NULL GROUP BY ALL) c ON c.unit = u.unit AND c.bin = k.range
  LEFT JOIN (SELECT {SECTOR} AS bin, sum(dt) AS seconds FROM ({HEADED}) GROUP BY ALL) o ON o.bin = k.range"""


def _tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    headings = trajectory.steps(path(spark, sf_dir), SPAN).select("session", "idx", "t", "heading")
    return encoding.directional_tuning(spikes(spark, sf_dir), headings, 12, SPAN)


@named(f"SELECT unit, bin, n, seconds, rate * 1e6 AS rate_e6 FROM ({TUNING})", "seconds rate_e6")
def directional_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tuning(spark, sf_dir).select("unit", "bin", "n", "seconds", (F.col("rate") * 1e6).alias("rate_e6"))


@named(f"""SELECT unit, atan2(sum(rate * sin(c)), sum(rate * cos(c))) AS preferred, sqrt(pow(sum(rate * sin(c)), 2) + pow(sum(rate * cos(c)), 2)) / sum(rate) AS length
  FROM (SELECT *, (bin + 0.5) * (2 * 3.141592653589793::DOUBLE / 12) AS c FROM ({TUNING})) GROUP BY unit""", "preferred length")
def direction_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.direction_measures(_tuning(spark, sf_dir), 12)


@named("""SELECT floor(r / 20.0)::BIGINT AS i_distance, floor((b + 3.141592653589793) / (2 * 3.141592653589793 / 8))::BIGINT % 8 AS i_angle, sum(dt) AS seconds FROM (
  SELECT dt, CASE WHEN r1 <= r2 THEN r1 ELSE r2 END AS r, CASE WHEN r1 <= r2 THEN b1 ELSE b2 END AS b FROM (
    SELECT dt, sqrt((40 - x) * (40 - x) + (50 - y) * (50 - y)) AS r1, sqrt((120 - x) * (120 - x) + (50 - y) * (50 - y)) AS r2,
           atan2(cos(h) * (50 - y) - sin(h) * (40 - x), cos(h) * (40 - x) + sin(h) * (50 - y)) AS b1, atan2(cos(h) * (50 - y) - sin(h) * (120 - x), cos(h) * (120 - x) + sin(h) * (50 - y)) AS b2
    FROM (SELECT *, atan2(next_y - y, next_x - x) AS h FROM stepped WHERE dt IS NOT NULL))) WHERE r < 100 GROUP BY ALL""", "seconds")
def egocentric_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.egocentric_occupancy(samples(spark, sf_dir), [(40.0, 50.0), (120.0, 50.0)], 100.0, 5, 8, SPAN)


# Decoding

DT = 21_600.0


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = samples(spark, sf_dir).select(F.pmod("session", F.lit(8)).alias("unit"), "t")
    return events.spike_counts(units, DT, START, STOP)


def _unit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.grid import bin_at

    g, s = grid(spark, sf_dir), samples(spark, sf_dir)
    counts = bin_at(s, g).groupBy(F.pmod("session", F.lit(8)).alias("unit"), "bin_id").agg(F.count("*").alias("n"))
    occupied = trajectory.occupancy(s, g, MAX_GAP, span=SPAN).select("bin_id", "seconds")
    units = s.select(F.pmod("session", F.lit(8)).alias("unit")).distinct()
    d = occupied.crossJoin(F.broadcast(units)).join(counts, ["unit", "bin_id"], "left")
    return d.select("unit", "bin_id", F.when(F.col("seconds") > 0, F.coalesce("n", F.lit(0)) / F.col("seconds") * 20.0).alias("rate"))


def _post(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.posterior(decoding.log_likelihood(_counts(spark, sf_dir), _unit_rates(spark, sf_dir), DT))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.binning import closed_bin_index
    from ..operators.grid import bin_at

    s = bin_at(samples(spark, sf_dir), grid(spark, sf_dir)).where("bin_id >= 0")
    return s.groupBy(closed_bin_index(F.col("t"), START, DT, 120).alias("t_idx")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.min("bin_id").alias("bin_id"))


@named("SELECT t_idx, unit, n FROM unit_counts")
def spike_counts_time_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


@named("SELECT t_idx, bin_id, ll FROM ll", "ll")
def log_poisson_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.log_likelihood(_counts(spark, sf_dir), _unit_rates(spark, sf_dir), DT)


@named("SELECT * FROM post", "p")
def posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _post(spark, sf_dir)


@named("""SELECT t_idx, bin_id, e / sum(e) OVER (PARTITION BY t_idx) AS p FROM (
  SELECT t_idx, bin_id, exp(l - max(l) OVER (PARTITION BY t_idx)) AS e FROM (
    SELECT ll.t_idx, ll.bin_id, ll.ll + ln(greatest(q.seconds / (SELECT sum(seconds) FROM occupied), 1e-10)) AS l FROM ll JOIN occupied q USING (bin_id)))""", "p")
def posterior_with_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = trajectory.occupancy(samples(spark, sf_dir), grid(spark, sf_dir), MAX_GAP, span=SPAN).select("bin_id", F.col("seconds").alias("p"))
    return decoding.posterior(decoding.log_likelihood(_counts(spark, sf_dir), _unit_rates(spark, sf_dir), DT), prior)


ESTIMATES = """SELECT t_idx, m.map_bin, b.x AS map_x, b.y AS map_y, mean_x, mean_y, entropy, peak FROM best m JOIN bins b ON b.bin_id = map_bin
  JOIN (SELECT t_idx, sum(p * x) AS mean_x, sum(p * y) AS mean_y, -sum(CASE WHEN p > 0 THEN p * log2(p) END) AS entropy, max(p) AS peak FROM post JOIN bins USING (bin_id) GROUP BY t_idx) USING (t_idx)"""
ESTIMATED = "map_x map_y mean_x mean_y entropy peak"


@named(ESTIMATES, ESTIMATED)
def decoded_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.estimates(_post(spark, sf_dir), grid(spark, sf_dir).bins)


@named(ESTIMATES, ESTIMATED)
def decode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``decoded_estimates`` gives, from tiles of bins, without a posterior table."""
    return tiles.decode_summary(_counts(spark, sf_dir), _unit_rates(spark, sf_dir), grid(spark, sf_dir).bins, DT)


@named("""SELECT t_idx, count(*) AS n FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY t_idx ORDER BY p DESC, bin_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM post) WHERE b < 0.9 GROUP BY t_idx""")
def credible_region_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.credible_region(_post(spark, sf_dir), 0.9).groupBy("t_idx").agg(F.count("*").alias("n"))


@named("SELECT t_idx, sqrt((b.x - t.x) * (b.x - t.x) + (b.y - t.y) * (b.y - t.y)) AS error FROM best JOIN bins b ON b.bin_id = map_bin JOIN truth t USING (t_idx)", "error")
def decoding_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.error(decoding.estimates(_post(spark, sf_dir), grid(spark, sf_dir).bins), _truth(spark, sf_dir))


@named("SELECT bin_id AS actual, map_bin AS decoded, count(*) AS n FROM best JOIN truth USING (t_idx) GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.confusion(decoding.estimates(_post(spark, sf_dir), grid(spark, sf_dir).bins), _truth(spark, sf_dir))


@named("SELECT t.bin_id AS actual, p.bin_id, sum(p) AS p FROM post p JOIN truth t USING (t_idx) GROUP BY ALL", "p")
def expected_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.expected_confusion(_post(spark, sf_dir), _truth(spark, sf_dir))


@named("""SELECT cov / vt AS slope, (s - cov / vt * t) / w AS intercept, cov * cov / (vt * vs) AS r2 FROM (
  SELECT *, ts - t * s / w AS cov, tt - t * t / w AS vt, ss - s * s / w AS vs FROM (
    SELECT sum(p) AS w, sum(p * t) AS t, sum(p * s) AS s, sum(p * t * t) AS tt, sum(p * t * s) AS ts, sum(p * s * s) AS ss FROM (SELECT p, t_idx * 0.25::DOUBLE AS t, x AS s FROM post JOIN bins USING (bin_id))))""", "slope intercept r2")
def trajectory_line_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    position = grid(spark, sf_dir).bins.select("bin_id", F.col("x").alias("s"))
    return decoding.linear_fit(_post(spark, sf_dir), position, 0.25)


CORRELATED = "SELECT a.unit AS unit_a, b.unit AS unit_b, coalesce(corr(a.n, b.n), 0.0) AS r FROM unit_counts a JOIN unit_counts b ON a.t_idx = b.t_idx AND a.unit < b.unit GROUP BY ALL"


@named(CORRELATED, "r")
def pairwise_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.pairwise_correlations(_counts(spark, sf_dir))


@named(f"""SELECT pow((tm - tc * mc) / sqrt((1 - tc * tc) * (1 - mc * mc)), 2) AS ev, pow((tc - tm * mc) / sqrt((1 - tm * tm) * (1 - mc * mc)), 2) AS rev FROM (
  SELECT corr(t.r, m.r) AS tm, corr(t.r, c.r) AS tc, corr(m.r, c.r) AS mc FROM ({CORRELATED.replace("a.unit < b.unit", "a.unit < b.unit AND a.t_idx < 40")}) t
  JOIN ({CORRELATED.replace("a.unit < b.unit", "a.unit < b.unit AND a.t_idx >= 40 AND a.t_idx < 80")}) m USING (unit_a, unit_b)
  JOIN ({CORRELATED.replace("a.unit < b.unit", "a.unit < b.unit AND a.t_idx >= 80")}) c USING (unit_a, unit_b))""", "ev rev")
def explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counts(spark, sf_dir)
    of = lambda a, b: decoding.pairwise_correlations(c.where((F.col("t_idx") >= a) & (F.col("t_idx") < b)))
    return decoding.explained_variance(of(0, 40), of(40, 80), of(80, 120))


# Circular statistics: the hour of the day as an angle

ANGLE = f"2 * {math.pi} * (t / 86400.0 - floor(t / 86400.0))"


def _angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("t") / DAY
    return samples(spark, sf_dir).withColumn("a", 2 * math.pi * (day - F.floor(day)))


@named(f"""SELECT event_type, n, mean, length, 1 - length AS variance, n * length * length AS z, least(1.0, greatest(0.0, exp(-n * length * length))) AS p FROM (
  SELECT event_type, count(*) AS n, atan2(sum(sin(a)), sum(cos(a))) AS mean, sqrt(pow(sum(sin(a)), 2) + pow(sum(cos(a)), 2)) / count(*) AS length FROM (SELECT *, {ANGLE} AS a FROM samples) GROUP BY event_type)""", "mean length variance z p")
def circular_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circular.summary(_angles(spark, sf_dir), F.col("a"), ["event_type"])


@named(f"""SELECT event_type, n, r, exp(-n * r * r / 2) AS p FROM (SELECT event_type, n, sqrt(least(1.0, greatest(0.0, (rc * rc + rs * rs - 2 * rc * rs * cs) / (1 - cs * cs)))) AS r FROM (
  SELECT event_type, count(*) AS n, corr(x, cos(a)) AS rc, corr(x, sin(a)) AS rs, corr(sin(a), cos(a)) AS cs FROM (SELECT *, {ANGLE} AS a FROM samples) GROUP BY event_type))""", "r p")
def circular_linear_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circular.linear_correlation(_angles(spark, sf_dir), F.col("a"), F.col("x"), ["event_type"])


@named(f"""SELECT event_type, count(*) AS n, sum(sin(a - ma) * sin(b - mb)) / sqrt(sum(pow(sin(a - ma), 2)) * sum(pow(sin(b - mb), 2))) AS r FROM (
  SELECT *, atan2(sum(sin(a)) OVER w, sum(cos(a)) OVER w) AS ma, atan2(sum(sin(b)) OVER w, sum(cos(b)) OVER w) AS mb FROM (SELECT *, {ANGLE} AS a, 2 * {math.pi} * y / 100.0 AS b FROM samples) WINDOW w AS (PARTITION BY event_type)) GROUP BY event_type""", "r")
def circular_circular_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circular.circular_correlation(_angles(spark, sf_dir), F.col("a"), 2 * math.pi * F.col("y") / 100.0, ["event_type"]).drop("p")


@named(f"""SELECT event_type, sqrt(bs * bs + bc * bc) AS amplitude, atan2(bs, bc) AS phase FROM (SELECT event_type, (sy * cc - cy * sc) / (ss * cc - sc * sc) AS bs, (cy * ss - sy * sc) / (ss * cc - sc * sc) AS bc FROM (
  SELECT event_type, var_pop(sin(a)) AS ss, var_pop(cos(a)) AS cc, covar_pop(sin(a), cos(a)) AS sc, covar_pop(sin(a), x) AS sy, covar_pop(cos(a), x) AS cy FROM (SELECT *, {ANGLE} AS a FROM samples) GROUP BY event_type))""", "amplitude phase")
def circular_basis_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circular.basis_fit(_angles(spark, sf_dir), F.col("a"), F.col("x"), ["event_type"])


# Behaviour


@named("SELECT session, avg(cos(atan2(next_y - y, next_x - x) - atan2(50.0 - y, 100.0 - x))) AS bias FROM stepped WHERE dt IS NOT NULL GROUP BY session", "bias")
def goal_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.goal_bias(samples(spark, sf_dir), (100.0, 50.0), 0.0, SPAN)


@named("SELECT session, idx, (d - lag(d) OVER w) / nullif(t - lag(t) OVER w, 0) * 1000 AS rate FROM (SELECT *, sqrt((100 - x) * (100 - x) + (50 - y) * (50 - y)) AS d FROM samples) WINDOW w AS (PARTITION BY session ORDER BY t, idx)", "rate")
def approach_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.approach_rate(samples(spark, sf_dir), (100.0, 50.0), SPAN).select("session", "idx", (F.col("rate") * 1000).alias("rate"))


@named("""SELECT session, traveled, straight, straight / traveled AS efficiency, duration FROM (SELECT session, sum(length) AS traveled, max(t) - min(t) AS duration,
  sqrt(pow(arg_max(x, (t, idx)) - arg_min(x, (t, idx)), 2) + pow(arg_max(y, (t, idx)) - arg_min(y, (t, idx)), 2)) AS straight FROM stepped GROUP BY session)""", "traveled straight efficiency duration")
def path_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.path_efficiency(samples(spark, sf_dir), SPAN)


@named("SELECT session, idx, CASE WHEN dt > 0 AND length / dt >= 0.001 THEN least(floor((h + CASE WHEN h < 0 THEN 2 * 3.141592653589793 ELSE 0 END) / (2 * 3.141592653589793 / 8))::BIGINT, 7) ELSE -1 END AS label FROM (SELECT *, atan2(next_y - y, next_x - x) AS h FROM stepped) WHERE dt IS NOT NULL")
def heading_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.heading_labels(samples(spark, sf_dir), 8, 0.001, SPAN).select("session", "idx", "label")


ENTRIES = f"SELECT session, idx, t FROM (SELECT *, lag(inside) OVER (PARTITION BY session ORDER BY t, idx) AS before FROM (SELECT *, {IN_BOX} AS inside FROM samples)) WHERE inside AND NOT before"


@named(f"SELECT s.session, s.idx FROM samples s JOIN (SELECT session, min(t) AS entry_t FROM ({ENTRIES}) GROUP BY session) e USING (session) WHERE s.t >= entry_t - 172800.0 AND s.t < entry_t")
def decision_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.decision_window(samples(spark, sf_dir), regions.contains(F.col("x"), F.col("y"), BOX), MAX_GAP, SPAN).select("session", "idx")


@named(f"SELECT session, t AS start_t, n AS stop_t FROM (SELECT session, t, lead(t) OVER (PARTITION BY session ORDER BY t, idx) AS n FROM ({ENTRIES})) WHERE n IS NOT NULL", "start_t stop_t")
def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.laps(samples(spark, sf_dir), regions.contains(F.col("x"), F.col("y"), BOX), SPAN)


SWEEPS = """SELECT session AS trial, sum(abs(fmod(fmod(h - ph + 3.141592653589793, 2 * 3.141592653589793) + 2 * 3.141592653589793, 2 * 3.141592653589793) - 3.141592653589793)) AS sweep FROM (
  SELECT session, h, lag(h) OVER (PARTITION BY session ORDER BY t, idx) AS ph FROM (SELECT *, atan2(next_y - y, next_x - x) AS h FROM stepped WHERE dt IS NOT NULL)) GROUP BY session"""


@named(f"""SELECT *, 0.5 * z_sweep + 0.5 * z_slow AS index, 0.5 * z_sweep + 0.5 * z_slow > 0.5 AS deliberate FROM (
  SELECT trial, sweep, speed, (sweep - avg(sweep) OVER ()) / stddev_pop(sweep) OVER () AS z_sweep, (1 / speed - avg(1 / speed) OVER ()) / stddev_pop(1 / speed) OVER () AS z_slow
  FROM ({SWEEPS}) JOIN (SELECT session AS trial, avg(length) AS speed FROM stepped WHERE dt IS NOT NULL GROUP BY session) USING (trial))""", "sweep speed z_sweep z_slow index")
def deliberation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = trajectory.steps(samples(spark, sf_dir), SPAN).where("dt is not null")
    sweeps = behavior.head_sweep(d.select("session", "idx", "t", "heading"), span=SPAN)
    speed = d.groupBy("session").agg(F.avg("length").alias("speed"))
    return behavior.deliberation(sweeps.join(speed, "session").withColumnRenamed("session", "trial"))


@named("""SELECT session, (t + lt) / 2 AS t, l AS from_label, label AS to_label FROM (SELECT session, t, label, lag(label) OVER w AS l, lag(t) OVER w AS lt FROM (
  SELECT *, CASE WHEN x < 30 THEN 0 WHEN x > 60 THEN 1 END AS label FROM samples) WINDOW w AS (PARTITION BY session ORDER BY t, idx)) WHERE label IS NOT NULL AND l IS NOT NULL AND label <> l""", "t")
def decision_boundary_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.boundary_crossings(samples(spark, sf_dir), F.when(F.col("x") < 30, 0).when(F.col("x") > 60, 1), SPAN)


@named("SELECT bin_id, CASE WHEN d0 <= d1 THEN 0 ELSE 1 END AS goal, abs(d1 - d0) AS margin FROM (SELECT bin_id, sqrt((30 - x) * (30 - x) + (40 - y) * (40 - y)) AS d0, sqrt((150 - x) * (150 - x) + (60 - y) * (60 - y)) AS d1 FROM bins)", "margin")
def nearest_goal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.nearest_goal(grid(spark, sf_dir).bins, [(30.0, 40.0), (150.0, 60.0)])


@named(f"""SELECT session, t AS start_t, CASE WHEN coalesce(stop_t <= t + 259200.0, false) THEN stop_t ELSE t + 259200.0 END AS stop_t, coalesce(stop_t <= t + 259200.0, false) AS success FROM (
  SELECT s.session, s.t, (SELECT min(e.t) FROM (SELECT session, t FROM (SELECT *, lag(inside) OVER (PARTITION BY session ORDER BY t, idx) AS before FROM (SELECT *, x > 60 AS inside FROM samples)) WHERE inside AND NOT before) e WHERE e.session = s.session AND e.t >= s.t) AS stop_t
  FROM (SELECT session, t FROM (SELECT *, lag(inside) OVER (PARTITION BY session ORDER BY t, idx) AS before FROM (SELECT *, x < 30 AS inside FROM samples)) WHERE before AND NOT inside) s)""", "start_t stop_t")
def runs_between_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.runs_between(samples(spark, sf_dir), F.col("x") < 30, F.col("x") > 60, 3 * DAY, SPAN)


@named("""SELECT session, segment, moving, min(t) AS start_t, max(t) AS stop_t, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN lag_moving IS NULL OR lag_moving <> moving THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY t, idx ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM (
    SELECT *, lag(moving) OVER (PARTITION BY session ORDER BY t, idx) AS lag_moving FROM (
      SELECT session, idx, t, coalesce(last_value(told IGNORE NULLS) OVER (PARTITION BY session ORDER BY t, idx ROWS UNBOUNDED PRECEDING), 0) AS moving FROM (
        SELECT *, CASE WHEN speed >= 0.002 THEN 1 WHEN speed < 0.0005 THEN 0 END AS told FROM (SELECT *, CASE WHEN dt > 0 THEN length / dt ELSE 0.0 END AS speed FROM stepped WHERE dt IS NOT NULL))))) GROUP BY ALL""", "start_t stop_t")
def speed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.slow_fast_segments(samples(spark, sf_dir), 0.0005, 0.002, SPAN)


@named("""WITH r AS (SELECT session, idx, t, CASE WHEN x < 20 THEN 'start' WHEN y < 30 THEN 'left' WHEN y > 70 THEN 'right' ELSE '' END AS region FROM samples),
  v AS (SELECT * FROM (SELECT *, lag(region) OVER (PARTITION BY session ORDER BY t, idx) AS before FROM r) WHERE before IS NULL OR before <> region), x AS (SELECT session, t AS b FROM v WHERE before = 'start'),
  f AS (SELECT session, b, (SELECT min(t) FROM v WHERE v.session = x.session AND region = 'start' AND t > b) AS s, (SELECT min(t) FROM v WHERE v.session = x.session AND region IN ('left', 'right') AND t >= b) AS e,
    (SELECT arg_min(region, t) FROM v WHERE v.session = x.session AND region IN ('left', 'right') AND t >= b) AS er, (SELECT min(t) FROM v WHERE v.session = x.session AND t > b + 432000.0) AS l FROM x),
  o AS (SELECT session, b AS start_t, CASE WHEN e - b <= 432000.0 AND (s IS NULL OR e < s) THEN e WHEN s - b <= 432000.0 THEN s WHEN l IS NOT NULL THEN b + 432000.0 END AS stop_t,
    CASE WHEN e - b <= 432000.0 AND (s IS NULL OR e < s) THEN er WHEN s - b <= 432000.0 THEN 'aborted' WHEN l IS NOT NULL THEN 'timeout' END AS outcome FROM f)
  SELECT session, row_number() OVER (PARTITION BY session ORDER BY start_t) - 1 AS trial, start_t, stop_t, outcome FROM o WHERE stop_t IS NOT NULL""", "start_t stop_t")
def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.trials(samples(spark, sf_dir), F.col("x") < 20, {"left": F.col("y") < 30, "right": F.col("y") > 70}, 0.0, 5 * DAY, SPAN)


@named("""SELECT count_if(a AND b) / count(*) AS jaccard FROM (SELECT bool_or(session % 2 = 0) AS a, bool_or(session % 2 = 1) AS b FROM placed WHERE bin_id >= 0 GROUP BY bin_id)""", "jaccard")
def trajectory_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.grid import bin_at

    d = bin_at(samples(spark, sf_dir), grid(spark, sf_dir)).where("bin_id >= 0")
    return behavior.trajectory_overlap(d.where("session % 2 = 0"), d.where("session % 2 = 1"))


@named("SELECT (count_if(x >= 80) + 1) / (count(*) + 1) AS p, (80 - avg(x)) / stddev_pop(x) AS z, count(*) AS n FROM samples", "p z")
def shuffle_p_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.p_value(samples(spark, sf_dir).select(F.col("x").alias("score")), 80.0)


@named()
def shuffled_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of x and y within event types, and of 20 shuffles of y."""
    s = samples(spark, sf_dir).select("event_type", "idx", "x", "y")
    d = stats.permuted(s, "y", ["event_type"], "idx", 20, span=65_536)
    return d.groupBy("shuffle", "event_type").agg(correlation(F.col("x"), F.col("y")).alias("r"))


@named("SELECT unit, t_idx, avg(n) OVER (PARTITION BY unit ORDER BY t_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS rate FROM unit_counts", "rate")
def moving_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.moving_rate(_counts(spark, sf_dir), 3).select("unit", "t_idx", "rate")
