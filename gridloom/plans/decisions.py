"""Queries on decisions, verdicts, links as a linear operator, and a decoder's fit and score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import behavior, decisions, decoding, encoding, navigation, nearest, place_fields, tiles, trajectory
from ..operators import grid as grids
from ..operators import layouts
from .activity import DT, SWEEPS, _counts, _rates, _truth, _unit_rates
from .catalog import MAX_GAP, SPAN, START, grid, named, samples
from .navigation import WINDOW_STEPS, _windows
from .tracks import TRACK_BINS, _PLACED, derived_track

_WAY = "d{k}(bin_id, distance, k) AS (SELECT bin_id, 0.0::DOUBLE, 0 FROM ({start}) UNION ALL SELECT e.dst, min(d.distance + e.distance), any_value(d.k) + 1 FROM d{k} d JOIN edges e ON e.src = d.bin_id WHERE d.k < 40 GROUP BY e.dst)"
GOALS = {"a": "SELECT min(bin_id) AS bin_id FROM bins", "b": "SELECT max(bin_id) AS bin_id FROM bins"}
MARGINS = f"""WITH RECURSIVE {_WAY.format(k="a", start=GOALS["a"])}, {_WAY.format(k="b", start=GOALS["b"])}, pa AS (SELECT bin_id, min(distance) AS a FROM da GROUP BY bin_id), pb AS (SELECT bin_id, min(distance) AS b FROM db GROUP BY bin_id)
  SELECT bin_id, CASE WHEN b IS NULL OR round(a, 9) <= round(b, 9) THEN 'a' ELSE 'b' END AS goal, least(a, b) AS nearest, abs(a - b) AS margin FROM pa FULL JOIN pb USING (bin_id)"""


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    ends = g.bins.agg(F.min("bin_id").alias("a"), F.max("bin_id").alias("b"))
    return decisions.goal_distances(g.edges, {k: ends.select(F.col(k).alias("bin_id")) for k in "ab"})


@named(MARGINS, "nearest margin")
def goal_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bin's nearer corner of the arena, by the links, and by how much."""
    return _distances(spark, sf_dir)


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = grids.bin_at(samples(spark, sf_dir), grid(spark, sf_dir)).where("bin_id >= 0")
    return decisions.boundary_distances(s.select("session", "idx", "t", "x", "y", "bin_id"), _distances(spark, sf_dir))


@named(f"SELECT idx, goal, margin FROM placed JOIN ({MARGINS}) USING (bin_id)", "margin")
def boundary_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every event is from the boundary between two goals."""
    return _near(spark, sf_dir).select("idx", "goal", "margin")


@named(f"""WITH m AS MATERIALIZED ({MARGINS}), s AS (SELECT session, t, idx, goal, margin FROM placed JOIN m USING (bin_id)), c AS (SELECT session, count_if(goal <> before) AS n FROM (SELECT session, goal, lag(goal) OVER (PARTITION BY session ORDER BY t, idx) AS before FROM s) GROUP BY session),
  p AS (SELECT session, coalesce(avg(v), 0.0) AS mean_speed, 1 - coalesce(sqrt(pow(sum(sin(h)), 2) + pow(sum(cos(h)), 2)) / count(h), 0.0) AS variance FROM (SELECT session, CASE WHEN dt > 0 THEN len / dt WHEN dt = 0 THEN 0.0 END AS v, h FROM ({WINDOW_STEPS})) GROUP BY session)
  SELECT session, variance, mean_speed * 1e6 AS mean_e6, variance > 0.5 AND mean_speed < 0.001 AS suggests_deliberation, coalesce(n, 0) AS n_crossings, mean_margin FROM (SELECT session, avg(margin) AS mean_margin FROM s GROUP BY session) LEFT JOIN c USING (session) LEFT JOIN p USING (session)""", "variance mean_e6 mean_margin")
def decision_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session before its decision, and on either side of the boundary between goals."""
    near = _near(spark, sf_dir)
    crossings = behavior.boundary_crossings(near, F.col("goal"), SPAN)
    d = decisions.decision_analysis(navigation.pre_decision(_windows(spark, sf_dir), 0.0, SPAN), near, crossings, 0.5, 0.001)
    return d.select("session", "variance", (F.col("mean_speed") * 1e6).alias("mean_e6"), "suggests_deliberation", "n_crossings", "mean_margin")


@named("""SELECT session, efficiency, bias, coalesce(efficiency > 0.1, false) AS is_efficient, coalesce(bias > 0.3, false) AS is_goal_directed FROM (SELECT session,
    sqrt(pow(arg_max(x, (t, idx)) - arg_min(x, (t, idx)), 2) + pow(arg_max(y, (t, idx)) - arg_min(y, (t, idx)), 2)) / sum(length) AS efficiency, avg(CASE WHEN dt IS NOT NULL THEN cos(atan2(next_y - y, next_x - x) - atan2(50.0 - y, 100.0 - x)) END) AS bias FROM stepped GROUP BY session)""", "efficiency bias")
def path_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return decisions.path_verdicts(behavior.path_efficiency(s, SPAN), behavior.goal_bias(s, (100.0, 50.0), 0.0, SPAN), 0.1, 0.3)


@named(f"""WITH d AS (SELECT trial, sweep, 0.5 * (sweep - avg(sweep) OVER ()) / stddev_pop(sweep) OVER () + 0.5 * (1 / speed - avg(1 / speed) OVER ()) / stddev_pop(1 / speed) OVER () > 0.5 AS deliberate
    FROM ({SWEEPS}) JOIN (SELECT session AS trial, avg(length) AS speed FROM stepped WHERE dt IS NOT NULL GROUP BY session) USING (trial))
  SELECT count(*) AS n, count_if(deliberate) AS n_deliberate, avg(sweep) AS mean_sweep, stddev_pop(sweep) AS std_sweep, avg(deliberate::INT) AS share FROM d""", "mean_sweep std_sweep share")
def deliberation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = trajectory.steps(samples(spark, sf_dir), SPAN).where("dt is not null")
    sweeps = behavior.head_sweep(d.select("session", "idx", "t", "heading"), span=SPAN)
    trials = behavior.deliberation(sweeps.join(d.groupBy("session").agg(F.avg("length").alias("speed")), "session").withColumnRenamed("session", "trial"))
    return decisions.deliberation_summary(trials)


@named(f"""WITH p AS ({_PLACED}), q AS (SELECT idx, arg_min(before + u * length, (sqrt(pow(x0 + u * (x1 - x0) - x, 2) + pow(y0 + u * (y1 - y0) - y, 2)), segment)) AS position FROM p GROUP BY idx), tb AS ({TRACK_BINS})
  SELECT idx, max(bin_id) AS bin_id FROM q JOIN tb ON q.position >= tb.position - length / 2 - 1e-9 AND q.position <= tb.position + length / 2 + 1e-9 GROUP BY idx""")
def linear_bin_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The track bin that holds every event's nearest place on a track."""
    track = derived_track(spark, sf_dir)
    along = layouts.to_linear(samples(spark, sf_dir).select("idx", "x", "y"), track).select("idx", "position")
    return decisions.linear_bin_at(along, grids.track_bins(track, 5.0), 5.0).select("idx", "bin_id")


_LINKS = "SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge_id, src, dst, distance, b.x - a.x AS dx, b.y - a.y AS dy, atan2(b.y - a.y, b.x - a.x) AS angle, 1 / distance AS weight FROM edges JOIN bins a ON a.bin_id = src JOIN bins b ON b.bin_id = dst WHERE src < dst"


@named(_LINKS, "distance dx dy angle weight")
def edge_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return decisions.edge_attributes(g.bins, g.edges)


@named(f"SELECT src AS bin_id, edge_id, -sqrt(distance) AS v FROM ({_LINKS}) UNION ALL SELECT dst, edge_id, sqrt(distance) FROM ({_LINKS})", "v")
def differential_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return decisions.differential_operator(g.bins, g.edges)


@named("SELECT unit, greatest(0.0, sum(CASE WHEN rate > 0 THEN p * rate * log2(rate / mean) END)) * 1e6 AS bits_e6 FROM shares GROUP BY unit", "bits_e6")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the place tells of a unit's firing, in bits a second."""
    return encoding.mutual_information(_rates(spark, sf_dir)).select("unit", (F.col("bits") * 1e6).alias("bits_e6"))


HALF = START + 60 * DT
#: A decoder's fit on the first half of the recording: seconds and events of each unit in each bin.
FITTED = f"""SELECT u.unit, o.bin_id, greatest(CASE WHEN o.seconds > 0 THEN coalesce(c.n, 0) / o.seconds * 20.0 ELSE 0 END, 1e-10) AS rate FROM (SELECT b.bin_id, coalesce(sum(v.dt), 0.0) AS seconds FROM bins b LEFT JOIN (SELECT bin_id, dt FROM (
      SELECT session, t, idx, bin_id, lead(t) OVER (PARTITION BY session ORDER BY t, idx) - t AS dt FROM placed WHERE t < {HALF}) WHERE dt IS NOT NULL AND bin_id >= 0 AND dt <= 172800.0) v USING (bin_id) GROUP BY b.bin_id) o
    CROSS JOIN (SELECT DISTINCT session % 8 AS unit FROM samples) u LEFT JOIN (SELECT session % 8 AS unit, bin_id, count(*) AS n FROM placed WHERE t < {HALF} GROUP BY ALL) c ON c.unit = u.unit AND c.bin_id = o.bin_id"""


@named(f"""WITH f AS ({FITTED}), l AS (SELECT c.t_idx, r.bin_id, sum(c.n * ln(r.rate * 21600.0)) - sum(r.rate * 21600.0) AS ll FROM (SELECT * FROM unit_counts WHERE t_idx >= 60) c JOIN f r USING (unit) GROUP BY ALL),
  m AS (SELECT t_idx, min(bin_id) AS map_bin FROM (SELECT *, max(ll) OVER (PARTITION BY t_idx) AS top FROM l) WHERE ll >= top - 1e-9 GROUP BY t_idx)
  SELECT median(error) AS score, count(*) AS n, 0 AS n_undecoded FROM (SELECT sqrt((b.x - t.x) * (b.x - t.x) + (b.y - t.y) * (b.y - t.y)) AS error FROM m JOIN bins b ON b.bin_id = map_bin JOIN truth t USING (t_idx))""", "score")
def decoder_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decoder fitted on the first half of the recording and scored on the second."""
    g, s = grid(spark, sf_dir), samples(spark, sf_dir)
    early = s.where(F.col("t") < HALF)
    counts = grids.bin_at(early, g).groupBy(F.pmod("session", F.lit(8)).alias("unit"), "bin_id").agg(F.count("*").alias("n"))
    occupied = trajectory.occupancy(early, g, MAX_GAP, span=SPAN).select("bin_id", "seconds")
    units = s.select(F.pmod("session", F.lit(8)).alias("unit")).distinct()
    frame = occupied.crossJoin(units).join(counts, ["unit", "bin_id"], "left")
    rates = frame.select("unit", "bin_id", F.when(F.col("seconds") > 0, F.coalesce("n", F.lit(0)) / F.col("seconds") * 20.0).alias("rate"))
    decoded = tiles.decode_summary(_counts(spark, sf_dir).where("t_idx >= 60"), rates, g.bins, DT)
    return decisions.decoder_score(decoding.error(decoded, _truth(spark, sf_dir)))


@named("SELECT idx, arg_min(bin_id, (round(sqrt((s.x - b.x) * (s.x - b.x) + (s.y - b.y) * (s.y - b.y)), 9), bin_id)) AS bin_id FROM samples s CROSS JOIN bins b GROUP BY idx")
def nearest_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest bin of every event, also of those far outside."""
    return nearest.nearest_bin(samples(spark, sf_dir).select("idx", "x", "y"), grid(spark, sf_dir).bins).select("idx", "bin_id")


@named()
def place_fields_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields, and fields within them, of eight units."""
    return place_fields.place_fields(_unit_rates(spark, sf_dir), grid(spark, sf_dir).edges, min_size=3)
