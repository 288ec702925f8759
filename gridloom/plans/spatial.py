"""Queries on environments, trajectories and fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binning
from ..operators import behavior, fields, grid as grids, regions, trajectory
from .catalog import MAX_GAP, SPAN, grid, named, samples


@named("SELECT bin_id, ix, iy, x, y, area FROM bins", "x y area")
def grid_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).bins.drop("cell")


@named("SELECT * FROM edges", "distance")
def grid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).edges


@named("SELECT bin_id, count(*) AS n FROM placed GROUP BY ALL")
def bin_at_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.bin_at(samples(spark, sf_dir), grid(spark, sf_dir)).groupBy("bin_id").agg(F.count("*").alias("n"))


@named("""SELECT bin_id FROM bins a WHERE (SELECT count(*) FROM bins b WHERE abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1) < 4""")
def boundary_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.boundary_bins(grid(spark, sf_dir))


@named("SELECT session, idx, dt IS NOT NULL AND bin_id >= 0 AND dt <= 172800.0 AS valid FROM stepped")
def interval_valid_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.intervals(samples(spark, sf_dir), grid(spark, sf_dir), MAX_GAP, span=SPAN).select("session", "idx", "valid")


@named("SELECT bin_id, seconds FROM occupied", "seconds")
def occupancy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.occupancy(samples(spark, sf_dir), grid(spark, sf_dir), MAX_GAP, span=SPAN).select("bin_id", "seconds")


@named("SELECT bin_id, n FROM occupied")
def occupancy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.occupancy(samples(spark, sf_dir), grid(spark, sf_dir), MAX_GAP, span=SPAN).select("bin_id", "n")


@named("""SELECT b.bin_id, coalesce(sum(s.seconds), 0.0) AS seconds FROM bins b LEFT JOIN (
  SELECT dt * (b - a) AS seconds, floor((x + (a + b) / 2 * (next_x - x)) / 20.0) AS ix, floor((y + (a + b) / 2 * (next_y - y)) / 10.0) AS iy FROM (
    SELECT *, cut AS a, lead(cut) OVER (PARTITION BY session, idx ORDER BY cut) AS b FROM (
      SELECT DISTINCT session, idx, dt, x, y, next_x, next_y, unnest(list_concat([0.0::DOUBLE, 1.0::DOUBLE],
        CASE WHEN x <> next_x THEN list_transform(range(ceil(least(x, next_x) / 20.0)::BIGINT, floor(greatest(x, next_x) / 20.0)::BIGINT + 1), lambda k: (k * 20.0 - x) / (next_x - x)) ELSE [] END,
        CASE WHEN y <> next_y THEN list_transform(range(ceil(least(y, next_y) / 10.0)::BIGINT, floor(greatest(y, next_y) / 10.0)::BIGINT + 1), lambda k: (k * 10.0 - y) / (next_y - y)) ELSE [] END)) AS cut
      FROM valid)) WHERE b IS NOT NULL) s ON s.ix = b.ix AND s.iy = b.iy GROUP BY b.bin_id""", "seconds")
def occupancy_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.occupancy_linear(samples(spark, sf_dir), grid(spark, sf_dir), MAX_GAP, span=SPAN)


@named("SELECT session, idx, bin_id FROM stepped WHERE prev_bin IS NULL OR prev_bin <> bin_id")
def bin_sequence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.bin_sequence(samples(spark, sf_dir), grid(spark, sf_dir), span=SPAN).select("session", "idx", "bin_id")


@named("""SELECT session, run, bin_id, min(t) AS start_t, max(t) AS stop_t, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN prev_bin IS NULL OR prev_bin <> bin_id THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY t, idx ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM stepped)
  GROUP BY ALL""", "start_t stop_t")
def bin_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.bin_runs(samples(spark, sf_dir), grid(spark, sf_dir), span=SPAN)


MOVES = "SELECT bin_id AS src, next_bin AS dst, count(*) AS n FROM stepped WHERE bin_id >= 0 AND next_bin >= 0 GROUP BY ALL"


@named(MOVES)
def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.transitions(samples(spark, sf_dir), grid(spark, sf_dir), span=SPAN).drop("p")


@named(f"SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS p FROM ({MOVES}) WHERE src = dst OR (src, dst) IN (SELECT (src, dst) FROM edges)", "p")
def transition_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.transitions(samples(spark, sf_dir), grid(spark, sf_dir), teleports=False, span=SPAN).drop("n")


@named("""SELECT bin_id AS src, dst, count(*) AS n FROM (SELECT bin_id, lead(bin_id, 3) OVER (PARTITION BY session ORDER BY t, idx) AS dst FROM placed)
  WHERE bin_id >= 0 AND dst >= 0 GROUP BY ALL""")
def transition_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.transitions(samples(spark, sf_dir), grid(spark, sf_dir), lag=3, span=SPAN).drop("p")


@named("SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS p FROM edges", "p")
def random_walk_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.random_walk(grid(spark, sf_dir))


@named("SELECT session, idx, length, CASE WHEN dt > 0 THEN length / dt WHEN dt IS NOT NULL THEN 0.0 END AS speed, atan2(next_y - y, next_x - x) AS heading FROM stepped", "length speed heading")
def step_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.steps(samples(spark, sf_dir), SPAN).select("session", "idx", "length", "speed", "heading")


TURNS = """SELECT session, idx, t, atan2((x - px) * (ny - y) - (y - py) * (nx - x) + 0.0, (x - px) * (nx - x) + (y - py) * (ny - y)) AS turn FROM (
  SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny
  FROM (SELECT session, idx, t, x, y FROM stepped WHERE prev_x IS NULL OR prev_x <> x OR prev_y <> y)
  WINDOW w AS (PARTITION BY session ORDER BY t, idx)) WHERE px IS NOT NULL AND nx IS NOT NULL"""


@named(f"SELECT session, idx, turn FROM ({TURNS})", "turn")
def turn_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.turn_angles(samples(spark, sf_dir), SPAN).select("session", "idx", "turn")


@named(f"SELECT session, idx, avg(turn) OVER (PARTITION BY session ORDER BY t, idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS curvature FROM ({TURNS})", "curvature")
def curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.curvature(samples(spark, sf_dir), 2, SPAN).select("session", "idx", "curvature")


@named("""SELECT bin_id, seconds FROM (SELECT *, coalesce(sum(seconds) OVER (ORDER BY seconds DESC, bin_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(seconds) OVER () AS total FROM occupied)
  WHERE b < 0.95 * total AND seconds > 0""", "seconds")
def home_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    occupied = trajectory.occupancy(samples(spark, sf_dir), grid(spark, sf_dir), MAX_GAP, span=SPAN)
    return trajectory.home_range(occupied.select("bin_id", "seconds"))


@named(" UNION ALL ".join(
    f"SELECT {k} AS lag, avg((lx - x) * (lx - x) + (ly - y) * (ly - y)) AS msd, count(*) AS n FROM (SELECT *, lead(x, {k}) OVER (PARTITION BY session ORDER BY t, idx) AS lx, lead(y, {k}) OVER (PARTITION BY session ORDER BY t, idx) AS ly FROM samples) WHERE lx IS NOT NULL"
    for k in (1, 2, 3, 4)), "msd")
def mean_square_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.mean_square_displacement(samples(spark, sf_dir), 4, SPAN)


BOX = [(20.0, 20.0), (120.0, 20.0), (120.0, 75.0), (20.0, 75.0)]
KITE = [(10.0, 50.0), (90.0, 95.0), (170.0, 50.0), (90.0, 5.0)]
IN_BOX = "x >= 20 AND x <= 120 AND y >= 20 AND y <= 75"


@named(f"""SELECT session, idx, CASE WHEN inside THEN 'entry' ELSE 'exit' END AS direction FROM (
  SELECT *, lag(inside) OVER (PARTITION BY session ORDER BY t, idx) AS before FROM (SELECT *, {IN_BOX} AS inside FROM samples)) WHERE before IS NOT NULL AND before <> inside""")
def region_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = regions.contains(F.col("x"), F.col("y"), BOX)
    return trajectory.region_crossings(samples(spark, sf_dir), inside, SPAN).select("session", "idx", "direction")


@named("""SELECT 'box' AS region, bin_id FROM bins WHERE x > 20 AND x < 120 AND y > 20 AND y < 75
  UNION ALL SELECT 'kite', bin_id FROM bins WHERE abs(x - 90) / 80 + abs(y - 50) / 45 < 1 - 1e-9""")
def region_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.membership(grid(spark, sf_dir).bins, {"box": BOX, "kite": KITE, "spot": (50.0, 50.0)})


@named("""SELECT CASE WHEN l IS NULL THEN '' ELSE l END AS regions, count(*) AS n FROM (
  SELECT concat_ws(',', CASE WHEN x >= 20 AND x <= 120 AND y >= 20 AND y <= 75 THEN 'box' END, CASE WHEN abs(x - 90) / 80 + abs(y - 50) / 45 <= 1 + 1e-9 THEN 'kite' END) AS l FROM samples) GROUP BY ALL""")
def regions_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = regions.label_points(samples(spark, sf_dir), {"box": BOX, "kite": KITE})
    return d.groupBy(F.concat_ws(",", "regions").alias("regions")).agg(F.count("*").alias("n"))


@named(f"""SELECT inside AS label, coalesce(sum(CASE WHEN next_t - t <= 172800.0 THEN next_t - t END), 0.0) AS seconds, count_if(before IS NULL OR before <> inside) AS visits FROM (
  SELECT *, lag(inside) OVER w AS before, lead(t) OVER w AS next_t FROM (SELECT *, {IN_BOX} AS inside FROM samples) WINDOW w AS (PARTITION BY session ORDER BY t, idx)) GROUP BY inside""", "seconds")
def region_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.dwell(samples(spark, sf_dir), regions.contains(F.col("x"), F.col("y"), BOX), MAX_GAP, SPAN)


@named("""SELECT q, r, count(*) AS n FROM (
  SELECT CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END::BIGINT AS q, CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END::BIGINT AS r FROM (
    SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM (
      SELECT *, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(s, 0) AS rs FROM (
        SELECT q, r, -q - r AS s FROM (SELECT (sqrt(3) / 3 * x - y / 3) / 15.0 AS q, (2.0::DOUBLE / 3 * y) / 15.0 AS r FROM samples))))) GROUP BY ALL""")
def hex_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = binning.hex_axial(F.col("x"), F.col("y"), 15.0)
    return samples(spark, sf_dir).groupBy(q.alias("q"), r.alias("r")).agg(F.count("*").alias("n"))


@named("SELECT (cell // 10) // 2 * 5 + (cell % 10) // 2 AS bin_id, sum(v) AS v FROM field JOIN bins USING (bin_id) GROUP BY ALL", "v")
def rebin(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    coarse = grids.rebin(spark, g, 2)
    target = (F.floor(F.col("ix") / 2) * coarse.shape[1] + F.floor(F.col("iy") / 2)).cast("long")
    mapping = g.bins.select("bin_id", target.alias("target"))
    return fields.rebin_field(_field(spark, sf_dir), mapping)


@named("SELECT src, dst, sqrt((1.5 * (b.x - a.x)) * (1.5 * (b.x - a.x)) + (0.5 * (b.y - a.y)) * (0.5 * (b.y - a.y))) AS distance FROM edges JOIN bins a ON a.bin_id = src JOIN bins b ON b.bin_id = dst", "distance")
def affine_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return grids.transform(g.bins, g.edges, [[1.5, 0.0, 3.0], [0.0, 0.5, -2.0]])[1]


@named("""SELECT s AS src, d AS dst, distance FROM edges JOIN (SELECT bin_id AS src, row_number() OVER (ORDER BY cell) - 1 AS s FROM bins WHERE x < 100) USING (src)
  JOIN (SELECT bin_id AS dst, row_number() OVER (ORDER BY cell) - 1 AS d FROM bins WHERE x < 100) USING (dst)""", "distance")
def subset_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.subset(grid(spark, sf_dir), F.col("x") < 100).edges


def _field(spark: SparkSession, sf_dir: str) -> DataFrame:
    occupied = trajectory.occupancy(samples(spark, sf_dir), grid(spark, sf_dir), MAX_GAP, span=SPAN)
    return occupied.select("bin_id", F.col("seconds").alias("v"))


def _reduced(op: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fields.neighbor_reduce(_field(spark, sf_dir), grid(spark, sf_dir).edges, op)

    run.__name__ = f"neighbor_{op}"
    return run


for _op, _sql in {"mean": "avg", "sum": "sum", "max": "max", "min": "min", "std": "stddev_pop"}.items():
    named(f"SELECT b.bin_id, r.v FROM bins b LEFT JOIN (SELECT src, {_sql}(v) AS v FROM edges JOIN field ON dst = bin_id GROUP BY src) r ON r.src = b.bin_id", "v")(_reduced(_op))


GRADIENT = "SELECT src, dst, sqrt(distance) * (b.v - a.v) AS g, distance FROM edges JOIN field a ON src = a.bin_id JOIN field b ON dst = b.bin_id WHERE src < dst"


@named(f"SELECT src, dst, g FROM ({GRADIENT})", "g")
def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.gradient(_field(spark, sf_dir), grid(spark, sf_dir).edges).drop("distance")


@named(f"SELECT bin_id, sum(v) AS v FROM (SELECT src AS bin_id, -sqrt(distance) * g AS v FROM ({GRADIENT}) UNION ALL SELECT dst, sqrt(distance) * g FROM ({GRADIENT})) GROUP BY ALL", "v")
def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.divergence(fields.gradient(_field(spark, sf_dir), grid(spark, sf_dir).edges))


@named("SELECT bin_id, v / sum(v) OVER () AS v FROM field", "v")
def normalized_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.normalize(_field(spark, sf_dir))


@named("SELECT bin_id, 0.25 * v + 0.75 * least(greatest(v, 1000.0), 500000.0) AS v FROM field", "v")
def combined_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _field(spark, sf_dir)
    return fields.combine([v, v.withColumn("v", fields.clamp(F.col("v"), 1000.0, 500000.0))], [0.25, 0.75])


KERNEL = "SELECT a.bin_id AS src, b.bin_id AS dst, exp(-((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 800.0) AS w FROM bins a JOIN bins b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 6400"


@named(f"SELECT src AS bin_id, sum(w * v) / sum(w) AS v FROM ({KERNEL}) JOIN field ON dst = bin_id GROUP BY ALL", "v")
def gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.smooth(_field(spark, sf_dir), fields.gaussian_kernel(grid(spark, sf_dir).bins, 20.0))


@named("SELECT bin_id, least(sqrt((x - 30) * (x - 30) + (y - 40) * (y - 40)), sqrt((x - 150) * (x - 150) + (y - 60) * (y - 60))) AS distance FROM bins", "distance")
def distance_to_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.euclidean_distance(grid(spark, sf_dir).bins, [(30.0, 40.0), (150.0, 60.0)])


@named("""SELECT bin_id, min(h)::DOUBLE AS distance FROM (SELECT * FROM hops) GROUP BY bin_id""".replace("(SELECT * FROM hops)", """(
  WITH RECURSIVE hops(bin_id, h) AS (SELECT 0::BIGINT, 0 UNION SELECT e.dst, h + 1 FROM hops JOIN edges e ON e.src = hops.bin_id WHERE h < 20) SELECT * FROM hops)"""), "distance")
def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return fields.distance_field(g.edges, g.bins.where("bin_id = 0").select("bin_id"), cutoff=20.0, hops=True)


@named("""WITH RECURSIVE d(bin_id, distance, k) AS (SELECT 0::BIGINT, 0.0::DOUBLE, 0 UNION ALL SELECT e.dst, min(d.distance + e.distance), any_value(d.k) + 1 FROM d JOIN edges e ON e.src = d.bin_id WHERE d.k < 40 GROUP BY e.dst)
  SELECT bin_id, min(distance) AS distance FROM d GROUP BY bin_id""", "distance")
def geodesic_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return fields.distance_field(g.edges, g.bins.where("bin_id = 0").select("bin_id"))


@named("""SELECT a AS bin_id, min(b) AS component FROM (WITH RECURSIVE reach(a, b) AS (SELECT bin_id, bin_id FROM bins UNION SELECT a, e.dst FROM reach JOIN edges e ON e.src = b) SELECT * FROM reach) GROUP BY a""")
def grid_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return fields.components(g.bins, g.edges)


@named()
def heat_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return fields.spread(_field(spark, sf_dir), fields.heat_kernel(g.edges, g.bins, 100.0))
