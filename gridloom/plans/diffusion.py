"""Queries on heat over layouts of events, its transitions, and filters of Laplacians."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diffusion, gam, grid as grids, layouts, mesh, spectral
from .activity import _rates
from .catalog import WIDTH, grid, named, samples
from .layouts import HEX, PI
from .tracks import CROSSED, TRACK_BINS, TRACK_LINKS, derived_track

#: What a grid's faces are in SQL.
FACES = """SELECT a.bin_id AS src, b.bin_id AS dst, CASE WHEN a.ix <> b.ix THEN 20.0 ELSE 10.0 END AS distance, CASE WHEN a.ix <> b.ix THEN 10.0 ELSE 20.0 END AS face
  FROM bins a JOIN bins b ON abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1"""


def taylor_sql(faces: str, volumes: str, start: str, time: float, terms: int, key: str = "", mass: bool = False) -> str:
    """exp(-time * A) of ``start`` ((key,) bin_id, v) as a Taylor series, in SQL; a check on the Chebyshev series."""
    k = f"{key}, " if key else ""
    return f"""WITH RECURSIVE faces AS ({faces}), volumes AS ({volumes}), start AS ({start}),
      flows AS (SELECT src, dst, face / distance / v.volume AS w FROM faces JOIN volumes v ON v.bin_id = {'dst' if mass else 'src'}),
      rows AS (SELECT src, dst, -w AS w FROM flows UNION ALL SELECT {'dst, dst' if mass else 'src, src'}, sum(w) FROM flows GROUP BY {'dst' if mass else 'src'}),
      terms(i, {k}bin_id, v) AS (SELECT 0, {k}bin_id, v::DOUBLE FROM start UNION ALL
        SELECT t.i + 1, {k}r.src, sum(-{time!r}::DOUBLE / (t.i + 1) * r.w * t.v) FROM terms t JOIN rows r ON r.dst = t.bin_id WHERE t.i < {terms} GROUP BY ALL)
      SELECT {k}bin_id, sum(v) AS v FROM terms GROUP BY ALL"""


HEX_FACES = "SELECT a.bin_id AS src, b.bin_id AS dst, 15 * sqrt(3) AS distance, 15.0::DOUBLE AS face FROM h a JOIN h b ON (b.q - a.q, b.r - a.r) IN ((1, 0), (0, 1), (-1, 0), (0, -1), (1, -1), (-1, 1))"
HEX_COUNTS = HEX.replace("AS bin_id, q, r,", "AS bin_id, n, q, r,").replace("FROM (SELECT q, r FROM (", "FROM (SELECT q, r, count(*) AS n FROM (", 1)


@named(f"WITH h AS ({HEX_COUNTS}) SELECT * FROM ({taylor_sql(HEX_FACES, 'SELECT bin_id, area AS volume FROM h', 'SELECT bin_id, n AS v FROM h', 200.0, 40, mass=True)})", "v")
def heat_hexagons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in hexagons, spread by heat: none is lost."""
    s = samples(spark, sf_dir)
    bins, edges = layouts.hex_environment(s, 15.0, 3)
    counts = layouts.hex_counts(s, bins, 15.0)
    return diffusion.heat(counts, bins, diffusion.hex_faces(edges), 20.0, mass=True)


POLAR = f"SELECT range AS bin_id, range // 12 AS i, range % 12 AS j, (range // 12 + 0.5) * 10.0::DOUBLE AS r, (range // 12 + 0.5) * 10.0 * 10.0 * 2 * {PI} / 12 AS volume FROM range(0, 60)"
POLAR_FACES = f"""SELECT a.bin_id AS src, c.bin_id AS dst, CASE WHEN a.j = c.j THEN 10.0 ELSE a.r * (2 * {PI} / 12) END AS distance, CASE WHEN a.j = c.j THEN (a.r + c.r) / 2 * (2 * {PI} / 12) ELSE 10.0 END AS face
  FROM polar a JOIN polar c ON (a.j = c.j AND abs(a.i - c.i) = 1) OR (a.i = c.i AND abs(a.j - c.j) IN (1, 11))"""
POLAR_COUNTS = f"""SELECT p.bin_id, coalesce(n, 0) AS v FROM polar p LEFT JOIN (SELECT bin_id, count(*) AS n FROM (
  SELECT CASE WHEN r < 50 THEN floor(r / 10.0)::BIGINT * 12 + floor((b + {PI}) / (2 * {PI} / 12))::BIGINT % 12 ELSE -1 END AS bin_id FROM (
    SELECT sqrt((x - 100) * (x - 100) + (y - 50) * (y - 50)) AS r, atan2(y - 50, x - 100) AS b FROM samples)) GROUP BY bin_id) USING (bin_id)"""


@named(f"WITH polar AS ({POLAR}) SELECT * FROM ({taylor_sql(POLAR_FACES, 'SELECT bin_id, volume FROM polar', POLAR_COUNTS, 8.0, 60, mass=True)})", "v")
def heat_polar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in polar bins around a point, spread by heat over arcs and radii, round the seam."""
    bins = grids.polar_bins(spark, (0.0, 50.0, 5), 12)
    dx, dy = F.col("x") - 100.0, F.col("y") - 50.0
    at = samples(spark, sf_dir).select(layouts.polar_bin(F.sqrt(dx * dx + dy * dy), F.atan2(dy, dx), (0.0, 50.0, 5), 12).alias("bin_id"))
    seen = at.groupBy("bin_id").agg(F.count("*").alias("n"))
    counts = bins.select("bin_id").join(seen, "bin_id", "left").select("bin_id", F.coalesce("n", F.lit(0)).cast("double").alias("v"))
    return diffusion.heat(counts, bins, diffusion.polar_faces(bins, layouts.polar_edges(bins, 12), 12), 4.0, mass=True)


TRACK_FACES = "SELECT src, dst, distance, 1.0::DOUBLE AS face FROM crossed"


@named(f"""WITH tb AS ({TRACK_BINS}), tl AS ({TRACK_LINKS}), crossed AS ({CROSSED})
  SELECT * FROM ({taylor_sql(TRACK_FACES, 'SELECT bin_id, length AS volume FROM tb', 'SELECT bin_id, bin_id % 3 AS v FROM tb', 50.0, 60)})""", "v")
def heat_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field on a track through the middles of events, the way measured along it at its bends."""
    bins = grids.track_bins(derived_track(spark, sf_dir), 5.0)
    faces = diffusion.track_faces(bins, layouts.track_edges(bins, 0.1))
    return diffusion.heat(bins.select("bin_id", F.pmod("bin_id", F.lit(3)).cast("double").alias("v")), bins, faces, 10.0, volume="length")


@named(f"SELECT bin_id AS src, key AS dst, v AS p FROM ({taylor_sql(FACES, 'SELECT bin_id, area AS volume FROM bins', 'SELECT bin_id AS key, bin_id, 1 AS v FROM bins', 50.0, 60, 'key')}) WHERE v > 1e-5", "p")
def diffusion_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return diffusion.diffusion_transitions(g.bins, diffusion.grid_faces(g.bins, g.edges, WIDTH), 10.0, least=1e-5)


SPREAD = taylor_sql(FACES, "SELECT bin_id, area AS volume FROM bins", "SELECT unit || part AS key, bin_id, v FROM (SELECT unit, 'a' AS part, bin_id, rate * 1e6 AS v FROM rates WHERE rate IS NOT NULL UNION ALL SELECT unit, 'b', bin_id, 1 FROM rates WHERE rate IS NOT NULL)", 50.0, 60, "key")


@named(f"WITH s AS ({SPREAD}) SELECT unit, r.bin_id, a.v / b.v AS rate_e6 FROM rates r LEFT JOIN s a ON a.key = unit || 'a' AND a.bin_id = r.bin_id LEFT JOIN s b ON b.key = unit || 'b' AND b.bin_id = r.bin_id", "rate_e6")
def diffused_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate maps of all units smoothed by heat at once, bins without a rate left out of the mean."""
    g = grid(spark, sf_dir)
    field = _rates(spark, sf_dir).select("unit", "bin_id", (F.col("rate") * 1e6).alias("v"))
    return diffusion.diffused(field, g.bins, diffusion.grid_faces(g.bins, g.edges, WIDTH), 10.0, ["unit"]).select("unit", "bin_id", F.col("v").alias("rate_e6"))


LAPLACE = "SELECT src, dst, -distance AS w FROM edges UNION ALL SELECT src, src, sum(distance) FROM edges GROUP BY src"
_DEGREES = " UNION ALL ".join(f"SELECT center, {k} AS degree, bin_id, v FROM t{k}" for k in range(5))
_STEP = "SELECT center, bin_id, sum(v) AS v FROM (SELECT center, src AS bin_id, {f} * s.w * t.v AS v FROM t{a} t JOIN scaled s ON s.dst = t.bin_id UNION ALL SELECT center, bin_id, -v FROM t{b}) GROUP BY ALL"


@named(f"""WITH l AS ({LAPLACE}), top AS (SELECT 2 * max(w) AS top FROM l WHERE src = dst), scaled AS MATERIALIZED (SELECT src, dst, w * 2 / top - CASE WHEN src = dst THEN 1 ELSE 0 END AS w FROM l, top),
  t0 AS MATERIALIZED (SELECT bin_id AS center, bin_id, 1.0::DOUBLE AS v FROM bins WHERE bin_id % 25 = 0),
  t1 AS MATERIALIZED (SELECT center, src AS bin_id, sum(s.w * t.v) AS v FROM t0 t JOIN scaled s ON s.dst = t.bin_id GROUP BY ALL),
  {", ".join(f"t{k} AS MATERIALIZED ({_STEP.format(f=2, a=k - 1, b=k - 2)})" for k in (2, 3, 4))} SELECT center, degree, bin_id, v FROM ({_DEGREES}) WHERE abs(v) > 1e-5""", "v")
def chebyshev_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    d = diffusion.chebyshev_basis(g.bins.where("bin_id % 25 = 0").select("bin_id"), diffusion.graph_laplacian(g.bins, g.edges), 4)
    return d.where("abs(v) > 1e-5")


@named(f"""WITH RECURSIVE l AS ({LAPLACE}), terms(i, scale, center, bin_id, v) AS (SELECT 0, s, bin_id, bin_id, 1.0::DOUBLE FROM bins, (VALUES (0.005::DOUBLE), (0.02)) x(s) WHERE bin_id % 25 = 0 UNION ALL
    SELECT t.i + 1, scale, center, l.src, sum(-scale / (t.i + 1) * l.w * t.v) FROM terms t JOIN l ON l.dst = t.bin_id WHERE t.i < 50 GROUP BY ALL)
  SELECT center, scale, bin_id, sum(v) AS v FROM terms GROUP BY ALL HAVING abs(sum(v)) > 1e-5""", "v")
def heat_wavelets(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    d = diffusion.heat_wavelets(g.bins.where("bin_id % 25 = 0").select("bin_id"), diffusion.graph_laplacian(g.bins, g.edges), (0.005, 0.02))
    return d.where("abs(v) > 1e-5")


def _modes(spark: SparkSession, sf_dir: str, rank: int) -> tuple:
    g = grid(spark, sf_dir)
    return g, spectral.eigenbasis(g.bins, diffusion.grid_faces(g.bins, g.edges, WIDTH), rank)


@named()
def heat_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slowest modes of heat flow over the bins of events, and whether heat of width 10 leaves them at a thousandth."""
    _, (values, _) = _modes(spark, sf_dir, 12)
    return values.select("component", "mode", F.round("eigenvalue", 9).alias("eigenvalue"), (F.exp(F.col("eigenvalue") * -50.0) >= 1e-3).alias("kept"))


@named()
def penalised_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate maps as penalised Poisson models, one penalty for all units, chosen by restricted likelihood."""
    g, (values, modes) = _modes(spark, sf_dir, 12)
    rates = _rates(spark, sf_dir)
    days = rates.groupBy("bin_id").agg((F.max("seconds") / 86400.0).alias("seconds"))
    columns, d, n_constants = spectral.live_basis(g.bins, values, modes, days, 12)
    maps, fits = gam.fit_rate_maps(rates.select("unit", "bin_id", "n"), days, columns, d, n_constants)
    return maps.join(fits, "unit").select("unit", "bin_id", F.round("rate", 4).alias("rate_per_day"), F.round("log_penalty", 2).alias("log_penalty"))


# A mesh through the middles of the events of each cell

CORNERS = "SELECT cell AS id, avg(x) AS x, avg(y) AS y FROM cells WHERE cell IS NOT NULL GROUP BY cell"
TRIPLES = """SELECT p.id AS a, q.id AS b, r.id AS c, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_, r.x AS cx, r.y AS cy, q.x - p.x AS ux, q.y - p.y AS uy, r.x - p.x AS wx, r.y - p.y AS wy,
    2 * ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)) AS d FROM corners p JOIN corners q ON p.id < q.id JOIN corners r ON q.id < r.id"""
CIRCLES = """SELECT *, ax + ox AS mx, ay + oy AS my, ox * ox + oy * oy AS rr FROM (SELECT *, (wy * (ux * ux + uy * uy) - uy * (wx * wx + wy * wy)) / d AS ox, (ux * (wx * wx + wy * wy) - wx * (ux * ux + uy * uy)) / d AS oy FROM triples WHERE abs(d) > 2e-9 * 625)
    WHERE ox * ox + oy * oy <= 625"""
#: Bins of the mesh, by brute force: circles of at most 25 that hold no other corner.
MESH = f"""WITH corners AS ({CORNERS}), triples AS ({TRIPLES}), circles AS ({CIRCLES})
  SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS bin_id, a, b, c, ax, ay, bx, by_, cx, cy, (ax + bx + cx) / 3 AS x, (ay + by_ + cy) / 3 AS y, abs(d) / 4 AS area FROM circles t
  WHERE (ax + bx + cx) / 3 < 180 AND NOT EXISTS (SELECT 1 FROM corners o WHERE o.id NOT IN (a, b, c) AND (o.x - mx) * (o.x - mx) + (o.y - my) * (o.y - my) < rr)"""


def _mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g = grid(spark, sf_dir)
    s = samples(spark, sf_dir).withColumn("id", g.cell(F.col("x"), F.col("y"))).where("id is not null")
    corners = s.groupBy("id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return mesh.mesh(corners, 25.0, F.col("x") < 180)


@named(f"SELECT bin_id, a, b, c, x, y, area FROM ({MESH})", "x y area")
def mesh_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles between the middles of the events of each cell."""
    return _mesh(spark, sf_dir)[0].select("bin_id", "a", "b", "c", "x", "y", "area")


@named(f"""WITH m AS MATERIALIZED ({MESH}), s AS (SELECT bin_id, x, y, a AS i, b AS j, sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)) AS face FROM m UNION ALL SELECT bin_id, x, y, a, c, sqrt((ax - cx) * (ax - cx) + (ay - cy) * (ay - cy)) FROM m
    UNION ALL SELECT bin_id, x, y, b, c, sqrt((bx - cx) * (bx - cx) + (by_ - cy) * (by_ - cy)) FROM m)
  SELECT p.bin_id AS src, q.bin_id AS dst, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS distance, p.face FROM s p JOIN s q ON p.i = q.i AND p.j = q.j AND p.bin_id <> q.bin_id""", "distance face")
def mesh_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mesh(spark, sf_dir)[1]


@named(f"""WITH m AS MATERIALIZED ({MESH}), h AS (SELECT idx, min(bin_id) AS bin_id FROM (SELECT s.idx, m.bin_id, (bx - ax) * (s.y - ay) - (by_ - ay) * (s.x - ax) AS p, (cx - bx) * (s.y - by_) - (cy - by_) * (s.x - bx) AS q, (ax - cx) * (s.y - cy) - (ay - cy) * (s.x - cx) AS r
    FROM samples s JOIN m ON s.x BETWEEN least(ax, bx, cx) AND greatest(ax, bx, cx) AND s.y BETWEEN least(ay, by_, cy) AND greatest(ay, by_, cy)) WHERE least(p, q, r) >= 0 OR greatest(p, q, r) <= 0 GROUP BY idx)
  SELECT idx, coalesce(bin_id, -1) AS bin_id FROM samples LEFT JOIN h USING (idx)""")
def mesh_bin_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triangle of every event."""
    return mesh.mesh_bin_at(samples(spark, sf_dir).select("idx", "x", "y"), _mesh(spark, sf_dir)[0], 20.0).select("idx", "bin_id")
