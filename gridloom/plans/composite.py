"""Queries on two grids of events joined by bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import composite, fields, layouts, regions
from ..operators.grid import regular_grid
from .catalog import named, samples
from .spatial import BOX

PARTS = """sides AS (SELECT CASE WHEN x < 100 THEN 0 ELSE 1 END AS part, CASE WHEN x < 100 THEN floor(x / 20.0)::BIGINT * 10 + floor(y / 10.0)::BIGINT ELSE floor((x - 100) / 25.0)::BIGINT * 5 + floor(y / 20.0)::BIGINT END AS cell
    FROM samples WHERE x >= 0 AND x < 200 AND y >= 0 AND y < 100),
  cb AS MATERIALIZED (SELECT row_number() OVER (ORDER BY part, cell) - 1 AS bin_id, part, cell, CASE WHEN part = 0 THEN cell // 10 ELSE cell // 5 END AS ix, CASE WHEN part = 0 THEN cell % 10 ELSE cell % 5 END AS iy,
    (CASE WHEN part = 0 THEN (cell // 10 + 0.5) * 20.0 ELSE 100 + (cell // 5 + 0.5) * 25.0 END)::DOUBLE AS x, (CASE WHEN part = 0 THEN (cell % 10 + 0.5) * 10.0 ELSE (cell % 5 + 0.5) * 20.0 END)::DOUBLE AS y
    FROM (SELECT part, cell FROM sides GROUP BY ALL HAVING count(*) >= 3)),
  near AS (SELECT a.bin_id AS src, b.bin_id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM cb a JOIN cb b ON a.part = 0 AND b.part = 1),
  bridges AS MATERIALIZED (SELECT src, dst, distance FROM (SELECT *, arg_min(dst, (distance, dst)) OVER (PARTITION BY src) AS bd, arg_min(src, (distance, src)) OVER (PARTITION BY dst) AS bs FROM near WHERE distance <= 60) WHERE dst = bd AND src = bs),
  ce AS MATERIALIZED (SELECT a.bin_id AS src, b.bin_id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM cb a JOIN cb b ON a.part = b.part AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND a.bin_id <> b.bin_id
    UNION ALL SELECT src, dst, distance FROM bridges UNION ALL SELECT dst, src, distance FROM bridges)"""


def _whole(spark: SparkSession, sf_dir: str) -> composite.Composite:
    s = samples(spark, sf_dir)
    left = regular_grid(spark, (0.0, 0.0), (20.0, 10.0), (5, 10), s, 3)
    right = regular_grid(spark, (100.0, 0.0), (25.0, 20.0), (4, 5), s, 3)
    return composite.compose([left, right], 60.0)


@named(f"""WITH {PARTS}, p AS (SELECT idx, CASE WHEN x >= 0 AND x < 100 AND y >= 0 AND y < 100 THEN 0 WHEN x >= 100 AND x < 200 AND y >= 0 AND y < 100 THEN 1 END AS part,
    CASE WHEN x < 100 THEN floor(x / 20.0)::BIGINT * 10 + floor(y / 10.0)::BIGINT ELSE floor((x - 100) / 25.0)::BIGINT * 5 + floor(y / 20.0)::BIGINT END AS cell FROM samples)
  SELECT idx, coalesce(bin_id, -1) AS bin_id, bin_id IS NOT NULL AS contained FROM p LEFT JOIN cb USING (part, cell)""")
def composite_bin_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's bin in the first of two grids that holds it."""
    found = composite.composite_bin_at(samples(spark, sf_dir).select("idx", "x", "y"), _whole(spark, sf_dir))
    return found.select("idx", "bin_id", (F.col("bin_id") >= 0).alias("contained"))


@named(f"WITH {PARTS} SELECT c.bin_id, c.part, c.x, c.y, (SELECT count(*) FROM ce WHERE src = c.bin_id) AS neighbors, (SELECT count(*) FROM bridges WHERE src = c.bin_id OR dst = c.bin_id) AS bridges FROM cb c", "x y")
def composite_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of both grids with their links and bridges."""
    w = _whole(spark, sf_dir)
    links = w.edges.groupBy(F.col("src").alias("bin_id")).agg(F.count("*").alias("n"))
    ends = w.bridges.select(F.explode(F.array("src", "dst")).alias("bin_id")).groupBy("bin_id").agg(F.count("*").alias("b"))
    d = w.bins.select("bin_id", "part", "x", "y").join(links, "bin_id", "left").join(ends, "bin_id", "left")
    return d.select("bin_id", "part", "x", "y", F.coalesce("n", F.lit(0)).alias("neighbors"), F.coalesce("b", F.lit(0)).alias("bridges"))


@named(f"""WITH RECURSIVE {PARTS}, d(i, bin_id, distance) AS (SELECT 0, 0::BIGINT, 0.0::DOUBLE UNION ALL SELECT i + 1, ce.dst, min(d.distance + ce.distance) FROM d JOIN ce ON ce.src = d.bin_id WHERE i < 30 GROUP BY i, ce.dst)
  SELECT bin_id, min(distance) AS distance FROM d GROUP BY bin_id""", "distance")
def composite_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest ways from the first bin of one grid to all of both, over the bridges."""
    w = _whole(spark, sf_dir)
    return fields.distance_field(w.edges, w.bins.where("bin_id = 0").select("bin_id"))


@named(f"""WITH RECURSIVE {PARTS}, h(bin_id, h) AS (SELECT 0::BIGINT, 0 UNION SELECT ce.dst, h + 1 FROM h JOIN ce ON ce.src = h.bin_id WHERE h < 30), d AS (SELECT bin_id, min(h) AS d FROM h GROUP BY bin_id),
  back AS (SELECT src, min(dst) AS before FROM ce JOIN d a ON a.bin_id = src JOIN d b ON b.bin_id = dst WHERE b.d = a.d - 1 GROUP BY src),
  way(target, step, bin_id) AS (SELECT bin_id, 0, bin_id FROM d UNION ALL SELECT target, step + 1, before FROM way JOIN back ON back.src = way.bin_id) SELECT * FROM way""")
def composite_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins on the ways from every bin of both grids to the first, by links and bridges."""
    w = _whole(spark, sf_dir)
    hops = fields.distance_field(w.edges, w.bins.where("bin_id = 0").select("bin_id"), hops=True)
    return layouts.path_between(w.edges.withColumn("distance", F.lit(1.0)), hops, w.bins.select("bin_id"))


@named(f"WITH {PARTS} SELECT bin_id, part FROM cb WHERE x BETWEEN {min(x for x, _ in BOX)} AND {max(x for x, _ in BOX)} AND y BETWEEN {min(y for _, y in BOX)} AND {max(y for _, y in BOX)}")
def composite_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of both grids whose centers a region holds."""
    w = _whole(spark, sf_dir)
    return w.bins.where(regions.contains(F.col("x"), F.col("y"), BOX)).select("bin_id", "part")
