"""Queries on what it costs to turn one rate map into another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import transport
from ..operators.grid import grid_edges
from .activity import _unit_rates
from .catalog import grid, named


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rates = _unit_rates(spark, sf_dir)
    units = rates.select("unit").distinct()
    chosen = units.select(F.col("unit").alias("a")).join(units.select(F.col("unit").alias("b")), F.col("a") < F.col("b"))
    return tuple(chosen.join(rates, F.col(k) == F.col("unit")).select("a", "b", "bin_id", "rate") for k in "ab")


@named(None, "cost")
def map_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earth mover's distance of the maps of any two units, in the plane."""
    return transport.earth_movers_distance(*_pairs(spark, sf_dir), grid(spark, sf_dir).bins, by=("a", "b"))


@named(None, "cost")
def map_transport_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same along the links between neighbouring bins."""
    bins = grid(spark, sf_dir).bins
    return transport.earth_movers_distance(*_pairs(spark, sf_dir), bins, grid_edges(bins), by=("a", "b"))


UNITS = "(SELECT * FROM (VALUES ('click', 'view'), ('error', 'purchase')) p(a, b))"


@named(f"""WITH n AS (SELECT event_type, CAST(floor(x / 20.0) AS BIGINT) AS bin_id, count(*)::DOUBLE AS n FROM samples WHERE x >= 0 AND x < 200 GROUP BY ALL),
  f AS (SELECT p.a, p.b, r.range AS bin_id, coalesce(i.n, 0) AS i, coalesce(j.n, 0) AS j FROM {UNITS} p CROSS JOIN range(0, 10) r
        LEFT JOIN n i ON i.event_type = p.a AND i.bin_id = r.range LEFT JOIN n j ON j.event_type = p.b AND j.bin_id = r.range),
  d AS (SELECT a, b, i / sum(i) OVER (PARTITION BY a, b) - j / sum(j) OVER (PARTITION BY a, b) AS e, bin_id FROM f)
  SELECT a, b, sum(abs(s)) * 20.0 AS cost FROM (SELECT a, b, sum(e) OVER (PARTITION BY a, b ORDER BY bin_id) AS s FROM d) GROUP BY a, b""", "cost")
def value_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earth mover's distance of two kinds of events over a line of bins of their values, along its links."""
    from .catalog import samples

    s = samples(spark, sf_dir).where("x >= 0 and x < 200")
    counts = s.groupBy("event_type", F.floor(F.col("x") / 20.0).alias("bin_id")).agg(F.count("*").cast("double").alias("rate"))
    pairs = [("click", "view"), ("error", "purchase")]
    kinds = [spark.createDataFrame([(a, b, p[k]) for p in pairs for a, b in [p]], "a string, b string, event_type string") for k in (0, 1)]
    line = spark.range(10).select(F.col("id").alias("bin_id"), ((F.col("id") + 0.5) * 20.0).alias("x"), F.lit(0.0).alias("y"))
    edges = spark.range(9).select(F.explode(F.array(F.struct(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), F.struct((F.col("id") + 1).alias("src"), F.col("id").alias("dst")))).alias("e")).select("e.*", F.lit(20.0).alias("distance"))
    a, b = (k.join(counts, "event_type").drop("event_type") for k in kinds)
    return transport.earth_movers_distance(a, b, line, edges, by=("a", "b"))
