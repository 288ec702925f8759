"""Queries on population vectors, assemblies and progress along paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import distance
from ..functions.moments import correlation_sql
from ..operators import behavior, decoding, encoding
from ..operators.grid import bin_at
from .activity import _counts, _unit_rates
from .catalog import grid, named, samples

#: A made-up assembly: units and their weights.
ASSEMBLY = [(0, 0.5), (1, -0.5), (3, 0.7)]
#: Where paths are taken to begin and to end.
FROM, TO = (10.0, 5.0), (150.0, 80.0)


@named(f"""WITH v AS (SELECT u.unit, b.bin_id, coalesce(n, 0)::DOUBLE AS rate FROM bins b CROSS JOIN (SELECT DISTINCT session % 8 AS unit FROM samples) u
    LEFT JOIN (SELECT session % 8 AS unit, bin_id, count(*) AS n FROM placed WHERE event_type = 'view' GROUP BY ALL) USING (unit, bin_id))
  SELECT bin_id, {correlation_sql("a.rate", "v.rate")} AS r FROM unit_rates a JOIN v USING (unit, bin_id) WHERE a.rate IS NOT NULL GROUP BY bin_id""", "r")
def population_vector_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each bin, the units' rates against how often they viewed there."""
    rates, g = _unit_rates(spark, sf_dir), grid(spark, sf_dir)
    views = bin_at(samples(spark, sf_dir).where("event_type = 'view'"), g).groupBy(F.pmod("session", F.lit(8)).alias("unit"), "bin_id").agg(F.count("*").cast("double").alias("n"))
    maps = rates.select("unit", "bin_id").join(views, ["unit", "bin_id"], "left").select("unit", "bin_id", F.coalesce("n", F.lit(0.0)).alias("rate"))
    return encoding.population_vector_correlation(rates, maps)


@named(f"""WITH z AS (SELECT t_idx, unit, CASE WHEN stddev_pop(n) OVER w > 0 THEN (n - avg(n) OVER w) / stddev_pop(n) OVER w ELSE 0 END AS z FROM unit_counts WINDOW w AS (PARTITION BY unit)),
  a AS (SELECT t_idx, sum(z * w) AS a FROM z JOIN (VALUES {', '.join(f'({u}, {w}::DOUBLE)' for u, w in ASSEMBLY)}) s(unit, w) USING (unit) GROUP BY t_idx)
  SELECT t_idx, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS activation FROM a""", "activation")
def assembly_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How active an assembly is in every bin of time."""
    return decoding.assembly_activation(_counts(spark, sf_dir), ASSEMBLY)


@named(f"""WITH p AS (SELECT session, CASE WHEN a + b > 0 THEN a / (a + b) END AS p FROM (SELECT session, sqrt(pow(x - {FROM[0]}, 2) + pow(y - {FROM[1]}, 2)) AS a, sqrt(pow(x - {TO[0]}, 2) + pow(y - {TO[1]}, 2)) AS b FROM samples))
  SELECT session, avg(p) AS mean, min(p) AS least, max(p) AS most FROM p GROUP BY session""", "mean least most")
def path_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far sessions are on their way from one place to another."""
    x, y = F.col("x"), F.col("y")
    d = behavior.path_progress(samples(spark, sf_dir), *[distance(x, y, F.lit(p[0]), F.lit(p[1])) for p in (FROM, TO)])
    return d.groupBy("session").agg(F.avg("progress").alias("mean"), F.min("progress").alias("least"), F.max("progress").alias("most"))
