"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (u, v) is either one edge's u, or only a v."""
    seen = edges.select("u").union(edges.select("v").distinct())
    return seen.groupBy("u").count().where("count > 1").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): component is its smallest reachable node.

    Each round joins nodes with the smallest neighbour of theirs, and writes its links; a
    chain of n links takes about log n rounds.  The smallest neighbours are written before
    they are joined, so that a node with very many links is a skewed side which Spark can
    split.  Self-links and repeated links do no harm; an empty table gives an empty one.
    """
    scratch = Scratch(links.sparkSession, "components")
    larger, smaller = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = scratch.keep("edges-0", links.where("a <> b").select(larger, smaller).distinct())
    k = 0
    while not _all_stars(edges):
        k += 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(f"least-{k}", both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        star = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = scratch.keep(f"star-{k}", star.distinct())
        least = scratch.keep(f"small-{k}", star.groupBy("u").agg(F.min("v").alias("m")))
        spread = star.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.keep(f"edges-{k}", spread.union(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(f"edges-{k - 1}", f"least-{k}", f"star-{k}", f"small-{k}")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
