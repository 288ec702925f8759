"""Several grids as one environment, joined by bridges between bins that are each other's nearest."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import Grid, bin_at, mutual_nearest, union_environments


class Composite(NamedTuple):
    """Bins (bin_id, part, ...) numbered on from part to part, links and bridges as edges."""

    parts: Sequence[Grid]
    offsets: Sequence[int]
    bins: DataFrame
    edges: DataFrame
    bridges: DataFrame


def compose(parts: Sequence[Grid], max_distance: float | None = None) -> Composite:
    """``parts`` as one; with ``max_distance``, bins of different parts that are each other's nearest within it are linked.

    A graph's distances, ways, rings, components and neighbourhoods then go across the
    bridges by the same operators as in one grid.
    """
    offsets, n = [], 0
    for p in parts:
        offsets.append(n)
        n += p.bins.count()
    shifted = [p.bins.withColumn("bin_id", F.col("bin_id") + o) for p, o in zip(parts, offsets)]
    none = parts[0].edges.select("src", "dst", "distance").limit(0)
    bridges = none
    for i, a in enumerate(shifted):
        for b in shifted[i + 1 :]:
            if max_distance is not None:
                bridges = bridges.union(mutual_nearest(a, b, max_distance))
    bins, edges = union_environments([(p.bins, p.edges) for p in parts], bridges)
    return Composite(parts, offsets, bins, edges, bridges)


def composite_bin_at(points: DataFrame, whole: Composite, out: str = "bin_id") -> DataFrame:
    """``points`` (x, y) with the bin of the first part that holds each; -1 where none does."""
    found = points
    for k, (part, offset) in enumerate(zip(whole.parts, whole.offsets)):
        found = bin_at(found, part, f"_{k}").withColumn(f"_{k}", F.when(F.col(f"_{k}") >= 0, F.col(f"_{k}") + offset))
    names = [f"_{k}" for k in range(len(whole.parts))]
    return found.withColumn(out, F.coalesce(*names, F.lit(-1))).drop(*names)


def bridges_between(whole: Composite) -> DataFrame:
    """(src_part, dst_part, n): how many bridges lead between each two parts."""
    of = lambda k: whole.bins.select(F.col("bin_id").alias(k), F.col("part").alias(f"{k}_part"))
    return whole.bridges.join(of("src"), "src").join(of("dst"), "dst").groupBy("src_part", "dst_part").agg(F.count("*").alias("n"))
