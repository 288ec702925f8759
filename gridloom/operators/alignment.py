"""Between frames and environments: fitted transforms, mapped probabilities, resampled fields, basis functions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry
from . import fields


def fit_transform(pairs: DataFrame, kind: str = "affine") -> list[list[float]]:
    """The 2x3 matrix that moves (x, y) to (u, v) with least squares: rigid, similarity or affine.

    One pass of moments over all pairs; the driver solves a three by three system.
    """
    c = {"n": F.count("*"), **{k: F.sum(F.col(k)) for k in "xyuv"}, **{a + b: F.sum(F.col(a) * F.col(b)) for a in "xyuv" for b in "xyuv" if a <= b}}
    m = pairs.agg(*[e.cast("double").alias(f"m_{k}") for k, e in c.items()]).first().asDict()
    g = lambda a, b="": m["m_" + "".join(sorted(a + b)).replace(" ", "")]
    n = m["m_n"]
    if kind == "affine":
        normal = np.array([[g("x", "x"), g("x", "y"), g("x")], [g("x", "y"), g("y", "y"), g("y")], [g("x"), g("y"), n]])
        right = np.array([[g("u", "x"), g("v", "x")], [g("u", "y"), g("v", "y")], [g("u"), g("v")]])
        return np.linalg.solve(normal, right).T.tolist()
    mean = {k: g(k) / n for k in "xyuv"}
    cov = lambda a, b: g(a, b) - n * mean[a] * mean[b]
    dot, cross = cov("x", "u") + cov("y", "v"), cov("x", "v") - cov("u", "y")
    angle = math.atan2(cross, dot)
    scale = 1.0 if kind == "rigid" else math.sqrt((cov("u", "u") + cov("v", "v")) / (cov("x", "x") + cov("y", "y")))
    a, b = scale * math.cos(angle), scale * math.sin(angle)
    return [[a, -b, mean["u"] - a * mean["x"] + b * mean["y"]], [b, a, mean["v"] - b * mean["x"] - a * mean["y"]]]


def nearest_bins(bins: DataFrame, targets: DataFrame, reach: float, k: int = 1) -> DataFrame:
    """(bin_id, target, distance, rank): the ``k`` nearest targets within ``reach``, the lowest id of equal ones; an equi-join on cells."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    cell = lambda c: F.floor(F.col(c) / reach)
    a = bins.select("bin_id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"), steps.alias("s"))
    a = a.select("bin_id", "x", "y", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    b = targets.select(F.col("bin_id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"), cell("x").alias("cx"), cell("y").alias("cy"))
    d = a.join(b, ["cx", "cy"]).withColumn("distance", geometry.distance(F.col("x"), F.col("y"), F.col("tx"), F.col("ty"))).where(F.col("distance") <= reach)
    rank = F.row_number().over(Window.partitionBy("bin_id").orderBy("distance", "target"))
    return d.withColumn("rank", rank).where(F.col("rank") <= k).select("bin_id", "target", "distance", "rank")


def map_probabilities(p: DataFrame, bins: DataFrame, targets: DataFrame, reach: float, k: int = 1, eps: float = 1e-9) -> DataFrame:
    """(bin_id, p) on the bins of ``targets``: each bin's probability goes to its ``k`` nearest, by inverse distance."""
    near = nearest_bins(bins, targets, reach, k)
    share = 1 / (F.col("distance") + eps)
    near = near.withColumn("w", share / F.sum(share).over(Window.partitionBy("bin_id")))
    sums = p.join(near, "bin_id").groupBy(F.col("target").alias("bin_id")).agg(F.sum(F.col("p") * F.col("w")).alias("p"))
    return targets.select("bin_id").join(sums, "bin_id", "left").select("bin_id", F.coalesce("p", F.lit(0.0)).alias("p"))


def resample(field: DataFrame, bins: DataFrame, targets: DataFrame, reach: float) -> DataFrame:
    """(bin_id, v) on ``targets``: the value of the nearest bin; null where none is within ``reach``."""
    near = nearest_bins(targets, bins, reach).select("bin_id", "target")
    found = near.join(field.select(F.col("bin_id").alias("target"), "v"), "target").select("bin_id", "v")
    return targets.select("bin_id").join(found, "bin_id", "left")


def geodesic_basis(edges: DataFrame, centers: Sequence[int], sigma: float, cutoff: float = 4.0) -> DataFrame:
    """(center, bin_id, v): Gaussians of the graph distance from a few bins, of unit length each."""
    spark, out = edges.sparkSession, None
    for c in centers:
        d = fields.distance_field(edges, spark.createDataFrame([(c,)], "bin_id long"), cutoff * sigma)
        b = d.select(F.lit(c).alias("center"), "bin_id", F.exp(-F.col("distance") * F.col("distance") / (2 * sigma * sigma)).alias("v"))
        out = b if out is None else out.union(b)
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("center")))
    return out.withColumn("v", F.col("v") / norm)
