"""Operators over fields on bins (bin_id, v): neighbourhoods, differential operators, smoothing, distances.

A missing value is null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_dir

_REDUCERS = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "std": F.stddev_pop}


def neighbor_reduce(field: DataFrame, edges: DataFrame, op: str = "mean", include_self: bool = False) -> DataFrame:
    """(bin_id, v): ``op`` (mean, sum, max, min or std) over the neighbours of each bin; null for isolated ones."""
    links = edges.select("src", "dst")
    if include_self:
        links = links.union(field.select("bin_id", "bin_id"))
    found = links.join(field.select(F.col("bin_id").alias("dst"), "v"), "dst").groupBy("src").agg(_REDUCERS[op]("v").alias("v"))
    return field.select("bin_id").join(found.withColumnRenamed("src", "bin_id"), "bin_id", "left")


def gradient(field: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, g) of each link once, src < dst: the difference times the root of its length."""
    at = lambda k: field.select(F.col("bin_id").alias(k), F.col("v").alias(f"v_{k}"))
    e = edges.where("src < dst").join(at("src"), "src").join(at("dst"), "dst")
    return e.select("src", "dst", (F.sqrt("distance") * (F.col("v_dst") - F.col("v_src"))).alias("g"), "distance")


def divergence(flow: DataFrame) -> DataFrame:
    """(bin_id, v) of link values (src, dst, g, distance): what leaves less what enters, by the root of the length."""
    weighted = F.sqrt("distance") * F.col("g")
    ends = F.array(F.struct(F.col("src").alias("bin_id"), (-weighted).alias("v")), F.struct(F.col("dst").alias("bin_id"), weighted.alias("v")))
    return flow.select(F.explode(ends).alias("e")).groupBy(F.col("e.bin_id").alias("bin_id")).agg(F.sum("e.v").alias("v"))


def normalize(field: DataFrame) -> DataFrame:
    """``field`` divided by its sum; null where the sum is 0."""
    return field.withColumn("v", F.try_divide(F.col("v"), F.sum("v").over(Window.partitionBy(F.lit(1)))))


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.when(F.isnan(v), v).otherwise(F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))


def combine(fields: Sequence[DataFrame], weights: Sequence[float] | None = None, mode: str = "mean") -> DataFrame:
    """One field from several over the same bins: weighted mean, max or min."""
    weights = weights or [1.0 / len(fields)] * len(fields)
    joined = fields[0].select("bin_id", F.col("v").alias("v0"))
    for k, f in enumerate(fields[1:], 1):
        joined = joined.join(f.select("bin_id", F.col("v").alias(f"v{k}")), "bin_id")
    columns = [F.col(f"v{k}") for k in range(len(fields))]
    if mode == "mean":
        total = sum(w * c for w, c in zip(weights, columns))
    else:
        total = (F.greatest if mode == "max" else F.least)(*columns)
    return joined.select("bin_id", total.alias("v"))


def gaussian_kernel(bins: DataFrame, bandwidth: float, cutoff: float = 4.0) -> DataFrame:
    """(src, dst, w) of bins up to ``cutoff`` bandwidths apart, from an equi-join on cells of that size."""
    reach = cutoff * bandwidth
    shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    cell = lambda c: F.floor(F.col(c) / reach)
    a = bins.select(F.col("bin_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"), shifts.alias("s"))
    a = a.select("src", "ax", "ay", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    b = bins.select(F.col("bin_id").alias("dst"), "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    d2 = (F.col("x") - F.col("ax")) * (F.col("x") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("y") - F.col("ay"))
    return a.join(b, ["cx", "cy"]).where(d2 <= reach * reach).select("src", "dst", F.exp(-d2 / (2 * bandwidth * bandwidth)).alias("w"))


def heat_kernel(edges: DataFrame, bins: DataFrame, sigma: float, steps: int = 8, face: Column | None = None) -> DataFrame:
    """(src, dst, w) of heat flow for time sigma**2 / 2, from ``steps`` implicit-free Euler products.

    Each link conducts ``face`` / distance; a bin holds its area.  The step is split so that
    no bin gives away more than it has, which keeps weights at 0 or above.
    """
    shared_dir(bins.sparkSession)
    face = F.lit(1.0) if face is None else face
    w = edges.select("src", "dst", (face / F.col("distance")).alias("w"))
    area = bins.select(F.col("bin_id").alias("src"), "area")
    rate = w.join(area, "src").select("src", "dst", (F.col("w") / F.col("area")).alias("r"))
    top = rate.groupBy("src").agg(F.sum("r").alias("r")).agg(F.max("r")).first()[0] or 0.0
    time = sigma * sigma / 2
    doublings = max(0, math.ceil(math.log2(max(1.0, 2 * time * top)))) + steps.bit_length() - 1
    small = time / (1 << doublings)
    out = rate.groupBy("src").agg(F.sum("r").alias("out"))
    stay = bins.select(F.col("bin_id").alias("src")).join(out, "src", "left").select("src", F.col("src").alias("dst"), (1 - small * F.coalesce("out", F.lit(0.0))).alias("w"))
    kernel = rate.select("src", "dst", (small * F.col("r")).alias("w")).union(stay).checkpoint()
    for _ in range(doublings):  # squaring doubles the time
        nxt = kernel.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("w").alias("w2"))
        kernel = kernel.join(nxt, "dst").groupBy("src", F.col("to").alias("dst")).agg(F.sum(F.col("w") * F.col("w2")).alias("w")).where("w > 1e-12").checkpoint()
    return kernel


def smooth(field: DataFrame, kernel: DataFrame) -> DataFrame:
    """(bin_id, v): weighted mean of the values that are there, by ``kernel`` (src, dst, w)."""
    known = field.where("v is not null").select(F.col("bin_id").alias("dst"), "v")
    found = kernel.join(known, "dst").groupBy(F.col("src").alias("bin_id")).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))
    return field.select("bin_id").join(found, "bin_id", "left")


def spread(field: DataFrame, kernel: DataFrame) -> DataFrame:
    """(bin_id, v): sum of w * v over ``kernel``, as for densities."""
    found = kernel.join(field.select(F.col("bin_id").alias("dst"), "v"), "dst")
    return found.groupBy(F.col("src").alias("bin_id")).agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def distance_field(edges: DataFrame, sources: DataFrame, cutoff: float | None = None, hops: bool = False) -> DataFrame:
    """(bin_id, distance) of the bins that links reach from ``sources`` (bin_id): the shortest way.

    Each round relaxes the links of bins whose distance has just changed; lineage is cut by
    a checkpoint each round.
    """
    shared_dir(edges.sparkSession)
    length = F.lit(1.0) if hops else F.col("distance").cast("double")
    links = edges.select("src", "dst", length.alias("length")).checkpoint()
    known = sources.select("bin_id", F.lit(0.0).alias("distance")).distinct().checkpoint()
    changed = known
    while changed.take(1):
        offers = changed.join(links, F.col("bin_id") == F.col("src")).select(F.col("dst").alias("bin_id"), (F.col("distance") + F.col("length")).alias("distance"))
        offers = offers if cutoff is None else offers.where(F.col("distance") <= cutoff)
        offers = offers.groupBy("bin_id").agg(F.min("distance").alias("offer"))
        both = known.join(offers, "bin_id", "full")
        better = F.col("offer").isNotNull() & (F.col("distance").isNull() | (F.col("offer") < F.col("distance") - 1e-9))
        both = both.select("bin_id", F.when(better, F.col("offer")).otherwise(F.col("distance")).alias("distance"), better.alias("better")).checkpoint()
        known, changed = both.select("bin_id", "distance"), both.where("better").select("bin_id", "distance")
    return known


def euclidean_distance(bins: DataFrame, targets: Sequence[tuple[float, float]]) -> DataFrame:
    """(bin_id, distance) to the nearest of a few points."""
    d = [F.sqrt((F.col("x") - a) * (F.col("x") - a) + (F.col("y") - b) * (F.col("y") - b)) for a, b in targets]
    return bins.select("bin_id", (F.least(*d) if len(d) > 1 else d[0]).alias("distance"))


def components(bins: DataFrame, edges: DataFrame) -> DataFrame:
    """(bin_id, component): the smallest bin that links reach, by rounds of the smallest neighbour's label."""
    shared_dir(bins.sparkSession)
    labels = bins.select("bin_id", F.col("bin_id").alias("component")).checkpoint()
    links = edges.select("src", "dst").checkpoint()
    while True:
        near = links.join(labels, F.col("dst") == F.col("bin_id")).groupBy("src").agg(F.min("component").alias("m"))
        nxt = labels.join(near, F.col("bin_id") == F.col("src"), "left").select("bin_id", F.least("component", F.coalesce("m", "component")).alias("c"), "component")
        # A label's own label is at least as small, which halves long ways.
        jump = nxt.select(F.col("bin_id").alias("b"), F.col("c").alias("j"))
        nxt = nxt.join(jump, F.col("c") == F.col("b")).select("bin_id", F.least("c", "j").alias("c"), "component").checkpoint()
        if not nxt.where("c <> component").take(1):
            return nxt.select("bin_id", F.col("c").alias("component"))
        labels = nxt.select("bin_id", F.col("c").alias("component"))


def rebin_field(field: DataFrame, mapping: DataFrame) -> DataFrame:
    """(bin_id, v): sums of ``field`` over ``mapping`` (bin_id, target)."""
    return field.join(mapping, "bin_id").groupBy(F.col("target").alias("bin_id")).agg(F.sum("v").alias("v"))
