"""Bayesian decoding of position from counts (t_idx, unit, n) and rate maps (unit, bin_id, rate)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.moments import CONSTANT, correlation
from . import events


def log_likelihood(counts: DataFrame, rates: DataFrame, dt: float, min_rate: float = 1e-10) -> DataFrame:
    """(t_idx, bin_id, ll): Poisson, without the factorials, which are the same for all bins.

    Only units that fired are joined; silence enters as one sum for each bin.
    """
    r = rates.select("unit", "bin_id", F.greatest(F.coalesce("rate", F.lit(0.0)), F.lit(min_rate)).alias("rate"))
    silent = r.groupBy("bin_id").agg(F.sum(F.col("rate") * dt).alias("expected"))
    fired = counts.where("n > 0").join(r, "unit").groupBy("t_idx", "bin_id").agg(F.sum(F.col("n") * F.log(F.col("rate") * dt)).alias("heard"))
    frame = counts.select("t_idx").distinct().crossJoin(silent)
    d = frame.join(fired, ["t_idx", "bin_id"], "left")
    return d.select("t_idx", "bin_id", (F.coalesce("heard", F.lit(0.0)) - F.col("expected")).alias("ll"))


def posterior(ll: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(t_idx, bin_id, p): likelihood times prior (bin_id, p), normalised over bins; uniform without a prior."""
    if prior is not None:
        total = F.sum("q").over(Window.partitionBy(F.lit(1)))
        q = prior.select("bin_id", F.col("p").alias("q")).withColumn("q", F.greatest(F.col("q") / total, F.lit(1e-10)))
        ll = ll.join(q, "bin_id").withColumn("ll", F.col("ll") + F.log("q")).drop("q")
    w = Window.partitionBy("t_idx")
    e = ll.withColumn("e", F.exp(F.col("ll") - F.max("ll").over(w)))
    return e.select("t_idx", "bin_id", (F.col("e") / F.sum("e").over(w)).alias("p"))


def estimates(post: DataFrame, bins: DataFrame) -> DataFrame:
    """Per t_idx: map_bin (the first of equal ones) and its place, mean place, entropy in bits, peak probability."""
    d = post.join(bins.select("bin_id", "x", "y"), "bin_id")
    best = F.max_by(F.struct("bin_id", "x", "y"), F.struct("p", -F.col("bin_id")))
    found = d.groupBy("t_idx").agg(
        best.alias("m"),
        F.sum(F.col("p") * F.col("x")).alias("mean_x"),
        F.sum(F.col("p") * F.col("y")).alias("mean_y"),
        (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")))).alias("entropy"),
        F.max("p").alias("peak"),
    )
    return found.select("t_idx", F.col("m.bin_id").alias("map_bin"), F.col("m.x").alias("map_x"), F.col("m.y").alias("map_y"), "mean_x", "mean_y", "entropy", "peak")


def credible_region(post: DataFrame, level: float) -> DataFrame:
    """(t_idx, bin_id, p): the most probable bins until they hold ``level``."""
    order = Window.partitionBy("t_idx").orderBy(F.col("p").desc(), "bin_id").rowsBetween(Window.unboundedPreceding, -1)
    return post.withColumn("_b", F.coalesce(F.sum("p").over(order), F.lit(0.0))).where(F.col("_b") < level).drop("_b")


def error(decoded: DataFrame, truth: DataFrame) -> DataFrame:
    """(t_idx, error): distance of map_x, map_y from x, y of ``truth``."""
    d = decoded.join(truth.select("t_idx", "x", "y"), "t_idx")
    square = (F.col("map_x") - F.col("x")) * (F.col("map_x") - F.col("x")) + (F.col("map_y") - F.col("y")) * (F.col("map_y") - F.col("y"))
    return d.select("t_idx", F.sqrt(square).alias("error"))


def confusion(decoded: DataFrame, truth: DataFrame) -> DataFrame:
    """(actual, decoded, n) of truth (t_idx, bin_id) against map_bin."""
    return decoded.join(truth.select("t_idx", F.col("bin_id").alias("actual")), "t_idx").groupBy("actual", F.col("map_bin").alias("decoded")).agg(F.count("*").alias("n"))


def expected_confusion(post: DataFrame, truth: DataFrame) -> DataFrame:
    """(actual, bin_id, p): probability given to each bin while the truth was in another."""
    return post.join(truth.select("t_idx", F.col("bin_id").alias("actual")), "t_idx").groupBy("actual", "bin_id").agg(F.sum("p").alias("p"))


def linear_fit(post: DataFrame, position: DataFrame, dt: float) -> DataFrame:
    """(slope, intercept, r2) of the posterior-weighted line of position (bin_id, s) over time t_idx * dt."""
    d = post.join(position, "bin_id").withColumn("t", F.col("t_idx") * dt)
    p, t, s = F.col("p"), F.col("t"), F.col("s")
    m = d.agg(F.sum(p).alias("w"), F.sum(p * t).alias("t"), F.sum(p * s).alias("s"), F.sum(p * t * t).alias("tt"), F.sum(p * t * s).alias("ts"), F.sum(p * s * s).alias("ss"))
    cov, vt, vs = F.col("ts") - t * s / F.col("w"), F.col("tt") - t * t / F.col("w"), F.col("ss") - s * s / F.col("w")
    slope = F.try_divide(cov, vt)
    return m.select(slope.alias("slope"), ((s - slope * t) / F.col("w")).alias("intercept"), F.try_divide(cov * cov, vt * vs).alias("r2"))


def pairwise_correlations(counts: DataFrame) -> DataFrame:
    """(unit_a, unit_b, r) of the counts of all pairs of units; 0 where one is constant.

    From products over the bins where both fired, and sums of each unit: silent bins make
    no rows.
    """
    n = counts.select("t_idx").distinct().agg(F.count("*").alias("t"))
    sums = counts.groupBy("unit").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    fired = counts.where("n > 0")
    of = lambda x: fired.select("t_idx", F.col("unit").alias(f"unit_{x}"), F.col("n").alias(f"n_{x}"))
    both = of("a").join(of("b"), "t_idx").where("unit_a < unit_b").groupBy("unit_a", "unit_b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("ab"))
    unit = lambda x: sums.select(F.col("unit").alias(f"unit_{x}"), F.col("s").alias(f"s_{x}"), F.col("q").alias(f"q_{x}"))
    pairs = unit("a").join(unit("b"), F.col("unit_a") < F.col("unit_b")).join(both, ["unit_a", "unit_b"], "left").crossJoin(F.broadcast(n))
    cov = F.coalesce("ab", F.lit(0)) - F.col("s_a") * F.col("s_b") / F.col("t")
    var = lambda x: F.col(f"q_{x}") - F.col(f"s_{x}") * F.col(f"s_{x}") / F.col("t")
    r = F.coalesce(F.try_divide(cov, F.sqrt(var("a") * var("b"))), F.lit(0.0))
    return pairs.select("unit_a", "unit_b", r.alias("r"))


def marchenko_pastur(n_units: int, n_bins: int) -> float:
    """Largest eigenvalue that correlations of independent counts reach."""
    return (1 + math.sqrt(n_units / n_bins)) ** 2


def assemblies(correlations: DataFrame, n_bins: int) -> tuple[list, list[tuple[float, list[float]]]]:
    """(units, [(eigenvalue, weights)]) above the Marchenko-Pastur bound, largest first.

    ``correlations`` (unit_a, unit_b, r) has a row for each pair; its size is that of the
    population and not of the recording.
    """
    import numpy as np

    rows = correlations.collect()
    units = sorted({r[k] for r in rows for k in ("unit_a", "unit_b")})
    at = {u: i for i, u in enumerate(units)}
    m = np.eye(len(units))
    for r in rows:
        m[at[r["unit_a"]], at[r["unit_b"]]] = m[at[r["unit_b"]], at[r["unit_a"]]] = r["r"]
    values, vectors = np.linalg.eigh(m)
    top = marchenko_pastur(len(units), n_bins)
    return units, [(float(v), vectors[:, i].tolist()) for i, v in reversed(list(enumerate(values))) if v > top]


def assembly_activation(counts: DataFrame, weights: Sequence[tuple]) -> DataFrame:
    """(t_idx, activation): z-scored weighted sum of z-scored counts; weights are (unit, w)."""
    z = events.shift_z(counts, "n", ["unit"])
    spark = counts.sparkSession
    w = spark.createDataFrame(list(weights), f"unit {counts.schema['unit'].dataType.simpleString()}, w double")
    d = z.join(w, "unit").groupBy("t_idx").agg(F.sum(F.col("w") * F.col("z")).alias("a"))
    return events.shift_z(d, "a").select("t_idx", F.col("z").alias("activation"))


def explained_variance(template: DataFrame, match: DataFrame, control: DataFrame) -> DataFrame:
    """(ev, rev): partial correlation squared of pair correlations (unit_a, unit_b, r) in match with template, given control; and with match and control swapped."""
    keys = ["unit_a", "unit_b"]
    named = lambda d, c: d.select(*keys, F.col("r").alias(c))
    d = named(template, "t").join(named(match, "m"), keys).join(named(control, "c"), keys)
    r = d.agg(correlation(F.col("t"), F.col("m")).alias("tm"), correlation(F.col("t"), F.col("c")).alias("tc"), correlation(F.col("m"), F.col("c")).alias("mc"))
    part = lambda a, b: F.pow(F.try_divide(F.col(a) - F.col(b) * F.col("mc"), F.sqrt((1 - F.col(b) * F.col(b)) * (1 - F.col("mc") * F.col("mc")))), 2)
    return r.select(part("tm", "tc").alias("ev"), part("tc", "tm").alias("rev"))


def isotonic_fit(decoded: DataFrame, increasing: bool = True) -> DataFrame:
    """(t_idx, fitted, p): monotone fit of position (t_idx, s, p) over time, weighted by p, by pool-adjacent-violators of Spark ML."""
    from pyspark.ml.regression import IsotonicRegression

    d = decoded.select("t_idx", F.col("t_idx").cast("double").alias("features"), F.col("s").alias("label"), F.col("p").alias("weight"))
    model = IsotonicRegression(isotonic=increasing, weightCol="weight").fit(d)
    return model.transform(d).select("t_idx", F.col("prediction").alias("fitted"), F.col("weight").alias("p"))


def radon_line(post: DataFrame, n_bins: int, n_slopes: int, width: int = 1) -> DataFrame:
    """(slope, offset, score): the line of bins over time that holds most of a posterior (t_idx, bin_id, p).

    Each cell votes for the lines that pass within ``width`` of it; votes are summed by Spark.
    """
    slopes = F.explode(F.array(*[F.lit(-n_bins / 4 + k * (n_bins / 2) / max(1, n_slopes - 1)) for k in range(n_slopes)]))
    d = post.select("t_idx", "bin_id", "p", slopes.alias("slope"))
    offset = F.rint(F.col("bin_id") - F.col("slope") * F.col("t_idx")).cast("long")
    near = F.explode(F.sequence(F.lit(-width), F.lit(width)))
    votes = d.select("slope", "p", offset.alias("o"), near.alias("k")).groupBy("slope", (F.col("o") + F.col("k")).alias("offset")).agg(F.sum("p").alias("score"))
    return votes.orderBy(F.col("score").desc(), F.abs("slope"), "offset").limit(1)


def decoding_correlation(decoded: DataFrame, truth: DataFrame) -> DataFrame:
    """(r): weighted correlation of mean_x, mean_y with x, y of ``truth``, averaged over both; weights are peak probabilities.  Null where any is constant."""
    d = decoded.join(truth.select("t_idx", "x", "y"), "t_idx")
    w = F.col("peak")

    def part(a: str, b: str) -> dict:
        a_, b_ = F.col(a), F.col(b)
        return {"w": F.sum(w), "a": F.sum(w * a_), "b": F.sum(w * b_), "aa": F.sum(w * a_ * a_), "bb": F.sum(w * b_ * b_), "ab": F.sum(w * a_ * b_)}

    sums = d.agg(*[e.alias(f"{k}{i}") for i, (a, b) in enumerate((("mean_x", "x"), ("mean_y", "y"))) for k, e in part(a, b).items()])

    def left(i: int, a: str, b: str) -> Column:
        """What of a sum of products is not the product of means; 0 where it is all rounding."""
        whole = F.col(f"{a}{b}{i}")
        d = whole - F.try_divide(F.col(f"{a}{i}") * F.col(f"{b}{i}"), F.col(f"w{i}"))
        return F.when(F.abs(d) > CONSTANT * F.abs(whole), d).otherwise(0.0) if a == b else d

    one = lambda i: F.try_divide(left(i, "a", "b"), F.sqrt(F.greatest(F.lit(0.0), left(i, "a", "a") * left(i, "b", "b"))))
    return sums.select(((one(0) + one(1)) / 2).alias("r"))
