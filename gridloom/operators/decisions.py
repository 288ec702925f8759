"""Decisions between goals: how far from the boundary between their catchments, crossings, and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fields import distance_field


def goal_distances(edges: DataFrame, goals: dict[str, DataFrame]) -> DataFrame:
    """(bin_id, goal, nearest, margin) of the bins that links reach: the nearest goal by the shortest way, and how much farther the next is.

    ``goals`` are bins (bin_id) by name; of equally near goals the first by name counts.
    margin is 0 on the boundary between two goals' catchments, and null where only one goal
    can be reached.
    """
    if not goals:
        raise ValueError("a boundary needs goals")
    ways = [distance_field(edges, b.select("bin_id")).select("bin_id", F.lit(name).alias("goal"), "distance") for name, b in sorted(goals.items())]
    d = ways[0]
    for w in ways[1:]:
        d = d.union(w)
    # A row for each goal.
    m = d.groupBy("bin_id").agg(F.sort_array(F.collect_list(F.struct(F.round("distance", 9).alias("d"), "goal", "distance"))).alias("s"))
    return m.select("bin_id", F.col("s")[0]["goal"].alias("goal"), F.col("s")[0]["distance"].alias("nearest"), (F.try_element_at("s", F.lit(2))["distance"] - F.col("s")[0]["distance"]).alias("margin"))


def boundary_distances(placed: DataFrame, distances: DataFrame) -> DataFrame:
    """``placed`` (bin_id) with goal and margin of ``goal_distances``; null outside the bins."""
    return placed.join(distances.select("bin_id", "goal", "margin"), "bin_id", "left")


def decision_analysis(pre: DataFrame, near: DataFrame, crossings: DataFrame, variance: float = 0.5, slow: float = 10.0) -> DataFrame:
    """(session, variance, mean_speed, suggests_deliberation, n_crossings, mean_margin) of each session.

    From ``navigation.pre_decision``, samples with their ``boundary_distances`` and
    ``behavior.boundary_crossings``.  Headings that vary by more than ``variance`` at a mean
    speed below ``slow`` suggest deliberation; a session that makes no decision has null there.
    """
    margins = near.groupBy("session").agg(F.avg("margin").alias("mean_margin"))
    n = crossings.groupBy("session").agg(F.count("*").alias("n_crossings"))
    d = margins.join(n, "session", "left").join(pre.select("session", "variance", "mean_speed"), "session", "left")
    told = (F.col("variance") > variance) & (F.col("mean_speed") < slow)
    return d.select("session", "variance", "mean_speed", told.alias("suggests_deliberation"), F.coalesce("n_crossings", F.lit(0)).alias("n_crossings"), "mean_margin")


def path_verdicts(efficiency: DataFrame, bias: DataFrame, efficient: float = 0.8, directed: float = 0.3) -> DataFrame:
    """(session, efficiency, bias, is_efficient, is_goal_directed) of ``path_efficiency`` and ``goal_bias``; what is unknown is false."""
    d = efficiency.select("session", "efficiency").join(bias.select("session", "bias"), "session", "full")
    over = lambda c, least: F.coalesce(F.col(c) > least, F.lit(False))
    return d.select("session", "efficiency", "bias", over("efficiency", efficient).alias("is_efficient"), over("bias", directed).alias("is_goal_directed"))


def deliberation_summary(trials: DataFrame) -> DataFrame:
    """(n, n_deliberate, mean_sweep, std_sweep, share) over the trials of ``behavior.deliberation``."""
    return trials.agg(
        F.count("*").alias("n"), F.count_if("deliberate").alias("n_deliberate"), F.avg("sweep").alias("mean_sweep"), F.stddev_pop("sweep").alias("std_sweep"),
        F.avg(F.col("deliberate").cast("double")).alias("share"),
    )


def trial_ends(samples: DataFrame, trials: DataFrame, start_bin: int, goal_bins: dict[str, int], width: float) -> DataFrame:
    """``samples`` (session, t) with start_bin and goal_bin of the trial they fall in; -1 outside, and for a goal that was not reached.

    Trials (session, start_t, stop_t, outcome) don't overlap.  They are listed in all
    stretches of ``width`` seconds that they meet, so that the join is on those.
    """
    t = trials.select("session", "start_t", "stop_t", "outcome", F.explode(F.sequence(F.floor(F.col("start_t") / width), F.floor(F.col("stop_t") / width))).alias("_w"))
    ends = F.coalesce(*[F.when(F.col("outcome") == k, F.lit(v)) for k, v in sorted(goal_bins.items())], F.lit(-1))
    t = t.select("session", "_w", "start_t", "stop_t", F.lit(start_bin).alias("_start"), ends.alias("_goal"))
    s = samples.withColumn("_w", F.floor(F.col("t") / width))
    d = s.alias("s").join(t.alias("t"), (F.col("s.session") == F.col("t.session")) & (F.col("s._w") == F.col("t._w")) & (F.col("s.t") >= F.col("t.start_t")) & (F.col("s.t") < F.col("t.stop_t")), "left")
    return d.select("s.*", F.coalesce("_start", F.lit(-1)).alias("start_bin"), F.coalesce("_goal", F.lit(-1)).alias("goal_bin")).drop("_w")


def linear_bin_at(points: DataFrame, bins: DataFrame, cell: float) -> DataFrame:
    """``points`` (position along a track) with the bin of ``grid.track_bins`` that holds each; -1 beyond the ends.

    A bin holds its lower end; the last one holds its upper end as well.
    """
    half = F.col("length") / 2
    last = F.max("bin_id").over(Window.partitionBy(F.lit(1)))  # a row for each bin of a track
    b = bins.select("bin_id", (F.col("position") - half).alias("_a"), (F.col("position") + half).alias("_b"), (F.col("bin_id") == last).alias("_last"))
    b = b.withColumnRenamed("bin_id", "_bin").withColumn("_c", F.explode(F.sequence(F.floor(F.col("_a") / cell), F.floor(F.col("_b") / cell))))
    # Ends are sums of lengths: what is left of rounding belongs to the bin above.
    p = points.withColumn("_c", F.floor(F.col("position") / cell))
    inside = (F.col("position") >= F.col("_a") - 1e-9) & ((F.col("position") < F.col("_b") - 1e-9) | (F.col("_last") & (F.col("position") <= F.col("_b") + 1e-9)))
    d = p.alias("p").join(b.alias("b"), (F.col("p._c") == F.col("b._c")) & inside, "left")
    return d.select(*[F.col(f"p.`{c}`") for c in points.columns], F.coalesce("_bin", F.lit(-1)).alias("bin_id"))


def edge_attributes(bins: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, src, dst, distance, dx, dy, angle, weight) of each link once, src < dst: what leads along it, and the inverse of its length."""
    at = lambda k: bins.select(F.col("bin_id").alias(k), F.col("x").alias(f"{k}_x"), F.col("y").alias(f"{k}_y"))
    d = edges.where("src < dst").join(at("src"), "src").join(at("dst"), "dst")
    dx, dy = F.col("dst_x") - F.col("src_x"), F.col("dst_y") - F.col("src_y")
    # As many rows as the arena has links.
    number = (F.row_number().over(Window.orderBy("src", "dst")) - 1).cast("long")
    return d.select(number.alias("edge_id"), "src", "dst", "distance", dx.alias("dx"), dy.alias("dy"), F.atan2(dy, dx).alias("angle"), F.try_divide(F.lit(1.0), F.col("distance")).alias("weight"))


def differential_operator(bins: DataFrame, edges: DataFrame) -> DataFrame:
    """(bin_id, edge_id, v): the root of a link's length, negative at its first end; with its transpose it makes the graph's Laplacian."""
    e = edge_attributes(bins, edges)
    root = F.sqrt("distance")
    ends = F.explode(F.array(F.struct(F.col("src").alias("bin_id"), (-root).alias("v")), F.struct(F.col("dst").alias("bin_id"), root.alias("v"))))
    return e.select("edge_id", ends.alias("s")).select("s.bin_id", "edge_id", "s.v")


def farthest_points(bins: DataFrame, n: int) -> list[int]:
    """The ids of ``n`` bins spread out: the first bin, then each time the one farthest from all before, ties to the smaller id.

    The driver keeps the ids that it returns; distances are kept with the bins.
    """
    first = bins.orderBy("bin_id").select("bin_id", "x", "y").first()
    found, far = [], bins.select("bin_id", "x", "y", F.lit(float("inf")).alias("d"))
    while first is not None and len(found) < n:
        found.append(first.bin_id)
        dx, dy = F.col("x") - first.x, F.col("y") - first.y
        far = far.select("bin_id", "x", "y", F.least("d", F.sqrt(dx * dx + dy * dy)).alias("d"))
        best = far.agg(F.max_by(F.struct("bin_id", "x", "y", "d"), F.struct(F.round("d", 9), -F.col("bin_id"))).alias("m")).first().m
        first = best if best.d > 0 else None
    return found


def decoder_score(errors: DataFrame, how: str = "median") -> DataFrame:
    """(score, n, n_undecoded) of errors (t_idx, error): their median or mean, over the time bins that could be decoded."""
    if how not in ("median", "mean"):
        raise ValueError(f"a score is a median or a mean, not {how}")
    value = F.expr("percentile(error, 0.5)") if how == "median" else F.avg("error")
    return errors.agg(value.alias("score"), F.count("error").alias("n"), (F.count("*") - F.count("error")).alias("n_undecoded"))
