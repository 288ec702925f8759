"""Operators on behaviour: goals, paths, decisions, trials and head sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import angles, geometry
from . import timeseries as ts
from .events import shift_z
from .trajectory import KEYS, ORDER, steps


def goal_alignment(samples: DataFrame, goal: tuple[float, float], min_speed: float = 0.0, span: float | None = None) -> DataFrame:
    """(session, idx, t, alignment): cosine between each step and the way to the goal; null when slower than ``min_speed``."""
    d = steps(samples, span).where("dt is not null")
    way = F.atan2(goal[1] - F.col("y"), goal[0] - F.col("x"))
    return d.select("session", "idx", "t", F.when(F.col("speed") >= min_speed, F.cos(F.col("heading") - way)).alias("alignment"))


def goal_bias(samples: DataFrame, goal: tuple[float, float], min_speed: float = 0.0, span: float | None = None) -> DataFrame:
    """(session, bias): mean alignment."""
    return goal_alignment(samples, goal, min_speed, span).groupBy("session").agg(F.avg("alignment").alias("bias"))


def approach_rate(samples: DataFrame, goal: tuple[float, float], span: float | None = None) -> DataFrame:
    """(session, idx, t, rate): change of the distance to the goal since the sample before, by time; null for the first."""
    d = samples.withColumn("d", geometry.distance(F.col("x"), F.col("y"), F.lit(goal[0]), F.lit(goal[1])))
    d = ts.with_previous(d, KEYS, ORDER, ("t", "d"), span)
    return d.select("session", "idx", "t", F.try_divide(F.col("d") - F.col("prev_d"), F.col("t") - F.col("prev_t")).alias("rate"))


def path_efficiency(samples: DataFrame, span: float | None = None) -> DataFrame:
    """(session, traveled, straight, efficiency, duration) from the first to the last sample of each session."""
    d = steps(samples, span)
    first, last = F.min_by(F.struct("x", "y"), F.struct("t", "idx")), F.max_by(F.struct("x", "y"), F.struct("t", "idx"))
    d = d.groupBy("session").agg(F.coalesce(F.sum("length"), F.lit(0.0)).alias("traveled"), first.alias("a"), last.alias("b"), (F.max("t") - F.min("t")).alias("duration"))
    straight = geometry.distance(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
    return d.select("session", "traveled", straight.alias("straight"), F.try_divide(straight, F.col("traveled")).alias("efficiency"), "duration")


def heading_labels(samples: DataFrame, n: int, min_speed: float, span: float | None = None) -> DataFrame:
    """(session, idx, t, label): which of ``n`` equal sectors a step heads to, or -1 when slower than ``min_speed``."""
    d = steps(samples, span).where("dt is not null")
    sector = F.floor(F.pmod(F.col("heading"), F.lit(2 * 3.141592653589793)) / (2 * 3.141592653589793 / n))
    return d.select("session", "idx", "t", F.when(F.col("speed") >= min_speed, F.least(sector, F.lit(n - 1))).otherwise(-1).cast("long").alias("label"))


def decision_window(samples: DataFrame, inside: Column, duration: float, span: float | None = None) -> DataFrame:
    """Samples in the ``duration`` before each session first enters where ``inside`` holds; the entry is left out."""
    d = ts.with_previous(samples.withColumn("_in", inside), KEYS, ORDER, ("_in",), span)
    entries = d.where("_in and not prev__in").groupBy("session").agg(F.min("t").alias("entry_t"))
    return samples.join(entries, "session").where((F.col("t") >= F.col("entry_t") - duration) & (F.col("t") < F.col("entry_t")))


def head_sweep(headings: DataFrame, by: str = "session", span: float | None = None) -> DataFrame:
    """(by, sweep): total turning of heading (by, idx, t, heading)."""
    d = ts.with_previous(headings.where("heading is not null"), (by,), ("t", "idx"), ("heading",), span)
    turn = F.abs(angles.wrap(F.col("heading") - F.col("prev_heading")))
    return d.groupBy(by).agg(F.coalesce(F.sum(turn), F.lit(0.0)).alias("sweep"))


def deliberation(trials: DataFrame, alpha: float = 0.5, threshold: float = 0.5) -> DataFrame:
    """Trials (trial, sweep, speed) with z_sweep, z_slow, index and deliberate: more sweeping and slower than the others."""
    d = shift_z(trials, "sweep").withColumnRenamed("z", "z_sweep")
    d = d.withColumn("slow", F.try_divide(F.lit(1.0), F.col("speed")))
    d = shift_z(d, "slow").withColumnRenamed("z", "z_slow")
    d = d.withColumn("index", alpha * F.col("z_sweep") + (1 - alpha) * F.coalesce("z_slow", F.lit(0.0)))
    return d.withColumn("deliberate", F.col("index") > threshold).drop("slow")


def boundary_crossings(samples: DataFrame, label: Column, span: float | None = None) -> DataFrame:
    """(session, t, from_label, to_label): changes of ``label`` between samples that have one, at the middle of their times."""
    d = ts.with_previous(samples.withColumn("label", label), KEYS, ORDER, ("label", "t"), span)
    d = d.where("label is not null and prev_label is not null and label <> prev_label")
    return d.select("session", ((F.col("t") + F.col("prev_t")) / 2).alias("t"), F.col("prev_label").alias("from_label"), F.col("label").alias("to_label"))


def nearest_goal(bins: DataFrame, goals: list[tuple[float, float]]) -> DataFrame:
    """(bin_id, goal, margin): the nearest of a few goals, and how much farther the next one is."""
    d = F.array_sort(F.array(*[F.struct(geometry.distance(F.col("x"), F.col("y"), F.lit(a), F.lit(b)).alias("r"), F.lit(k).alias("k")) for k, (a, b) in enumerate(goals)]))
    return bins.select("bin_id", d.alias("d")).select("bin_id", F.col("d")[0]["k"].alias("goal"), (F.col("d")[1]["r"] - F.col("d")[0]["r"]).alias("margin"))


def laps(samples: DataFrame, inside: Column, span: float | None = None) -> DataFrame:
    """(session, start_t, stop_t): from each entry to the region to the next one."""
    d = ts.with_previous(samples.withColumn("_in", inside), KEYS, ORDER, ("_in",), span).where("_in and not prev__in")
    d = ts.with_next(d.select("session", "idx", "t"), KEYS, ORDER, ("t",), span)
    return d.where("next_t is not null").select("session", F.col("t").alias("start_t"), F.col("next_t").alias("stop_t"))


def runs_between(samples: DataFrame, source: Column, target: Column, max_duration: float, span: float | None = None) -> DataFrame:
    """(session, start_t, stop_t, success): from each exit of source to the next entry of target, or to ``max_duration``."""
    d = ts.with_previous(samples.withColumns({"_s": source, "_t": target}), KEYS, ORDER, ("_s", "_t"), span)
    starts = d.where("prev__s and not _s").select("session", "t")
    stops = d.where("_t and not prev__t").select("session", "t", F.col("t").alias("stop_t"))
    d = ts.asof(starts, stops, KEYS, "t", ("stop_t",), "", backward=False, span=span)
    success = F.coalesce(F.col("stop_t") <= F.col("t") + max_duration, F.lit(False))
    return d.select("session", F.col("t").alias("start_t"), F.when(success, F.col("stop_t")).otherwise(F.col("t") + max_duration).alias("stop_t"), success.alias("success"))


def trials(samples: DataFrame, start: Column, ends: dict[str, Column], min_duration: float, max_duration: float, span: float | None = None) -> DataFrame:
    """(session, trial, start_t, stop_t, outcome): a trial from each time that the start region is left.

    It ends in the first end region that is entered from ``min_duration`` on; it is aborted
    when the start region is entered again before that, and times out after ``max_duration``
    if samples go on.  A trial whose end is not known gives no row.  Since a trial is over
    when the next one begins, each is told by as-of joins alone.
    """
    which = F.when(start, F.lit("start"))
    for name, inside in ends.items():
        which = which.when(inside, F.lit(name))
    d = samples.select("session", "idx", "t", which.otherwise(F.lit("")).alias("region"))
    d = ts.with_previous(d, KEYS, ORDER, ("region",), span).where("prev_region is null or prev_region <> region")
    visits = d.select("session", "t", "region")
    begun = d.where("prev_region = 'start'").select("session", "t", F.col("t").alias("start_t"))
    back = visits.where("region = 'start'").select("session", "t", F.col("t").alias("back_t"))
    ended = visits.where(F.col("region").isin(*ends)).select("session", "t", F.col("t").alias("end_t"), F.col("region").alias("end_region"))
    known = ["session", "start_t", "back_t"]
    d = ts.asof(begun, back, KEYS, "t", ("back_t",), "", backward=False, strict=True, span=span)
    d = ts.asof(d.select(*known, (F.col("start_t") + min_duration).alias("t")), ended, KEYS, "t", ("end_t", "end_region"), "", backward=False, span=span)
    later = visits.select("session", "t", F.col("t").alias("later_t"))
    d = ts.asof(d.select(*known, "end_t", "end_region", (F.col("start_t") + max_duration).alias("t")), later, KEYS, "t", ("later_t",), "", backward=False, strict=True, span=span)
    latest = F.col("start_t") + max_duration
    arrived = (F.col("end_t") - F.col("start_t") <= max_duration) & (F.col("back_t").isNull() | (F.col("end_t") < F.col("back_t")))
    end = F.when(arrived, F.struct(F.col("end_t").alias("t"), F.col("end_region").alias("o")))
    end = end.when(F.col("back_t") - F.col("start_t") <= max_duration, F.struct(F.col("back_t").alias("t"), F.lit("aborted").alias("o")))
    end = end.when(F.col("later_t").isNotNull(), F.struct(latest.alias("t"), F.lit("timeout").alias("o")))
    d = d.withColumn("_end", end).where("_end is not null").select("session", "start_t", F.col("_end.t").alias("stop_t"), F.col("_end.o").alias("outcome"))
    d = ts.running_sum(d, KEYS, ("start_t",), F.lit(1).cast("long"), "_n", span)
    return d.select("session", (F.col("_n") - 1).alias("trial"), "start_t", "stop_t", "outcome")


def path_progress(samples: DataFrame, from_start: Column, to_goal: Column) -> DataFrame:
    """``samples`` with progress from 0 at the start to 1 at the goal, by the two distances."""
    total = from_start + to_goal
    return samples.withColumn("progress", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(from_start, total))))


def trajectory_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(jaccard): bins visited by both of two sequences (bin_id), by those visited by either."""
    x, y = a.select("bin_id").distinct().withColumn("a", F.lit(1)), b.select("bin_id").distinct().withColumn("b", F.lit(1))
    d = x.join(y, "bin_id", "full")
    return d.agg(F.try_divide(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()), F.count("*")).alias("jaccard"))


def reward_field(bins: DataFrame, distance: DataFrame, scale: float, decay: str = "exponential", max_distance: float | None = None) -> DataFrame:
    """(bin_id, v): a reward that falls with ``distance`` (bin_id, distance): exponential, linear or inverse."""
    d = F.col("distance")
    v = {
        "exponential": scale * F.exp(-d / scale),
        "linear": scale * F.greatest(F.lit(0.0), 1 - d / (max_distance or 1.0)),
        "inverse": scale / (1 + d),
    }[decay]
    return bins.select("bin_id").join(distance, "bin_id", "left").select("bin_id", F.coalesce(v, F.lit(0.0)).alias("v"))


def dwell(samples: DataFrame, label: Column, max_gap: float, span: float | None = None) -> DataFrame:
    """(label, seconds, visits): time in each label and how often it is come to."""
    d = ts.with_next(ts.with_previous(samples.withColumn("label", label), KEYS, ORDER, ("label",), span), KEYS, ORDER, ("t",), span)
    gap = F.col("next_t") - F.col("t")
    new = F.col("prev_label").isNull() | (F.col("prev_label") != F.col("label"))
    return d.where("label is not null").groupBy("label").agg(F.coalesce(F.sum(F.when(gap <= max_gap, gap)), F.lit(0.0)).alias("seconds"), F.count_if(new).alias("visits"))


def curvature(samples: DataFrame, half: int, span: float | None = None) -> DataFrame:
    """(session, idx, t, curvature): mean turn angle over ``half`` samples to either side."""
    from .trajectory import turn_angles

    turns = turn_angles(samples, span).select("session", "idx", "t", "turn")
    return ts.moving_mean(turns, ("session",), ("t", "idx"), F.col("turn"), half, "curvature", span).drop("turn")
