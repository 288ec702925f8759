"""Operators over trajectories: samples (session, idx, t, x, y), ordered by (t, idx)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry
from . import timeseries as ts
from .grid import Grid, bin_at

KEYS = ("session",)
ORDER = ("t", "idx")


def intervals(samples: DataFrame, grid: Grid, max_gap: float | None = None, min_speed: float | None = None, span: float | None = None) -> DataFrame:
    """``samples`` with bin_id, next_*, dt, speed and valid of the interval that each one starts.

    Valid: not the last of its session, within the grid, no longer than ``max_gap`` and no
    slower than ``min_speed``.
    """
    d = ts.with_next(bin_at(samples, grid), KEYS, ORDER, ("t", "x", "y", "bin_id"), span)
    dt = F.col("next_t") - F.col("t")
    step = geometry.distance(F.col("x"), F.col("y"), F.col("next_x"), F.col("next_y"))
    d = d.withColumns({"dt": dt, "speed": F.when(dt > 0, step / dt).otherwise(0.0)})
    valid = F.col("dt").isNotNull() & (F.col("bin_id") >= 0)
    if max_gap is not None:
        valid = valid & (F.col("dt") <= max_gap)
    if min_speed is not None:
        valid = valid & (F.col("speed") >= min_speed)
    return d.withColumn("valid", F.coalesce(valid, F.lit(False)))


def fill_bins(grid: Grid, sums: DataFrame, columns: Sequence[str], by: str = "bin_id") -> DataFrame:
    """A row for every active bin; 0 in ``columns`` where ``sums`` has none."""
    filled = grid.bins.select("bin_id").join(sums, by, "left")
    return filled.select("bin_id", *[F.coalesce(F.col(c), F.lit(0).cast(sums.schema[c].dataType)).alias(c) for c in columns])


def occupancy(samples: DataFrame, grid: Grid, max_gap: float | None = None, min_speed: float | None = None, span: float | None = None) -> DataFrame:
    """(bin_id, seconds, n): time and valid intervals of every active bin; an interval counts at its start."""
    d = intervals(samples, grid, max_gap, min_speed, span).where("valid")
    return fill_bins(grid, d.groupBy("bin_id").agg(F.sum("dt").alias("seconds"), F.count("*").alias("n")), ("seconds", "n"))


def occupancy_linear(samples: DataFrame, grid: Grid, max_gap: float | None = None, span: float | None = None) -> DataFrame:
    """(bin_id, seconds) with each interval's time shared along its straight line.

    The line is cut where it crosses grid lines; each piece counts for the bin of its middle.
    """
    d = intervals(samples, grid, max_gap, None, span).where("valid")

    def crossings(a: str, b: str, lo: float, width: float) -> Column:
        """Shares of the way from a to b at which it meets grid lines."""
        first, last = F.ceil((F.least(a, b) - lo) / width), F.floor((F.greatest(a, b) - lo) / width)
        lines = F.when((last >= first) & (F.col(a) != F.col(b)), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(lines, lambda k: (lo + k * width - F.col(a)) / (F.col(b) - F.col(a)))

    cuts = F.concat(F.array(F.lit(0.0), F.lit(1.0)), crossings("x", "next_x", grid.lo[0], grid.width[0]), crossings("y", "next_y", grid.lo[1], grid.width[1]))
    d = d.withColumn("cuts", F.array_sort(F.array_distinct(cuts)))
    pieces = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda k: F.struct(F.get("cuts", k - 1).alias("a"), F.get("cuts", k).alias("b")))
    d = d.select("dt", "x", "y", "next_x", "next_y", F.explode(pieces).alias("p"))
    middle = (F.col("p.a") + F.col("p.b")) / 2
    d = d.select(
        (F.col("dt") * (F.col("p.b") - F.col("p.a"))).alias("seconds"),
        (F.col("x") + middle * (F.col("next_x") - F.col("x"))).alias("x"),
        (F.col("y") + middle * (F.col("next_y") - F.col("y"))).alias("y"),
    )
    d = bin_at(d, grid).where("bin_id >= 0")
    return fill_bins(grid, d.groupBy("bin_id").agg(F.sum("seconds").alias("seconds")), ("seconds",))


def bin_sequence(samples: DataFrame, grid: Grid, dedup: bool = True, outside: bool = True, span: float | None = None) -> DataFrame:
    """``samples`` with bin_id in order; without repeats of the bin before, and without -1 if not ``outside``."""
    d = bin_at(samples, grid)
    d = d if outside else d.where("bin_id >= 0")
    if dedup:
        d = ts.with_previous(d, KEYS, ORDER, ("bin_id",), span).where("prev_bin_id is null or prev_bin_id <> bin_id").drop("prev_bin_id")
    return d


def bin_runs(samples: DataFrame, grid: Grid, span: float | None = None) -> DataFrame:
    """(session, run, bin_id, start_t, stop_t, n) of stretches of samples in one bin."""
    d = ts.with_previous(bin_at(samples, grid), KEYS, ORDER, ("bin_id",), span)
    change = (F.col("prev_bin_id").isNull() | (F.col("prev_bin_id") != F.col("bin_id"))).cast("long")
    d = ts.running_sum(d, KEYS, ORDER, change, "run", span)
    return d.groupBy("session", "run", "bin_id").agg(F.min("t").alias("start_t"), F.max("t").alias("stop_t"), F.count("*").alias("n"))


def transitions(samples: DataFrame, grid: Grid, lag: int = 1, teleports: bool = True, span: float | None = None) -> DataFrame:
    """(src, dst, n, p): moves between bins ``lag`` samples apart; without ``teleports`` only along links or staying."""
    d = bin_at(samples, grid).select("session", "idx", "t", "bin_id").withColumn("dst", F.col("bin_id"))
    for _ in range(lag):
        d = ts.with_next(d, KEYS, ORDER, ("dst",), span).drop("dst").withColumnRenamed("next_dst", "dst")
    moves = d.where("bin_id >= 0 and dst >= 0").groupBy(F.col("bin_id").alias("src"), "dst").agg(F.count("*").alias("n"))
    if not teleports:
        allowed = grid.edges.select("src", "dst").union(grid.bins.select("bin_id", "bin_id"))
        moves = moves.join(allowed, ["src", "dst"], "left_semi")
    return moves.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("src")))


def random_walk(grid: Grid) -> DataFrame:
    """(src, dst, p) of a walk that takes each link of a bin equally often."""
    return grid.edges.select("src", "dst", (1.0 / F.count("*").over(Window.partitionBy("src"))).alias("p"))


def steps(samples: DataFrame, span: float | None = None) -> DataFrame:
    """``samples`` with the step to the next one: dt, length, speed (0 where no time passes) and heading."""
    d = ts.with_next(samples, KEYS, ORDER, ("t", "x", "y"), span)
    length = geometry.distance(F.col("x"), F.col("y"), F.col("next_x"), F.col("next_y"))
    dt = F.col("next_t") - F.col("t")
    return d.withColumns(
        {"dt": dt, "length": length, "speed": F.when(dt > 0, length / dt).when(dt.isNotNull(), 0.0), "heading": F.atan2(F.col("next_y") - F.col("y"), F.col("next_x") - F.col("x"))}
    )


def turn_angles(samples: DataFrame, span: float | None = None) -> DataFrame:
    """(session, idx, t, turn): signed angle between the steps into and out of a sample; standing samples are left out."""
    d = ts.with_previous(samples, KEYS, ORDER, ("x", "y"), span)
    d = d.where("prev_x is null or prev_x <> x or prev_y <> y").select(*samples.columns)
    d = ts.with_next(ts.with_previous(d, KEYS, ORDER, ("x", "y"), span), KEYS, ORDER, ("x", "y"), span)
    turn = geometry.turn_angle(F.col("x") - F.col("prev_x"), F.col("y") - F.col("prev_y"), F.col("next_x") - F.col("x"), F.col("next_y") - F.col("y"))
    return d.where("prev_x is not null and next_x is not null").select("session", "idx", "t", turn.alias("turn"))


def home_range(occupied: DataFrame, share: float = 0.95) -> DataFrame:
    """The fewest bins of ``occupied`` (bin_id, seconds) that hold ``share`` of all time; the window runs over bins."""
    order = Window.orderBy(F.col("seconds").desc(), "bin_id")
    before = F.coalesce(F.sum("seconds").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("seconds").over(Window.partitionBy(F.lit(1)))
    return occupied.withColumns({"_b": before, "_t": total}).where((F.col("_b") < share * F.col("_t")) & (F.col("seconds") > 0)).select("bin_id", "seconds")


def mean_square_displacement(samples: DataFrame, lags: int, span: float | None = None) -> DataFrame:
    """(lag, msd, n): mean square distance of samples ``lag`` rows apart, for 1 to ``lags``."""
    numbered = ts.running_sum(samples.select(*KEYS, *ORDER, "x", "y"), KEYS, ORDER, F.lit(1), "_n", span)
    # Every row meets those up to ``lags`` later by number, in one join.
    early = numbered.select(*KEYS, F.col("x").alias("px"), F.col("y").alias("py"), F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"), "_n")
    late = numbered.select(*KEYS, "x", "y", F.col("_n").alias("_m"))
    d = early.withColumn("_m", F.col("_n") + F.col("lag")).join(late, [*KEYS, "_m"]).where("x is not null")
    square = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
    found = d.groupBy("lag").agg(F.avg(square).alias("msd"), F.count("*").alias("n"))
    frame = samples.sparkSession.range(1, lags + 1).select(F.col("id").cast("int").alias("lag"))
    return frame.join(found, "lag", "left").select("lag", "msd", F.coalesce("n", F.lit(0)).alias("n"))


def region_crossings(samples: DataFrame, inside: Column, span: float | None = None) -> DataFrame:
    """(session, idx, t, direction): samples that enter or leave where ``inside`` holds; a first sample never enters."""
    d = ts.with_previous(samples.withColumn("inside", inside), KEYS, ORDER, ("inside",), span)
    d = d.where(F.col("prev_inside").isNotNull() & (F.col("inside") != F.col("prev_inside")))
    return d.select("session", "idx", "t", F.when(F.col("inside"), "entry").otherwise("exit").alias("direction"))


def slow_fast_segments(samples: DataFrame, low: float, high: float, span: float | None = None) -> DataFrame:
    """(session, segment, moving, start_t, stop_t, n) by speed with hysteresis: moving from ``high`` on, still below ``low``."""
    d = steps(samples, span).where("speed is not null")
    told = F.when(F.col("speed") >= high, 1).when(F.col("speed") < low, 0)
    seen = d.where(told.isNotNull()).withColumn("state", told).select("session", "t", "state")
    d = ts.asof(d, seen, KEYS, "t", ("state",), "", span=span).withColumn("moving", F.coalesce("state", F.lit(0)))
    d = ts.with_previous(d.select("session", "idx", "t", "moving"), KEYS, ORDER, ("moving",), span)
    change = (F.col("prev_moving").isNull() | (F.col("prev_moving") != F.col("moving"))).cast("long")
    d = ts.running_sum(d, KEYS, ORDER, change, "segment", span)
    return d.groupBy("session", "segment", "moving").agg(F.min("t").alias("start_t"), F.max("t").alias("stop_t"), F.count("*").alias("n"))
