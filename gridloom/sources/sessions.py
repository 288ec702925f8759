"""Whole simulated recordings: a path, an environment and cells of a kind.  The same in every run."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import regular_grid
from ..operators.session import Recording
from ..operators.trajectory import steps
from . import simulate


def spread_centers(n: int, size: float) -> list[tuple[float, float]]:
    """``n`` places that cover a square evenly, for any n."""
    return [(size * ((0.5 + k * 0.7548776662466927) % 1.0), size * ((0.5 + k * 0.5698402909980532) % 1.0)) for k in range(n)]


def _square(spark: SparkSession, samples: DataFrame, size: float, bin_size: float, units: dict, dt: float, seed: int) -> Recording:
    n = max(1, math.ceil(size / bin_size))
    grid = regular_grid(spark, (0.0, 0.0), (bin_size, bin_size), (n, n))
    return Recording(grid, samples, simulate.spikes(samples, units, dt, seed))


def open_field(spark: SparkSession, duration: float = 180.0, size: float = 100.0, bin_size: float = 5.0, n_cells: int = 20, dt: float = 0.02, seed: int = 0) -> Recording:
    """Place cells over a square arena."""
    d = simulate.foraging(spark, int(duration / dt), dt, size, seed)
    units = {k: simulate.place_rate(F.col("x"), F.col("y"), c, size / 10, 20.0) for k, c in enumerate(spread_centers(n_cells, size))}
    return _square(spark, d, size, bin_size, units, dt, seed)


def linear_track(spark: SparkSession, duration: float = 240.0, length: float = 200.0, bin_size: float = 4.0, n_cells: int = 15, n_laps: int = 20, dt: float = 0.02, seed: int = 0) -> Recording:
    """Place cells along a straight track that is run to and fro."""
    d = simulate.laps(spark, int(duration / dt), dt, length, n_laps * length / duration)
    units = {k: simulate.place_rate(F.col("x"), F.col("y"), ((k + 0.5) * length / n_cells, 0.0), length / 20, 20.0) for k in range(n_cells)}
    grid = regular_grid(spark, (0.0, -bin_size / 2), (bin_size, bin_size), (math.ceil(length / bin_size) + 1, 1))
    return Recording(grid, d, simulate.spikes(d, units, dt, seed))


def t_alternation(spark: SparkSession, n_trials: int = 20, stem: float = 100.0, arm: float = 50.0, speed: float = 20.0, bin_size: float = 4.0, n_cells: int = 25, dt: float = 0.02, seed: int = 0) -> Recording:
    """Runs up the stem of a T and into its arms in turn; place cells along all of it."""
    trial = stem + arm
    way = F.col("id") * (dt * speed)
    k = F.floor(way / trial)
    along = way - k * trial
    side = F.when(k % 2 == 0, -1.0).otherwise(1.0)
    rows = spark.range(int(n_trials * trial / speed / dt))
    x = F.when(along > stem, side * (along - stem)).otherwise(0.0)
    d = rows.select(F.lit(0).alias("session"), F.col("id").alias("idx"), (F.col("id") * dt).alias("t"), x.alias("x"), F.least(along, F.lit(stem)).alias("y"), k.alias("trial"))
    places = [(0.0, stem * (i + 0.5) / (n_cells - n_cells // 2)) for i in range(n_cells - n_cells // 2)]
    places += [((-1) ** i * arm * (i // 2 + 0.5) / max(1, n_cells // 4), stem) for i in range(n_cells // 2)]
    units = {i: simulate.place_rate(F.col("x"), F.col("y"), c, 8.0, 20.0) for i, c in enumerate(places)}
    grid = regular_grid(spark, (-arm - bin_size / 2, -bin_size / 2), (bin_size, bin_size), (math.ceil(2 * arm / bin_size) + 1, math.ceil(stem / bin_size) + 1))
    return Recording(grid, d, simulate.spikes(d, units, dt, seed))


def boundary_cells(spark: SparkSession, duration: float = 180.0, size: float = 100.0, bin_size: float = 5.0, n_boundary: int = 8, n_place: int = 10, dt: float = 0.02, seed: int = 0) -> Recording:
    """Boundary cells of the four walls in turn, and place cells after them."""
    d = simulate.foraging(spark, int(duration / dt), dt, size, seed)
    x, y = F.col("x"), F.col("y")
    walls = [(x, math.pi), (size - x, 0.0), (y, -math.pi / 2), (size - y, math.pi / 2)]
    units = {k: simulate.boundary_rate(walls[k % 4][0], F.lit(walls[k % 4][1]), 5.0 + 3.0 * (k // 4), walls[k % 4][1], 5.0, 2.0, 20.0) for k in range(n_boundary)}
    units |= {n_boundary + k: simulate.place_rate(x, y, c, size / 10, 20.0) for k, c in enumerate(spread_centers(n_place, size))}
    return _square(spark, d, size, bin_size, units, dt, seed)


def grid_cells(spark: SparkSession, duration: float = 300.0, size: float = 150.0, bin_size: float = 5.0, spacing: float = 50.0, n_cells: int = 40, dt: float = 0.02, seed: int = 0) -> Recording:
    """Grid cells of one spacing at phases spread over it."""
    d = simulate.foraging(spark, int(duration / dt), dt, size, seed)
    units = {k: simulate.grid_rate(F.col("x"), F.col("y"), spacing, 20.0, c) for k, c in enumerate(spread_centers(n_cells, spacing))}
    return _square(spark, d, size, bin_size, units, dt, seed)


def direction_cells(spark: SparkSession, duration: float = 180.0, size: float = 100.0, bin_size: float = 5.0, n_cells: int = 12, concentration: float = 3.0, dt: float = 0.02, seed: int = 0) -> Recording:
    """Cells that fire for one heading of the path each."""
    d = steps(simulate.foraging(spark, int(duration / dt), dt, size, seed)).where("dt is not null").select("session", "idx", "t", "x", "y", "heading")
    units = {k: simulate.direction_rate(F.col("heading"), 2 * math.pi * k / n_cells, concentration, 20.0) for k in range(n_cells)}
    return _square(spark, d, size, bin_size, units, dt, seed)


def mean_vector_length(concentration: float) -> float:
    """Of a direction cell's tuning: the ratio of the modified Bessel functions of orders 1 and 0, by their series."""
    series = lambda n: sum((concentration / 2) ** (2 * k + n) / (math.factorial(k) * math.factorial(k + n)) for k in range(80))
    return series(1) / series(0)
