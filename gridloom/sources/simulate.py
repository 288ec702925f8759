"""Simulated trajectories, cells and spikes: closed-form rates and seeded draws over ``spark.range``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators.stats import uniform


def laps(spark: SparkSession, n_samples: int, dt: float, length: float, speed: float) -> DataFrame:
    """Samples to and fro along a straight track."""
    way = F.pmod(F.col("id") * (dt * speed), F.lit(2 * length))
    x = F.when(way <= length, way).otherwise(2 * length - way)
    return spark.range(n_samples).select(F.lit(0).alias("session"), F.col("id").alias("idx"), (F.col("id") * dt).alias("t"), x.alias("x"), F.lit(0.0).alias("y"))


def foraging(spark: SparkSession, n_samples: int, dt: float, size: float, seed: int = 0, waves: int = 7) -> DataFrame:
    """Samples of a smooth path through a square: sums of sines of seeded phases, so rows need no order to be made."""
    rows = spark.range(n_samples)
    t = F.col("id") * dt

    def axis(k: int) -> Column:
        total = F.lit(0.0)
        for w in range(1, waves + 1):
            phase = 2 * math.pi * ((w * 0.754877666 + k * 0.569840291 + seed * 0.3819660113) % 1.0)
            total = total + F.sin(t * (0.11 * w + 0.037 * k) + phase) / w
        return size * (0.5 + total / (2 * sum(1 / w for w in range(1, waves + 1))))

    return rows.select(F.lit(0).alias("session"), F.col("id").alias("idx"), t.alias("t"), axis(0).alias("x"), axis(1).alias("y"))


def place_rate(x: Column, y: Column, center: tuple[float, float], width: float, peak: float, base: float = 0.0) -> Column:
    d2 = (x - center[0]) * (x - center[0]) + (y - center[1]) * (y - center[1])
    return base + peak * F.exp(-d2 / (2 * width * width))


def grid_rate(x: Column, y: Column, spacing: float, peak: float, phase: tuple[float, float] = (0.0, 0.0), angle: float = 0.0) -> Column:
    """Three plane waves at 60 degrees, from 0 to ``peak``."""
    k = 4 * math.pi / (math.sqrt(3) * spacing)
    waves = sum(F.cos(k * ((x - phase[0]) * math.cos(angle + a) + (y - phase[1]) * math.sin(angle + a))) for a in (0, math.pi / 3, 2 * math.pi / 3))
    return peak * (waves + 1.5) / 4.5


def direction_rate(heading: Column, preferred: float, concentration: float, peak: float) -> Column:
    return peak * F.exp(concentration * (F.cos(heading - preferred) - 1))


def boundary_rate(distance: Column, bearing: Column, preferred_distance: float, preferred_bearing: float, width: float, concentration: float, peak: float) -> Column:
    near = F.exp(-(distance - preferred_distance) * (distance - preferred_distance) / (2 * width * width))
    return peak * near * F.exp(concentration * (F.cos(bearing - preferred_bearing) - 1))


def object_rate(x: Column, y: Column, heading: Column, at: tuple[float, float], preferred_distance: float, preferred_bearing: float, width: float, concentration: float, peak: float) -> Column:
    d = geometry.distance(x, y, F.lit(at[0]), F.lit(at[1]))
    return boundary_rate(d, geometry.bearing(x, y, heading, F.lit(at[0]), F.lit(at[1])), preferred_distance, preferred_bearing, width, concentration, peak)


def spikes(samples: DataFrame, units: dict[int, Column], dt: float, seed: int = 0) -> DataFrame:
    """(session, unit, t): at most one spike a sample and unit, with probability 1 - exp(-rate * dt)."""
    rates = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), r.alias("rate")) for u, r in units.items()]))
    d = samples.select("session", "idx", "t", rates.alias("r")).select("session", "idx", "t", "r.unit", "r.rate")
    return d.where(uniform(F.col("session"), F.col("idx"), F.col("unit"), seed=seed) < 1 - F.exp(-F.col("rate") * dt)).select("session", "unit", "t")


def modulated(train: DataFrame, frequency: float, depth: float, phase: float = 0.0, seed: int = 0) -> DataFrame:
    """``train`` thinned by a rhythm."""
    keep = (1 + depth * F.cos(2 * math.pi * frequency * F.col("t") - phase)) / (1 + depth)
    return train.where(uniform(F.col("session"), F.col("unit"), F.col("t"), seed=seed) < keep)
