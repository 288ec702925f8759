"""Windowed counts and occupancy over streams of samples (session, ts, x, y) with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import Grid, bin_at


def binned_counts(samples: DataFrame, grid: Grid, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, bin_id, n): samples of each bin; windows close once ``late`` has passed."""
    d = bin_at(samples.withWatermark("ts", late), grid).where("bin_id >= 0")
    return d.groupBy(F.window("ts", window), "bin_id").agg(F.count("*").alias("n"))


def sessions(samples: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(session, start, stop, n): stretches of samples of a session without a longer ``gap``."""
    d = samples.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "session").agg(F.count("*").alias("n"))
    return d.select("session", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")
