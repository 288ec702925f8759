"""Queries on rhythms of event counts: band-passed signals, their phase, and events' phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import phase
from .catalog import START, STOP, named, samples

#: Seconds of a sample, and the band in cycles a day.
STEP, LOW, HIGH = 1800.0, 0.7, 1.5
PER_DAY = 86_400.0 / STEP


def _at() -> Column:
    return F.floor((F.col("t") - START) / STEP)


def _within(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).where((F.col("t") >= START) & (F.col("t") < STOP))
    return s.withColumn("channel", F.pmod("session", F.lit(4)))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, n, v): events of each channel in every half hour."""
    found = _within(spark, sf_dir).groupBy("channel", _at().alias("n")).agg(F.count("*").cast("double").alias("v"))
    frame = spark.range(4).select(F.col("id").alias("channel")).join(spark.range(int((STOP - START) / STEP)).select(F.col("id").alias("n")))
    return frame.join(found, ["channel", "n"], "left").select("channel", "n", F.coalesce("v", F.lit(0.0)).alias("v"))


def _phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phase.analytic_phase(phase.band_pass(counts(spark, sf_dir), LOW, HIGH, PER_DAY), LOW, PER_DAY)


@named(None, "v phase amplitude")
def band_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily rhythm of every channel's counts, with its phase."""
    return _phases(spark, sf_dir)


@named(None, "direction length")
def phase_locking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At which phase of the daily rhythm of its channel each kind of event falls."""
    return phase.phase_locking(_phases(spark, sf_dir), _within(spark, sf_dir), _at(), by=("channel", "event_type"))
