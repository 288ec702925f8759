"""Operators over events and intervals: alignment, histograms, counts and interval algebra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.binning import closed_bin_index
from . import timeseries as ts


def align(events: DataFrame, references: DataFrame, window: tuple[float, float], keys: Sequence[str] = (), t: str = "t", reference_t: str = "t") -> DataFrame:
    """Each event with every reference whose ``window`` around it holds it, and relative_t; both ends count.

    Columns of ``references`` get the prefix ``ref_``, but for the keys.
    """
    rest = [c for c in references.columns if c not in keys]
    r = references.select(*keys, *[F.col(c).alias(f"ref_{c}") for c in rest])
    at = F.col(f"ref_{reference_t}")
    r = r.withColumns({"_from": at + window[0], "_to": at + window[1]})
    joined = ts.interval_join(events, r, t, "_from", "_to", max(window[1] - window[0], 1e-9), keys)
    return joined.withColumn("relative_t", F.col(t) - at).drop("_from", "_to")


def peri_event_counts(spikes: DataFrame, references: DataFrame, window: tuple[float, float], bin_size: float, keys: Sequence[str] = (), units: DataFrame | None = None) -> DataFrame:
    """(unit, ref_id, bin, n) for every unit, reference and bin; the last bin holds the window's end.

    ``spikes`` has unit and t, ``references`` ref_id and t; ``units`` lists units that may be silent.
    """
    n_bins = round((window[1] - window[0]) / bin_size)
    found = align(spikes, references.withColumnRenamed("ref_id", "id"), window, keys)
    found = found.withColumn("bin", closed_bin_index(F.col("relative_t"), window[0], bin_size, n_bins)).where("bin is not null")
    counts = found.groupBy("unit", F.col("ref_id"), "bin").agg(F.count("*").alias("n"))
    units = spikes.select("unit").distinct() if units is None else units
    # Every unit needs a row for every reference and bin; zeros have to be counted.
    frame = references.select("ref_id").crossJoin(F.broadcast(units)).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))))
    return frame.join(counts, ["unit", "ref_id", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def psth(spikes: DataFrame, references: DataFrame, window: tuple[float, float], bin_size: float, keys: Sequence[str] = ()) -> DataFrame:
    """(unit, bin, center, mean, sem, rate, n_events) over references; sem is null for one reference.

    Counts without spikes are not made into rows: means and squares come from the counts
    that are there and the number of references.
    """
    n_bins = round((window[1] - window[0]) / bin_size)
    found = align(spikes, references.withColumnRenamed("ref_id", "id"), window, keys)
    found = found.withColumn("bin", closed_bin_index(F.col("relative_t"), window[0], bin_size, n_bins)).where("bin is not null")
    counts = found.groupBy("unit", "ref_id", "bin").agg(F.count("*").alias("n"))
    sums = counts.groupBy("unit", "bin").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    frame = spikes.select("unit").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))))
    total = references.agg(F.count("*").alias("m"))
    d = frame.join(sums, ["unit", "bin"], "left").crossJoin(F.broadcast(total))
    s, q, m = F.coalesce("s", F.lit(0)), F.coalesce("q", F.lit(0)), F.col("m")
    sem = F.when(m > 1, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / m) / (m - 1)) / m))
    center = window[0] + (F.col("bin") + 0.5) * bin_size
    return d.select("unit", "bin", center.alias("center"), (s / m).alias("mean"), sem.alias("sem"), (s / m / bin_size).alias("rate"), m.alias("n_events"))


def filter_by_intervals(events: DataFrame, intervals: DataFrame, include: bool, width: float, keys: Sequence[str] = (), t: str = "t") -> DataFrame:
    """Events within any (start_t, stop_t), or within none; both ends count."""
    return ts.interval_join(events, intervals, t, "start_t", "stop_t", width, keys, "left_semi" if include else "left_anti")


def intervals_to_events(intervals: DataFrame) -> DataFrame:
    """A row for the start and one for the stop of each interval, with boundary."""
    both = F.array(F.struct(F.lit("start").alias("boundary"), F.col("start_t").alias("t")), F.struct(F.lit("stop").alias("boundary"), F.col("stop_t").alias("t")))
    rest = [c for c in intervals.columns if c not in ("start_t", "stop_t")]
    return intervals.select(*rest, F.explode(both).alias("e")).select(*rest, "e.boundary", "e.t")


def events_to_intervals(starts: DataFrame, stops: DataFrame, keys: Sequence[str], max_duration: float | None = None, span: float | None = None) -> DataFrame:
    """Each start with the first stop after it of the same keys: (keys, start_t, stop_t, duration)."""
    s = stops.select(*keys, F.col("t"), F.col("t").alias("stop_t"))
    d = ts.asof(starts.select(*keys, "t"), s, keys, "t", ("stop_t",), "", backward=False, strict=True, span=span)
    d = d.where("stop_t is not null").select(*keys, F.col("t").alias("start_t"), "stop_t", (F.col("stop_t") - F.col("t")).alias("duration"))
    return d if max_duration is None else d.where(F.col("duration") <= max_duration)


def time_to_nearest(samples: DataFrame, events: DataFrame, keys: Sequence[str] = (), signed: bool = True, span: float | None = None) -> DataFrame:
    """``samples`` with nearest_dt to the nearest event: above 0 after it, below 0 before; the earlier one at equal distance."""
    e = events.select(*keys, "t", F.col("t").alias("event_t"))
    d = ts.asof(samples, e, keys, "t", ("event_t",), "prev_", True, True, span)
    d = ts.asof(d, e, keys, "t", ("event_t",), "next_", False, False, span)
    after, before = F.col("t") - F.col("prev_event_t"), F.col("next_event_t") - F.col("t")
    near = F.when(before.isNull() | (after <= before), after).otherwise(-before)
    return d.withColumn("nearest_dt", near if signed else F.abs(near)).drop("prev_event_t", "next_event_t")


def counts_in_window(samples: DataFrame, events: DataFrame, window: tuple[float, float], sample_key: str, keys: Sequence[str] = ()) -> DataFrame:
    """(sample_key, n): events within ``window`` around each sample, both ends included."""
    s = samples.select(sample_key, *keys, (F.col("t") + window[0]).alias("_from"), (F.col("t") + window[1]).alias("_to"))
    found = ts.interval_join(events.select(*keys, "t"), s, "t", "_from", "_to", max(window[1] - window[0], 1e-9), keys)
    counts = found.groupBy(sample_key).agg(F.count("*").alias("n"))
    return samples.select(sample_key).join(counts, sample_key, "left").select(sample_key, F.coalesce("n", F.lit(0)).alias("n"))


def label_by_intervals(samples: DataFrame, intervals: DataFrame, label: Column, width: float, sample_key: str, keys: Sequence[str] = ()) -> DataFrame:
    """(sample_key, label) of the interval (ord, start_t, stop_t) that holds each sample; the last ``ord`` wins, null outside."""
    i = intervals.withColumn("_label", label)
    found = ts.interval_join(samples.select(sample_key, *keys, "t"), i, "t", "start_t", "stop_t", width, keys)
    labels = found.groupBy(sample_key).agg(F.max_by("_label", "ord").alias("label"))
    return samples.select(sample_key).join(labels, sample_key, "left")


def spike_counts(spikes: DataFrame, dt: float, start: float, stop: float) -> DataFrame:
    """(t_idx, unit, n) of every time bin and unit; the last bin holds ``stop``."""
    n_bins = round((stop - start) / dt)
    counts = spikes.withColumn("t_idx", closed_bin_index(F.col("t"), start, dt, n_bins)).where("t_idx is not null")
    counts = counts.groupBy("t_idx", "unit").agg(F.count("*").alias("n"))
    frame = spikes.select("unit").distinct().withColumn("t_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))))
    return frame.join(counts, ["t_idx", "unit"], "left").select("t_idx", "unit", F.coalesce("n", F.lit(0)).alias("n"))


def inter_event(events: DataFrame, keys: Sequence[str], span: float | None = None) -> DataFrame:
    """``events`` with the time since the one before of the same keys."""
    order = ("t", *[c for c in ("idx",) if c in events.columns])
    d = ts.with_previous(events, keys, order, ("t",), span)
    return d.withColumn("interval", F.col("t") - F.col("prev_t")).drop("prev_t")


def shift_z(values: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``values`` with z: against mean and population deviation of its group; 0 where all are equal."""
    w = Window.partitionBy(*(by or [F.lit(1)]))
    d = values.withColumns({"_m": F.avg(value).over(w), "_s": F.stddev_pop(value).over(w)})
    return d.withColumn("z", F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")
