"""Rate maps of units over bins, and their measures.

Spikes (session, unit, t) are placed by interpolating the trajectory.  Rates have a row for
each unit and bin; a rate is null where a bin was not occupied for long enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import angles
from ..functions.moments import correlation
from ..session import Scratch
from . import fields
from . import timeseries as ts
from .grid import Grid, bin_at
from .trajectory import KEYS, fill_bins, intervals


def _spikes_in(spikes: DataFrame, told: DataFrame, grid: Grid, span: float | None) -> DataFrame:
    told = told.select("session", "t", "x", "y", "valid", "dt", "next_x", "next_y")
    d = ts.asof(spikes, told.withColumn("start_t", F.col("t")), KEYS, "t", ("start_t", "x", "y", "valid", "dt", "next_x", "next_y"), "", span=span)
    share = (F.col("t") - F.col("start_t")) / F.col("dt")
    d = d.where(F.col("valid") & (F.col("t") <= F.col("start_t") + F.col("dt")))
    d = d.withColumns({"x": F.col("x") + share * (F.col("next_x") - F.col("x")), "y": F.col("y") + share * (F.col("next_y") - F.col("y"))})
    return bin_at(d.select(*spikes.columns, "x", "y"), grid).where("bin_id >= 0")


def place_spikes(spikes: DataFrame, samples: DataFrame, grid: Grid, max_gap: float | None = None, min_speed: float | None = None, span: float | None = None) -> DataFrame:
    """``spikes`` with x, y and bin_id where they fell; those in intervals that don't count, or outside, are left out."""
    return _spikes_in(spikes, intervals(samples, grid, max_gap, min_speed, span), grid, span)


def rate_map(spikes: DataFrame, samples: DataFrame, grid: Grid, max_gap: float | None = None, min_speed: float | None = None, min_occupancy: float = 0.0, span: float | None = None) -> DataFrame:
    """(unit, bin_id, n, seconds, rate) of every unit and active bin."""
    told = intervals(samples, grid, max_gap, min_speed, span).select("session", "t", "x", "y", "valid", "dt", "next_x", "next_y", "bin_id")
    # Written once, for the spikes and for the time.
    told = Scratch(samples.sparkSession, "rate-map").keep("intervals", told)
    counts = _spikes_in(spikes, told, grid, span).groupBy("unit", "bin_id").agg(F.count("*").alias("n"))
    seconds = told.where("valid").groupBy("bin_id").agg(F.sum("dt").alias("seconds"))
    occupied = fill_bins(grid, seconds, ("seconds",))
    # Every unit has a row for every bin: that is the result.
    d = occupied.crossJoin(spikes.select("unit").distinct()).join(counts, ["unit", "bin_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rate = F.when((F.col("seconds") > 0) & (F.col("seconds") >= min_occupancy), F.col("n") / F.col("seconds"))
    return d.select("unit", "bin_id", "n", "seconds", rate.alias("rate"))


def smoothed_rate_map(rates: DataFrame, kernel: DataFrame, min_occupancy: float = 0.0) -> DataFrame:
    """``rates`` with rate as smoothed counts over smoothed time, by ``kernel`` (src, dst, w)."""
    k = kernel.join(rates.select("unit", F.col("bin_id").alias("dst"), "n", "seconds"), "dst")
    sums = k.groupBy("unit", F.col("src").alias("bin_id")).agg(F.sum(F.col("w") * F.col("n")).alias("wn"), F.sum(F.col("w") * F.col("seconds")).alias("ws"))
    rate = F.when((F.col("seconds") > 0) & (F.col("seconds") >= min_occupancy), F.try_divide(F.col("wn"), F.col("ws")))
    return rates.select("unit", "bin_id", "n", "seconds").join(sums, ["unit", "bin_id"]).select("unit", "bin_id", "n", "seconds", rate.alias("rate"))


def map_measures(rates: DataFrame) -> DataFrame:
    """Per unit: mean and peak rate, spatial information (bits a spike and a second), sparsity, selectivity, coverage.

    Bins without a rate count for nothing but coverage, whose share is of all bins.
    """
    w = Window.partitionBy("unit")
    d = rates.withColumn("p", F.when(F.col("rate").isNotNull(), F.col("seconds")))
    d = d.withColumn("p", F.col("p") / F.sum("p").over(w))
    d = d.withColumn("mean", F.sum(F.col("p") * F.col("rate")).over(w))
    ratio = F.try_divide(F.col("rate"), F.col("mean"))
    bits = F.when(ratio > 0, F.col("p") * ratio * F.log2(ratio))
    mean, peak = F.max("mean"), F.max("rate")
    information = F.greatest(F.lit(0.0), F.coalesce(F.sum(bits), F.lit(0.0)))
    return d.groupBy("unit").agg(
        mean.alias("mean_rate"),
        peak.alias("peak_rate"),
        information.alias("information"),
        (information * mean).alias("information_per_second"),
        F.try_divide(F.pow(F.sum(F.col("p") * F.col("rate")), 2), F.sum(F.col("p") * F.col("rate") * F.col("rate"))).alias("sparsity"),
        F.try_divide(peak, mean).alias("selectivity"),
        (F.count_if(F.col("rate") > 0) / F.count("*")).alias("coverage"),
    )


def mutual_information(rates: DataFrame, base: float = 2.0) -> DataFrame:
    """(unit, bits): what a unit's rate tells of the place, a second, in bits for ``base`` 2; null where it never fires.

    Places count by the seconds spent in them; bins without a rate take no part.
    """
    d = rates.where("rate is not null and seconds > 0")
    m = d.groupBy("unit").agg(F.sum("seconds").alias("s"), F.sum(F.col("seconds") * F.col("rate")).alias("sr"), F.sum(F.when(F.col("rate") > 0, F.col("seconds") * F.col("rate") * F.log("rate"))).alias("sl"))
    mean = F.try_divide(F.col("sr"), F.col("s"))
    nats = F.try_divide(F.col("sl"), F.col("s")) - mean * F.log(F.when(mean > 0, mean))
    return m.select("unit", F.when(mean > 0, F.greatest(F.lit(0.0), nats / F.log(F.lit(float(base))))).alias("bits"))


def coherence(rates: DataFrame, edges: DataFrame) -> DataFrame:
    """(unit, coherence): correlation of each bin's rate with the mean of its neighbours'."""
    near = edges.select("src", "dst").join(rates.select("unit", F.col("bin_id").alias("dst"), F.col("rate").alias("r")), "dst")
    near = near.groupBy("unit", F.col("src").alias("bin_id")).agg(F.avg("r").alias("around"))
    return rates.join(near, ["unit", "bin_id"]).where("rate is not null and around is not null").groupBy("unit").agg(correlation(F.col("rate"), F.col("around")).alias("coherence"))


def in_out_ratio(rates: DataFrame, inside: Column) -> DataFrame:
    """(unit, ratio): mean rate of the bins where ``inside`` holds, by that of the others."""
    return rates.groupBy("unit").agg(F.try_divide(F.avg(F.when(inside, F.col("rate"))), F.avg(F.when(~inside, F.col("rate")))).alias("ratio"))


def centroid(rates: DataFrame, bins: DataFrame) -> DataFrame:
    """(unit, x, y): mean place by rate."""
    d = rates.join(bins.select("bin_id", "x", "y"), "bin_id")
    at = lambda c: F.try_divide(F.sum(F.col(c) * F.col("rate")), F.sum("rate")).alias(c)
    return d.where("rate is not null").groupBy("unit").agg(at("x"), at("y"))


def stability(a: DataFrame, b: DataFrame) -> DataFrame:
    """(unit, r): correlation of two rate maps over the bins where both have a rate."""
    d = a.select("unit", "bin_id", F.col("rate").alias("ra")).join(b.select("unit", "bin_id", F.col("rate").alias("rb")), ["unit", "bin_id"])
    return d.where("ra is not null and rb is not null").groupBy("unit").agg(correlation(F.col("ra"), F.col("rb")).alias("r"))


def population_vector_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bin_id, r): correlation across units of two sets of rate maps."""
    d = a.select("unit", "bin_id", F.col("rate").alias("ra")).join(b.select("unit", "bin_id", F.col("rate").alias("rb")), ["unit", "bin_id"])
    return d.where("ra is not null and rb is not null").groupBy("bin_id").agg(correlation(F.col("ra"), F.col("rb")).alias("r"))


def peak_bins(rates: DataFrame) -> DataFrame:
    """(unit, bin_id, rate) where each unit's rate is highest; the first bin of equal ones."""
    order = Window.partitionBy("unit").orderBy(F.col("rate").desc_nulls_last(), "bin_id")
    return rates.withColumn("_k", F.row_number().over(order)).where("_k = 1 and rate is not null").select("unit", "bin_id", "rate")


def field_bins(rates: DataFrame, share: float = 0.2) -> DataFrame:
    """Bins where a unit's rate is at least ``share`` of its peak."""
    return rates.where(F.col("rate").isNotNull()).withColumn("_p", F.max("rate").over(Window.partitionBy("unit"))).where((F.col("_p") > 0) & (F.col("rate") >= share * F.col("_p"))).drop("_p")


def place_fields(rates: DataFrame, edges: DataFrame, share: float = 0.2, min_bins: int = 1) -> DataFrame:
    """(unit, field, bin_id, rate): linked groups of a unit's ``field_bins``; field is the smallest bin."""
    inside = field_bins(rates, share).select("unit", "bin_id", "rate")
    # One graph for all units: a node for each unit and bin.
    node = F.struct("unit", "bin_id")
    nodes = inside.select(node.alias("bin_id"))
    a = inside.select("unit", F.col("bin_id").alias("src"))
    b = inside.select("unit", F.col("bin_id").alias("dst"))
    links = a.join(edges.select("src", "dst"), "src").join(b, ["unit", "dst"])
    links = links.select(F.struct("unit", F.col("src").alias("bin_id")).alias("src"), F.struct("unit", F.col("dst").alias("bin_id")).alias("dst"))
    found = fields.components(nodes, links).select("bin_id.unit", "bin_id.bin_id", F.col("component.bin_id").alias("field"))
    found = found.withColumn("_n", F.count("*").over(Window.partitionBy("unit", "field"))).where(F.col("_n") >= min_bins).drop("_n")
    return found.join(inside, ["unit", "bin_id"]).select("unit", "field", "bin_id", "rate")


def directional_tuning(spikes: DataFrame, headings: DataFrame, n_bins: int, span: float | None = None) -> DataFrame:
    """(unit, bin, n, seconds, rate) by heading (session, idx, t, heading): a spike has the heading of the sample before it."""
    width = 2 * 3.141592653589793 / n_bins
    of = lambda h: F.pmod(F.floor(F.pmod(h, F.lit(2 * 3.141592653589793)) / width), F.lit(n_bins)).cast("long")
    d = ts.with_next(headings, KEYS, ("t", "idx"), ("t",), span).withColumn("dt", F.col("next_t") - F.col("t")).where("dt is not null")
    known = d.where("heading is not null")
    occupied = known.groupBy(of(F.col("heading")).alias("bin")).agg(F.sum("dt").alias("seconds"))
    told = d.withColumn("stop_t", F.col("next_t")).select("session", "t", "heading", "stop_t")
    placed = ts.asof(spikes, told, KEYS, "t", ("heading", "stop_t"), "", span=span).where("heading is not null and t <= stop_t")
    counts = placed.groupBy("unit", of(F.col("heading")).alias("bin")).agg(F.count("*").alias("n"))
    frame = spikes.select("unit").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))))
    d = frame.join(counts, ["unit", "bin"], "left").join(occupied, "bin", "left")
    n, seconds = F.coalesce("n", F.lit(0)), F.coalesce("seconds", F.lit(0.0))
    return d.select("unit", "bin", n.alias("n"), seconds.alias("seconds"), F.when(seconds > 0, n / seconds).alias("rate"))


def direction_measures(tuning: DataFrame, n_bins: int) -> DataFrame:
    """(unit, preferred, length): mean direction and vector length of a directional tuning."""
    center = (F.col("bin") + 0.5) * (2 * 3.141592653589793 / n_bins)
    rate = F.coalesce("rate", F.lit(0.0))
    return tuning.groupBy("unit").agg(angles.mean_direction(center, rate).alias("preferred"), angles.resultant_length(center, rate).alias("length"))


def egocentric_occupancy(samples: DataFrame, objects: list[tuple[float, float]], max_distance: float, n_distance: int, n_angle: int, span: float | None = None) -> DataFrame:
    """(i_distance, i_angle, seconds) by distance and bearing of the nearest object; heading is that of the step."""
    from ..functions import geometry
    from .trajectory import steps

    d = steps(samples, span).where("dt is not null")
    seen = [F.struct(geometry.distance(F.col("x"), F.col("y"), F.lit(a), F.lit(b)).alias("r"), F.lit(k).alias("k"), geometry.bearing(F.col("x"), F.col("y"), F.col("heading"), F.lit(a), F.lit(b)).alias("b")) for k, (a, b) in enumerate(objects)]
    d = d.withColumn("o", F.array_min(F.array(*seen))).where(F.col("o.r") < max_distance)
    i_d = F.floor(F.col("o.r") / (max_distance / n_distance))
    i_a = F.pmod(F.floor((F.col("o.b") + 3.141592653589793) / (2 * 3.141592653589793 / n_angle)), F.lit(n_angle))
    return d.groupBy(i_d.alias("i_distance"), i_a.alias("i_angle")).agg(F.sum("dt").alias("seconds"))


def zero_filled(grid: Grid, values: DataFrame, column: str) -> DataFrame:
    return fill_bins(grid, values, (column,))


def border_scores(rates: DataFrame, grid: Grid, share: float = 0.3) -> DataFrame:
    """(unit, score): how much a unit's field lies along one wall of a rectangular grid, from -1 to 1.

    The field is every bin of at least ``share`` of the peak.  Cover is the largest share of
    a wall's bins in the field, depth the mean distance of the field from its nearest wall,
    by rate and half the shorter side.
    """
    d = field_bins(rates, share).join(grid.small(grid.bins.select("bin_id", "ix", "iy")), "bin_id")
    nx, ny = grid.shape
    steps = F.least(F.least("ix", nx - 1 - F.col("ix")) * grid.width[0], F.least("iy", ny - 1 - F.col("iy")) * grid.width[1])
    deepest = min((nx - 1) * grid.width[0], (ny - 1) * grid.width[1]) / 2
    walls = {"west": (F.col("ix") == 0, ny), "east": (F.col("ix") == nx - 1, ny), "south": (F.col("iy") == 0, nx), "north": (F.col("iy") == ny - 1, nx)}
    cover = F.greatest(*[F.count_if(on) / n for on, n in walls.values()])
    depth = F.sum(F.col("rate") * steps) / F.sum("rate") / deepest
    m = d.groupBy("unit").agg(cover.alias("cover"), depth.alias("depth"))
    return m.select("unit", F.try_divide(F.col("cover") - F.col("depth"), F.col("cover") + F.col("depth")).alias("score"))


def grid_scores(rates: DataFrame, grid: Grid) -> DataFrame:
    """(unit, score): hexagonal symmetry of each rate map's autocorrelation.

    A unit's map is one small matrix, whose size is that of the grid; units are dealt to
    tasks.  The score is the least correlation at 60 and 120 degrees less the largest at 30,
    90 and 150, over the ring without the central peak.
    """
    import numpy as np
    import pandas as pd

    nx, ny = grid.shape
    placed = rates.where("rate is not null").join(grid.small(grid.bins.select("bin_id", "ix", "iy")), "bin_id").select("unit", "ix", "iy", "rate")
    schema = f"unit {rates.schema['unit'].dataType.simpleString()}, score double"

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        m, known = np.zeros((nx, ny)), np.zeros((nx, ny))
        m[rows["ix"], rows["iy"]], known[rows["ix"], rows["iy"]] = rows["rate"], 1.0
        size = (2 * nx, 2 * ny)
        spec = lambda a: np.fft.rfft2(a, size)
        over = lambda a, b: np.fft.irfft2(spec(a) * np.conj(spec(b)), size)
        n, s, q, p = over(known, known).round(), over(m, known), over(m * m, known), over(m, m)
        t, u = over(known, m), over(known, m * m)
        with np.errstate(all="ignore"):
            r = (n * p - s * t) / np.sqrt((n * q - s * s) * (n * u - t * t))
        r = np.roll(np.where((n >= 10) & np.isfinite(r), r, np.nan), (nx, ny), (0, 1))
        y, x = np.mgrid[-nx:nx, -ny:ny]
        radius = np.hypot(x, y)
        low = next((k for k in range(1, min(nx, ny)) if np.nanmean(r[(radius >= k) & (radius < k + 1)]) < 0.1), 1)
        ring = (radius >= low) & (radius <= min(nx, ny) * 0.8) & np.isfinite(r)
        by = {}
        for degrees in (30, 60, 90, 120, 150):
            a = np.radians(degrees)
            i = np.rint(np.cos(a) * y[ring] - np.sin(a) * x[ring]).astype(int) + nx
            j = np.rint(np.sin(a) * y[ring] + np.cos(a) * x[ring]).astype(int) + ny
            inside = (i >= 0) & (i < 2 * nx) & (j >= 0) & (j < 2 * ny)
            a, b = r[ring][inside], r[i[inside], j[inside]]
            fine = np.isfinite(b)
            by[degrees] = np.corrcoef(a[fine], b[fine])[0, 1] if fine.sum() > 2 else np.nan
        value = min(by[60], by[120]) - max(by[30], by[90], by[150])
        return pd.DataFrame({"unit": [rows["unit"].iloc[0]], "score": [float(value)]})

    return placed.groupBy("unit").applyInPandas(score, schema)
