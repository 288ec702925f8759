"""What kind of cell a unit is: tuning to direction, objects, views and places, and the population's measures.

Rates have a row for each unit and bin, as in ``encoding``; null where a bin was not visited.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import angles, geometry
from ..functions.moments import correlation
from . import encoding, visibility
from . import timeseries as ts
from .grid import Grid, bin_at
from .layouts import polar_bin
from .trajectory import KEYS, steps


def tuning_width(tuning: DataFrame, n_bins: int) -> DataFrame:
    """(unit, width): half the width at half of the peak, in radians; null for units that never fall below half.

    Each side's crossing lies between the last bin above and the first below, by their
    rates; bins without a rate are passed over.  The mean of the sides that cross counts.
    """
    by_bin = F.sort_array(F.collect_list(F.struct("bin", "rate")))  # n_bins rows
    d = tuning.where("rate is not null").groupBy("unit").agg(by_bin.alias("t"))
    peak = F.array_max(F.transform("t", lambda x: F.struct(x["rate"].alias("r"), (-x["bin"]).alias("b"))))
    d = d.select("unit", "t", peak.alias("p"))

    def side(sign: int) -> Column:
        far = F.transform("t", lambda x: F.struct(F.pmod(sign * (x["bin"] + F.col("p.b")), F.lit(n_bins)).alias("k"), x["rate"].alias("rate")))
        way = F.array_sort(F.filter(far, lambda x: x["k"] <= n_bins // 2))
        below = F.filter(way, lambda x: (x["k"] > 0) & (x["rate"] < F.col("p.r") / 2))
        first = F.get(below, 0)
        above = F.element_at(F.filter(way, lambda x: x["k"] < first["k"]), -1)
        share = F.try_divide(F.col("p.r") / 2 - above["rate"], first["rate"] - above["rate"])
        return F.when(F.size(below) > 0, (above["k"] + share * (first["k"] - above["k"])) * (2 * math.pi / n_bins))

    left, right = side(-1), side(1)
    return d.select("unit", ((F.coalesce(left, right) + F.coalesce(right, left)) / 2).alias("width"))


def direction_cells(tuning: DataFrame, n_bins: int, min_length: float = 0.4, alpha: float = 0.05) -> DataFrame:
    """(unit, preferred, peak_rate, length, p, width, head_direction) of directional tuning.

    length is that of the mean vector by rate; p is Rayleigh's over the spikes in visited
    bins, null for fewer than three.  A head direction cell exceeds ``min_length`` with p
    below ``alpha``.
    """
    center = (F.col("bin") + 0.5) * (2 * math.pi / n_bins)
    rate, n = F.coalesce("rate", F.lit(0.0)), F.when(F.col("rate").isNotNull(), F.col("n")).otherwise(0)
    m = tuning.groupBy("unit").agg(
        angles.mean_direction(center, rate).alias("preferred"), F.max("rate").alias("peak_rate"), angles.resultant_length(center, rate).alias("length"),
        angles.resultant_length(center, n).alias("_r"), F.sum(n).alias("_n"),
    )
    p = F.when(F.col("_n") >= 3, angles.rayleigh_p(F.col("_n") * F.col("_r") * F.col("_r"), F.col("_n")))
    m = m.withColumn("p", p).withColumn("head_direction", F.coalesce((F.col("length") > min_length) & (F.col("p") < alpha), F.lit(False)))
    return m.join(tuning_width(tuning, n_bins), "unit", "left").select("unit", "preferred", "peak_rate", "length", "p", "width", "head_direction")


def _rate(frame_bins: DataFrame, spikes: DataFrame, counts: DataFrame, seconds: DataFrame, min_occupancy: float) -> DataFrame:
    """(unit, bin_id, n, seconds, rate) of all units and ``frame_bins``: spikes by time where it exceeds ``min_occupancy``."""
    # Bins and units are few, whatever the recording's length; every pair of them is a row of the result.
    frame = frame_bins.select("bin_id").join(seconds, "bin_id", "left").crossJoin(spikes.select("unit").distinct())
    d = frame.join(counts, ["unit", "bin_id"], "left")
    n, s = F.coalesce("n", F.lit(0)), F.coalesce("seconds", F.lit(0.0))
    return d.select("unit", "bin_id", n.alias("n"), s.alias("seconds"), F.when(s > max(min_occupancy, 0.0), n / s).alias("rate"))


def _by_state(spikes: DataFrame, states: DataFrame, bins: DataFrame, min_occupancy: float, span: float | None) -> DataFrame:
    """Rates of ``spikes`` over states (session, t, dt, bin_id): a spike has the state of the sample before it; state -1 counts for nothing."""
    told = states.withColumn("stop_t", F.col("t") + F.col("dt")).select("session", "t", "bin_id", "stop_t")
    placed = ts.asof(spikes, told, KEYS, "t", ("bin_id", "stop_t"), "", span=span).where("bin_id >= 0 and t <= stop_t")
    counts = placed.groupBy("unit", "bin_id").agg(F.count("*").alias("n"))
    seconds = states.where("bin_id >= 0").groupBy("bin_id").agg(F.sum("dt").alias("seconds"))
    return _rate(bins, spikes, counts, seconds, min_occupancy)


def egocentric_states(samples: DataFrame, objects: list[tuple[float, float]], distances: tuple[float, float, int], n_angles: int, span: float | None = None) -> DataFrame:
    """(session, idx, t, dt, bin_id): the polar bin of the nearest object seen along each step; the first of equally near ones."""
    d = steps(samples, span).where("dt is not null")
    seen = [F.struct(geometry.distance(F.col("x"), F.col("y"), F.lit(a), F.lit(b)).alias("r"), F.lit(k).alias("k"), geometry.bearing(F.col("x"), F.col("y"), F.col("heading"), F.lit(a), F.lit(b)).alias("b")) for k, (a, b) in enumerate(objects)]
    d = d.withColumn("o", F.array_min(F.array(*seen)))
    return d.select("session", "idx", "t", "dt", polar_bin(F.col("o.r"), F.col("o.b"), distances, n_angles).alias("bin_id"))


def egocentric_rates(spikes: DataFrame, states: DataFrame, bins: DataFrame, min_occupancy: float = 0.0, span: float | None = None) -> DataFrame:
    """(unit, bin_id, n, seconds, rate) over ``polar_bins``: the raw rate of each distance and bearing."""
    return _by_state(spikes, states, bins, min_occupancy, span)


def object_vector_cells(rates: DataFrame, bins: DataFrame, max_selectivity: float = 10.0, min_information: float = 0.3) -> DataFrame:
    """(unit, preferred_distance, preferred_direction, information, score, object_vector) of ``egocentric_rates``.

    The preferred place is the center of the peak's bin.  score is the peak over the mean
    rate, from 1 to ``max_selectivity`` scaled to 0 to 1, times the vector length of the
    rates over bearings.
    """
    d = rates.join(bins.select("bin_id", "distance", "angle"), "bin_id")
    known = d.where("rate is not null")
    peak = F.min_by(F.struct("distance", "angle"), F.struct(-F.col("rate"), F.col("bin_id")))
    selective = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.try_divide(F.max("rate"), F.avg("rate")) - 1) / (max_selectivity - 1)))
    m = known.groupBy("unit").agg(peak.alias("p"), selective.alias("s"), angles.resultant_length(F.col("angle"), F.col("rate")).alias("r"))
    score = F.coalesce(F.col("s") * F.col("r"), F.lit(0.0))
    m = m.join(encoding.map_measures(rates).select("unit", "information"), "unit")
    return m.select(
        "unit", F.col("p.distance").alias("preferred_distance"), F.col("p.angle").alias("preferred_direction"), "information", score.alias("score"),
        (F.col("information") > min_information).alias("object_vector"),
    )


def view_states(samples: DataFrame, grid: Grid, distance: float, span: float | None = None) -> DataFrame:
    """(session, idx, t, dt, bin_id): the bin that each step looks at, ``distance`` ahead; -1 outside."""
    d = steps(samples, span).where("dt is not null")
    x, y = visibility.view_point(F.col("x"), F.col("y"), F.col("heading"), distance)
    return bin_at(d.select("session", "idx", "t", "dt", x.alias("x"), y.alias("y")), grid).select("session", "idx", "t", "dt", "bin_id")


def view_rates(spikes: DataFrame, states: DataFrame, grid: Grid, min_occupancy: float = 0.0, span: float | None = None) -> DataFrame:
    """(unit, bin_id, n, seconds, rate) by the place looked at."""
    return _by_state(spikes, states, grid.bins, min_occupancy, span)


def view_cells(rates: DataFrame, grid: Grid, min_information: float = 0.5) -> DataFrame:
    """(unit, x, y, peak_rate, information, spatial_view): where each unit's view rate is highest, and whether it tells enough."""
    at = encoding.peak_bins(rates).join(grid.small(grid.bins.select("bin_id", "x", "y")), "bin_id")
    d = at.join(encoding.map_measures(rates).select("unit", "information"), "unit")
    return d.select("unit", "x", "y", F.col("rate").alias("peak_rate"), "information", (F.col("information") > min_information).alias("spatial_view"))


def directional_rates(spikes: DataFrame, samples: DataFrame, grid: Grid, labels: DataFrame, max_gap: float | None = None, span: float | None = None) -> DataFrame:
    """(label, unit, bin_id, n, seconds, rate): rate maps of the time under each label of samples (session, idx, label).

    Samples with a null label belong to none; a spike has the label of the sample before it.
    """
    told = samples.join(labels.select("session", "idx", "label"), ["session", "idx"])
    d = steps(bin_at(told, grid), span).where("dt is not null and label is not null and bin_id >= 0")
    d = d if max_gap is None else d.where(F.col("dt") <= max_gap)
    seconds = d.groupBy("label", "bin_id").agg(F.sum("dt").alias("seconds"))
    start = d.select("session", "t", F.col("t").alias("start_t"), "dt", "x", "y", "next_x", "next_y", "label")
    s = ts.asof(spikes, start, KEYS, "t", ("start_t", "dt", "x", "y", "next_x", "next_y", "label"), "", span=span).where(F.col("t") <= F.col("start_t") + F.col("dt"))
    share = (F.col("t") - F.col("start_t")) / F.col("dt")
    s = s.withColumns({"x": F.col("x") + share * (F.col("next_x") - F.col("x")), "y": F.col("y") + share * (F.col("next_y") - F.col("y"))})
    counts = bin_at(s.select("unit", "label", "x", "y"), grid).where("bin_id >= 0").groupBy("label", "unit", "bin_id").agg(F.count("*").alias("n"))
    frame = grid.bins.select("bin_id").crossJoin(seconds.select("label").distinct()).crossJoin(spikes.select("unit").distinct())
    d = frame.join(seconds, ["label", "bin_id"], "left").join(counts, ["label", "unit", "bin_id"], "left")
    n, t = F.coalesce("n", F.lit(0)), F.coalesce("seconds", F.lit(0.0))
    return d.select("label", "unit", "bin_id", n.alias("n"), t.alias("seconds"), F.when(t > 0, n / t).alias("rate"))


def compare_directions(rates: DataFrame, a: str, b: str) -> DataFrame:
    """(unit, r, directionality): correlation of two labels' maps, and mean of |a - b| / (a + b) where either fires."""
    of = lambda label, name: rates.where(F.col("label") == label).select("unit", "bin_id", F.col("rate").alias(name))
    d = of(a, "ra").join(of(b, "rb"), ["unit", "bin_id"]).where("ra is not null and rb is not null")
    index = F.try_divide(F.abs(F.col("ra") - F.col("rb")), F.nullif(F.col("ra") + F.col("rb"), F.lit(0.0)))
    return d.groupBy("unit").agg(correlation(F.col("ra"), F.col("rb")).alias("r"), F.avg(index).alias("directionality"))


def cell_types(rates: DataFrame, edges: DataFrame, max_mean_rate: float = 10.0, share: float = 0.2, min_bins: int = 1, min_information: float = 0.5) -> DataFrame:
    """(unit, mean_rate, information, fields, place): a place cell has a field and a mean rate up to ``max_mean_rate``; informative exceeds ``min_information``."""
    n = encoding.place_fields(rates, edges, share, min_bins).groupBy("unit").agg(F.countDistinct("field").alias("fields"))
    d = encoding.map_measures(rates).select("unit", "mean_rate", "information").join(n, "unit", "left")
    fields = F.when(F.col("mean_rate") <= max_mean_rate, F.coalesce("fields", F.lit(0))).otherwise(0)
    return d.select("unit", "mean_rate", "information", fields.alias("fields"), (fields > 0).alias("place"), (F.col("information") > min_information).alias("informative"))


def field_density(fields: DataFrame, bins: DataFrame) -> DataFrame:
    """(bin_id, n): how many units have a field of ``place_fields`` there."""
    n = fields.select("unit", "bin_id").distinct().groupBy("bin_id").agg(F.count("*").alias("n"))
    return bins.select("bin_id").join(n, "bin_id", "left").select("bin_id", F.coalesce("n", F.lit(0)).alias("n"))


def population_coverage(fields: DataFrame, bins: DataFrame, units: DataFrame) -> DataFrame:
    """(coverage, place_share, fields_a_cell, redundancy): share of bins with a field, of units with one, and means over those."""
    over = field_density(fields, bins).agg((F.count_if(F.col("n") > 0) / F.count("*")).alias("coverage"), F.avg(F.when(F.col("n") > 0, F.col("n"))).alias("redundancy"))
    each = fields.groupBy("unit").agg(F.countDistinct("field").alias("k"))
    cells = units.select("unit").distinct().join(each, "unit", "left").agg((F.count("k") / F.count("*")).alias("place_share"), F.avg("k").alias("fields_a_cell"))
    return over.crossJoin(cells).select("coverage", "place_share", "fields_a_cell", "redundancy")  # one row each


def field_overlap(fields: DataFrame) -> DataFrame:
    """(unit_a, unit_b, jaccard) of units whose fields share a bin: bins of both by bins of either."""
    d = fields.select("unit", "bin_id").distinct()
    size = d.groupBy("unit").agg(F.count("*").alias("size"))
    a, b = d.select("bin_id", F.col("unit").alias("unit_a")), d.select("bin_id", F.col("unit").alias("unit_b"))
    both = a.join(b, "bin_id").where("unit_a < unit_b").groupBy("unit_a", "unit_b").agg(F.count("*").alias("both"))
    both = both.join(size.select(F.col("unit").alias("unit_a"), F.col("size").alias("size_a")), "unit_a").join(size.select(F.col("unit").alias("unit_b"), F.col("size").alias("size_b")), "unit_b")
    return both.select("unit_a", "unit_b", (F.col("both") / (F.col("size_a") + F.col("size_b") - F.col("both"))).alias("jaccard"))


def field_shapes(fields: DataFrame, bins: DataFrame) -> DataFrame:
    """(unit, field, x, y, major, minor, eccentricity, orientation, n_bins): center and axes of each field by rate.

    The axes are twice the deviations along and across; from the two by two covariance.
    """
    d = fields.join(bins.select("bin_id", "x", "y"), "bin_id")
    mean = lambda c: F.sum(F.col("rate") * c) / F.sum("rate")
    x, y = F.col("x"), F.col("y")
    m = d.groupBy("unit", "field").agg(mean(x).alias("mx"), mean(y).alias("my"), mean(x * x).alias("xx"), mean(y * y).alias("yy"), mean(x * y).alias("xy"), F.count("*").alias("n_bins"))
    a, b, c = F.col("xx") - F.col("mx") * F.col("mx"), F.col("xy") - F.col("mx") * F.col("my"), F.col("yy") - F.col("my") * F.col("my")
    m = m.select("unit", "field", F.col("mx").alias("x"), F.col("my").alias("y"), a.alias("a"), b.alias("b"), c.alias("c"), "n_bins")
    root = F.sqrt((F.col("a") - F.col("c")) * (F.col("a") - F.col("c")) / 4 + F.col("b") * F.col("b"))
    large, small = (F.col("a") + F.col("c")) / 2 + root, F.greatest(F.lit(0.0), (F.col("a") + F.col("c")) / 2 - root)
    eccentricity = F.when(large > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - small / large))).otherwise(0.0)
    return m.select(
        "unit", "field", "x", "y", (2 * F.sqrt(F.greatest(F.lit(0.0), large))).alias("major"), (2 * F.sqrt(small)).alias("minor"), eccentricity.alias("eccentricity"),
        (F.atan2(2 * F.col("b"), F.col("a") - F.col("c")) / 2).alias("orientation"), "n_bins",
    )


def field_shift(a: DataFrame, b: DataFrame, bins: DataFrame) -> DataFrame:
    """(unit, shift): how far apart the mean places by rate of a unit's two maps are."""
    p, q = encoding.centroid(a, bins), encoding.centroid(b, bins).withColumnsRenamed({"x": "u", "y": "v"})
    return p.join(q, "unit").select("unit", geometry.distance(F.col("x"), F.col("y"), F.col("u"), F.col("v")).alias("shift"))


def track_shift_cost(a: DataFrame, b: DataFrame, bins: DataFrame) -> DataFrame:
    """(unit, cost): earth mover's distance of two maps of a track, each scaled to sum 1: the area between their running sums along ``position``."""
    d = a.select("unit", "bin_id", F.coalesce("rate", F.lit(0.0)).alias("ra")).join(b.select("unit", "bin_id", F.coalesce("rate", F.lit(0.0)).alias("rb")), ["unit", "bin_id"])
    d = d.join(bins.select("bin_id", "position"), "bin_id")
    unit = Window.partitionBy("unit")
    order = unit.orderBy("position", "bin_id")  # one row for each bin of a track
    share = lambda c: F.try_divide(F.col(c), F.sum(c).over(unit))
    d = d.withColumns({"pa": share("ra"), "pb": share("rb"), "gap": F.lead("position").over(order) - F.col("position")})
    sofar = F.sum(F.col("pa") - F.col("pb")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("moved", F.abs(sofar) * F.col("gap")).groupBy("unit").agg(F.sum("moved").alias("cost"))


def region_coverage(fields: DataFrame, membership: DataFrame) -> DataFrame:
    """(unit, region, coverage): share of each region's bins (region, bin_id) that a unit's fields hold."""
    size = membership.groupBy("region").agg(F.count("*").alias("size"))
    inside = fields.select("unit", "bin_id").distinct().join(membership, "bin_id").groupBy("unit", "region").agg(F.count("*").alias("n"))
    frame = fields.select("unit").distinct().crossJoin(size)
    return frame.join(inside, ["unit", "region"], "left").select("unit", "region", (F.coalesce("n", F.lit(0)) / F.col("size")).alias("coverage"))


def radial_autocorrelation(rates: DataFrame, distances: DataFrame, width: float) -> DataFrame:
    """(unit, ring, r, n): correlation of the rates of pairs of bins by their distance (a, b, distance), in rings of ``width``; null where rates of a ring are constant."""
    pairs = distances.where("a < b").select("a", "b", F.floor(F.col("distance") / width).alias("ring"))
    of = lambda k: rates.where("rate is not null").select("unit", F.col("bin_id").alias(k), F.col("rate").alias(f"r{k}"))
    d = pairs.join(of("a"), "a").join(of("b"), ["unit", "b"])
    d = d.groupBy("unit", "ring").agg(correlation(F.col("ra"), F.col("rb")).alias("r"), F.count("*").alias("n"))
    return d.where("n >= 2").select("unit", "ring", "r", "n")


def phase_precession(rows: DataFrame, slopes: tuple[float, float, int], min_spikes: int = 10, alpha: float = 0.05) -> DataFrame:
    """(unit, n, slope, phase0, r, correlation, p, precesses) of spikes (unit, position, phase).

    slope is the one of ``slopes`` (from, to, how many) after whose removal phases agree best;
    phase0 the phase at position 0.  correlation is the circular-linear one, p from n r².
    A unit precesses with a negative slope and p below ``alpha``.
    """
    low, high, n = slopes
    d = rows.where("position is not null and phase is not null")
    tried = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    slope = low + F.col("k") * ((high - low) / (n - 1))
    left = F.col("phase") - slope * F.col("position")
    sums = tried.groupBy("unit", "k").agg(angles.resultant_length(left).alias("r"), angles.mean_direction(left).alias("phase0"))
    best = sums.groupBy("unit").agg(F.min_by(F.struct("k", "r", "phase0"), F.struct(-F.round("r", 12), F.col("k"))).alias("m"))
    told = d.groupBy("unit").agg(F.count("*").alias("n"), angles.circular_linear_r(F.col("phase"), F.col("position")).alias("correlation")).where(F.col("n") >= min_spikes)
    p = F.exp(-F.col("n") * F.col("correlation") * F.col("correlation") / 2)
    d = told.join(best, "unit").withColumns({"slope": low + F.col("m.k") * ((high - low) / (n - 1)), "p": p})
    verdict = (F.col("slope") < 0) & (F.col("p") < alpha)
    return d.select("unit", "n", "slope", F.pmod(F.col("m.phase0"), F.lit(2 * math.pi)).alias("phase0"), F.col("m.r").alias("r"), "correlation", "p", verdict.alias("precesses"))


def circular_modulation(sine: Column, cosine: Column, var_s: Column, var_c: Column, cov: Column, alpha: float = 0.05, min_size: float = 0.2) -> Column:
    """Whether two regression coefficients, of sine and cosine, tell of modulation: Wald's test of both, and their amplitude."""
    det = var_s * var_c - cov * cov
    wald = (sine * sine * var_c - 2 * sine * cosine * cov + cosine * cosine * var_s) / F.nullif(det, F.lit(0.0))
    return F.coalesce((F.exp(-wald / 2) < alpha) & (F.sqrt(sine * sine + cosine * cosine) >= min_size), F.lit(False))


def reactivation(template: DataFrame, match: DataFrame, weights: DataFrame) -> DataFrame:
    """(strength): how active an assembly (unit, w) is in ``match`` (t_idx, unit, n), by its activity in ``template``.

    Both are scaled by the template's means and deviations, and activity is the mean size of
    the weighted sum over units in a time bin.
    """
    base = template.groupBy("unit").agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))
    base = base.join(weights, "unit").select("unit", "w", "mean", F.when(F.col("sd") > 1e-10, F.col("sd")).otherwise(1.0).alias("sd"))

    def size(counts: DataFrame, name: str) -> DataFrame:
        d = counts.join(base, "unit").groupBy("t_idx").agg(F.sum(F.col("w") * (F.col("n") - F.col("mean")) / F.col("sd")).alias("a"))
        return d.agg(F.avg(F.abs("a")).alias(name))

    return size(template, "a").crossJoin(size(match, "b")).select(F.try_divide(F.col("b"), F.when(F.col("a") > 1e-10, F.col("a"))).alias("strength"))  # one row each
