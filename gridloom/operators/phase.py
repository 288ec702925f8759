"""Zero-phase band-pass and instantaneous phase of long, evenly sampled signals.

A recording is one key with any number of samples, so it is cut into stretches.  A filter
run forward and backward needs what came before a stretch: each is first run from rest, the
few numbers of its state are chained over stretches, and it is run again from the state that
it really begins in.  So the result is that of one run over the whole signal, whatever the
length of the stretches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filters
from ..session import Scratch

#: Samples of a stretch.
STRETCH = 65_536
#: Samples by which both ends are continued, turned about the end point.
PAD = 27
#: Cycles of the band's low edge that the Hilbert transform's kernel reaches to each side.
CYCLES = 8


def _pass(d: DataFrame, keys: list[str], modes: filters.Modes, length: int) -> DataFrame:
    """``d`` (keys, n, v) as filtered along n from the steady state of its first sample."""
    names = ", ".join(f"{k} {d.schema[k].dataType.simpleString()}" for k in keys)
    d = d.withColumn("piece", F.floor(F.col("n") / length))
    group = [*keys, "piece"]
    still = 1 / (1 - modes.pole)

    def ends(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values("n")["v"].to_numpy()
        _, s = filters.run(modes, v, np.zeros(len(modes.pole)))
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in group}, "size": [len(v)], "first": [v[0]], "re": [s.real.tolist()], "im": [s.imag.tolist()]})

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        # A row for each stretch, so as many as the signal has samples / STRETCH.
        rows = rows.sort_values("piece")
        s, before = still * rows["first"].iloc[0], []
        for size, re, im in zip(rows["size"], rows["re"], rows["im"]):
            before.append(s)
            s = modes.pole ** float(size) * s + np.array(re) + 1j * np.array(im)
        return rows[group].assign(re=[b.real.tolist() for b in before], im=[b.imag.tolist() for b in before])

    def refine(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        s = np.array(start["re"].iloc[0]) + 1j * np.array(start["im"].iloc[0])
        y, _ = filters.run(modes, rows["v"].to_numpy(), s)
        return rows[[*keys, "n"]].assign(v=y)

    rest = d.groupBy(*group).applyInPandas(ends, f"{names}, piece long, size long, first double, re array<double>, im array<double>")
    starts = rest.groupBy(*keys).applyInPandas(chain, f"{names}, piece long, re array<double>, im array<double>")
    return d.groupBy(*group).cogroup(starts.groupBy(*group)).applyInPandas(refine, f"{names}, n long, v double")


def band_pass(signal: DataFrame, low: float, high: float, rate: float, keys: tuple[str, ...] = ("channel",), length: int = STRETCH) -> DataFrame:
    """(*keys, n, v): the signal filtered forward and backward by a Butterworth band-pass of order 4.

    ``signal``: (*keys, n, v) with n counting the samples from 0, ``rate`` of them in a unit of
    time.  Both ends are continued by 27 samples turned about the end point.  A signal with a
    missing or repeated n, a v that is null or not finite, or at most 27 samples gives no rows:
    one such sample would spoil all others.  The forward run is written to a scratch table.
    """
    modes, names = filters.butterworth_band(low, high, rate), list(keys)
    d = signal.select(*names, F.col("n").cast("long").alias("n"), F.col("v").cast("double").alias("v"))
    sound = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))
    ends = d.groupBy(*names).agg(
        F.count("*").alias("size"), F.count_distinct("n").alias("kinds"), F.min("n").alias("least"), F.max("n").alias("last"), F.count_if(~sound | F.col("n").isNull()).alias("bad"),
        F.max(F.when(F.col("n") == 0, F.col("v"))).alias("head"), F.max_by("v", "n").alias("tail"),
    )
    ends = ends.where((F.col("bad") == 0) & (F.col("least") == 0) & (F.col("size") == F.col("last") + 1) & (F.col("kinds") == F.col("size")) & (F.col("size") > PAD))
    known = Scratch(signal.sparkSession, "band-pass")
    ends = known.keep("ends", ends.select(*names, "last", "head", "tail"))
    d = d.join(ends, names)
    before = F.when(F.col("n").between(1, PAD), F.struct((-F.col("n")).alias("n"), (2 * F.col("head") - F.col("v")).alias("v")))
    after = F.when((F.col("n") < F.col("last")) & (F.col("n") >= F.col("last") - PAD), F.struct((2 * F.col("last") - F.col("n")).alias("n"), (2 * F.col("tail") - F.col("v")).alias("v")))
    itself = F.struct("n", "v")
    padded = d.select(*names, F.explode(F.array_compact(F.array(itself, before, after))).alias("p")).select(*names, "p.n", "p.v")
    forward = known.keep("forward", _pass(padded, names, modes, length))
    backward = _pass(forward.withColumn("n", -F.col("n")), names, modes, length).withColumn("n", -F.col("n"))
    return backward.join(ends.select(*names, "last"), names).where(F.col("n").between(0, F.col("last"))).select(*names, "n", "v")


def analytic_phase(filtered: DataFrame, low: float, rate: float, keys: tuple[str, ...] = ("channel",), length: int = STRETCH) -> DataFrame:
    """(*keys, n, v, phase, amplitude) of band-passed signals (*keys, n, v) without gaps.

    The phase is that of v and its Hilbert transform, from 0 up to 2 pi, and 0 at a crest.  The
    transform's kernel reaches ``CYCLES`` cycles of ``low``, the band's low edge, so that
    stretches need that many samples of their neighbours and no more; like a transform of the
    whole signal it joins its ends.  A signal shorter than the kernel goes round more than once.
    """
    names, reach = list(keys), math.ceil(CYCLES * rate / low)
    taps = filters.hilbert_taps(reach)
    types = ", ".join(f"{k} {filtered.schema[k].dataType.simpleString()}" for k in names)
    sizes = filtered.groupBy(*names).agg(F.count("*").alias("size"))
    d = filtered.join(sizes, names)
    # Places of a sample on the line along which the signal repeats, each in its stretches.
    turns = F.ceil(F.lit(reach) / F.col("size"))
    places = F.transform(F.sequence(-turns, turns), lambda k: F.col("n") + k * F.col("size"))
    near = F.filter(places, lambda n: (n >= -reach) & (n < F.col("size") + reach))
    placed = d.select(*names, "v", "size", F.explode(near).alias("n"))
    last = F.floor((F.col("size") - 1) / length)
    pieces = F.sequence(F.greatest(F.lit(0), F.floor((F.col("n") - reach) / length)), F.least(last, F.floor((F.col("n") + reach) / length)))
    placed = placed.select(*names, "n", "v", "size", F.explode(pieces).alias("piece"))

    def turn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        v = rows["v"].to_numpy()
        quarter = filters.convolve(v, taps)
        own = rows.iloc[reach : len(v) - reach]
        phase = np.mod(np.arctan2(quarter, own["v"].to_numpy()), 2 * np.pi)
        return own[[*names, "n", "v"]].assign(phase=phase, amplitude=np.hypot(quarter, own["v"].to_numpy()))

    return placed.groupBy(*names, "piece").applyInPandas(turn, f"{types}, n long, v double, phase double, amplitude double")


def phase_locking(phases: DataFrame, events: DataFrame, at: Column, keys: tuple[str, ...] = ("channel",), by: tuple[str, ...] = ("unit",)) -> DataFrame:
    """(*by, n, direction, length): mean direction and length of the phases at which events fall.

    ``at`` is the sample of an event, which has ``keys`` as well; events without one are left out.
    The direction is null where phases cancel out.
    """
    found = events.withColumn("n", at).join(phases.select(*keys, "n", "phase"), [*keys, "n"])
    c, s = F.avg(F.cos("phase")), F.avg(F.sin("phase"))
    out = found.groupBy(*by).agg(F.count("*").alias("n"), c.alias("_c"), s.alias("_s"))
    length = F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s"))
    direction = F.when(length > 1e-12, F.pmod(F.atan2("_s", "_c"), F.lit(2 * math.pi)))
    return out.select(*by, "n", direction.alias("direction"), length.alias("length"))
