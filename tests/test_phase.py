"""Band-pass and phase against one run over the whole signal, sample by sample."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom.functions import filters
from gridloom.operators import phase


def coefficients(low, high, rate):
    """(b, a) of the order 4 Butterworth band-pass, from its poles and zeros."""
    m = filters.butterworth_band(low, high, rate)
    poles = np.concatenate([m.pole, m.pole.conj()])
    b, a = np.poly([1] * 4 + [-1] * 4), np.poly(poles).real
    middle = np.exp(2j * np.arctan(np.sqrt(math.tan(math.pi * low / rate) * math.tan(math.pi * high / rate))))
    return b / abs(np.polyval(b, middle) / np.polyval(a, middle)), a


def direct_form(b, a, x):
    """One run from the steady state of the first sample."""
    past = np.full(len(b) - 1, x[0])
    out = np.zeros(len(b) - 1)
    y = []
    for v in x:
        y.append(b[0] * v + b[1:] @ past - a[1:] @ out)
        past, out = np.roll(past, 1), np.roll(out, 1)
        past[0], out[0] = v, y[-1]
    return np.array(y)


def forward_backward(low, high, rate, x):
    b, a = coefficients(low, high, rate)
    pad = 27
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    return direct_form(b, a, direct_form(b, a, ext)[::-1])[::-1][pad:-pad]


def whole_phase(v):
    spectrum = np.fft.fft(v)
    n = len(v)
    double = np.zeros(n)
    double[0] = 1
    double[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        double[n // 2] = 1
    return np.angle(np.fft.ifft(spectrum * double))


def test_gain_of_the_band():
    """3 dB at both edges, all in the middle, next to nothing outside."""
    b, a = coefficients(6.0, 10.0, 100.0)
    for f, gain in ((6.0, math.sqrt(0.5)), (10.0, math.sqrt(0.5)), (1.0, 0.0), (40.0, 0.0)):
        z = np.exp(2j * math.pi * f / 100)
        assert abs(np.polyval(b, z) / np.polyval(a, z)) == pytest.approx(gain, abs=2e-3)
    m = filters.butterworth_band(6.0, 10.0, 100.0)
    x = np.random.default_rng(0).normal(size=1000)
    y, _ = filters.run(m, x, x[0] / (1 - m.pole), block=64)
    assert np.allclose(y, direct_form(b, a, x), atol=1e-9)
    with pytest.raises(ValueError):
        filters.butterworth_band(6.0, 51.0, 100.0)


def test_lengths_of_stretches_make_no_difference(spark):
    rng = np.random.default_rng(1)
    t = np.arange(1500) / 100
    signals = {"noise": rng.normal(size=1500), "sine": np.cos(2 * math.pi * 8 * t + 1) + 3 + 0.2 * t, "flat": np.full(1500, 2.0), "short": rng.normal(size=28)}
    rows = [(k, n, float(v)) for k, x in signals.items() for n, v in enumerate(x)]
    rows += [("gap", n, 1.0) for n in range(50) if n != 7] + [("twice", n, 1.0) for n in [*range(50), 7]] + [("null", n, None if n == 3 else 1.0) for n in range(50)]
    rows += [("nan", n, float("nan") if n == 3 else 1.0) for n in range(50)] + [("few", n, 1.0) for n in range(27)]
    d = spark.createDataFrame(rows, "channel string, n long, v double")
    found = []
    for length in (100, 100_000):
        v = phase.band_pass(d, 6.0, 10.0, 100.0, length=length)
        found.append(phase.analytic_phase(v, 6.0, 100.0, length=length).toPandas().sort_values(["channel", "n"]))
    one, other = found
    assert one["n"].tolist() == other["n"].tolist() and one["channel"].tolist() == other["channel"].tolist()
    assert np.allclose(one["v"], other["v"], atol=1e-9) and np.allclose(one["amplitude"], other["amplitude"], atol=1e-9)
    assert set(one["channel"]) == set(signals)
    for k, x in signals.items():
        mine = one[one["channel"] == k]
        assert mine["n"].tolist() == list(range(len(x)))
        assert np.allclose(mine["v"], forward_backward(6.0, 10.0, 100.0, x), atol=1e-8), k
    sine = one[(one["channel"] == "sine") & one["n"].between(300, 1200)]
    turned = np.angle(np.exp(1j * (sine["phase"] - (2 * math.pi * 8 * sine["n"] / 100 + 1))))
    assert np.abs(turned).max() < 1e-3
    noise = one[one["channel"] == "noise"]
    # A narrow band's phase is told apart where there is a signal.
    strong = noise["amplitude"] > noise["amplitude"].median() / 2
    off = np.angle(np.exp(1j * (noise["phase"] - whole_phase(noise["v"].to_numpy()))))
    assert np.abs(off[strong]).max() < 0.05
    assert ((one["phase"] >= 0) & (one["phase"] < 2 * math.pi)).all()


def test_locked_events(spark):
    phases = spark.createDataFrame([("a", n, (n % 10) * 0.2 * math.pi) for n in range(100)], "channel string, n long, phase double")
    events = spark.createDataFrame([("a", "locked", 10.0 * k + 3) for k in range(10)] + [("a", "loose", float(k)) for k in range(100)] + [("a", "late", 500.0), ("b", "locked", 3.0)], "channel string, unit string, t double")
    got = {r.unit: r for r in phase.phase_locking(phases, events, F.floor("t")).collect()}
    assert got.keys() == {"locked", "loose"}
    assert (got["locked"].n, got["locked"].direction, got["locked"].length) == (10, pytest.approx(0.6 * math.pi), pytest.approx(1.0))
    assert (got["loose"].n, got["loose"].direction) == (100, None)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_queries(spark, sf):
    from gridloom.plans import phase as plan

    folder = f"/root/testdata/{sf}"
    mine = entry.queries()["band_phase"](spark, folder).toPandas().sort_values(["channel", "n"])
    counts = plan.counts(spark, folder).toPandas().sort_values(["channel", "n"])
    assert len(mine) == len(counts) == 4 * 1440
    for c in range(4):
        v = forward_backward(plan.LOW, plan.HIGH, plan.PER_DAY, counts[counts["channel"] == c]["v"].to_numpy())
        assert np.allclose(mine[mine["channel"] == c]["v"], v, atol=2e-6)
    locking = entry.queries()["phase_locking"](spark, folder).toPandas()
    assert locking["n"].sum() == counts["v"].sum() and locking["length"].between(0, 1).all()
