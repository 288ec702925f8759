"""Modes of layouts and penalised rate maps against dense NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import diffusion, gam, spectral
from gridloom.operators.grid import regular_grid, subset

WIDTH = (2.0, 1.0)


@pytest.fixture(scope="module")
def layout(spark):
    """Two components of 15 and 10 bins, and their links' faces."""
    g = regular_grid(spark, (0.0, 0.0), WIDTH, (6, 5), diagonal=False)
    g = subset(g, F.col("ix") != 3)
    return g.bins.persist(), diffusion.grid_faces(g.bins, g.edges, WIDTH).persist()


def dense(layout):
    bins, faces = layout
    n = bins.count()
    w = np.zeros((n, n))
    for r in faces.collect():
        w[r.src, r.dst] = r.face / r.distance
    area = np.array([r.area for r in bins.orderBy("bin_id").collect()])
    return (np.diag(w.sum(1)) - w) / np.sqrt(np.outer(area, area)), area


@pytest.fixture(scope="module")
def basis(layout):
    return [x.persist() for x in spectral.eigenbasis(*layout, 7)]


@pytest.mark.parametrize("dense_bins", [0, 12, 400])
def test_modes(layout, dense_bins, monkeypatch):
    """By block Lanczos, by both, and dense."""
    monkeypatch.setattr(spectral, "DENSE_BINS", dense_bins)
    s, _ = dense(layout)
    values, modes = (x.collect() for x in spectral.eigenbasis(*layout, 7))
    assert sorted({r.component for r in values}) == [0, 15]
    for first, last in ((0, 15), (15, 25)):
        part = s[first:last, first:last]
        mine = np.array([r.eigenvalue for r in sorted((r for r in values if r.component == first), key=lambda r: r["mode"])])
        assert np.allclose(mine, np.linalg.eigvalsh(part)[:7], atol=1e-8)
        v = np.zeros((last - first, 7))
        for r in modes:
            if r.component == first:
                v[r.bin_id - first, r["mode"]] = r.v
        assert np.allclose(v.T @ v, np.eye(7), atol=1e-9)
        assert np.abs(part @ v - v * mine).max() < 1e-6


def test_heat_rank(basis):
    values = basis[0]
    ranks = {r.component: r["rank"] for r in spectral.heat_rank(values, 1.0, 0.9).collect()}
    for c in ranks:
        kept = [r for r in values.collect() if r.component == c and math.exp(-0.5 * r.eigenvalue) >= 0.9]
        assert ranks[c] == max(1, len(kept))


@pytest.mark.parametrize("dense_bins", [0, 400])
def test_more_modes_than_bins(spark, dense_bins, monkeypatch):
    """A component of one bin, and fewer bins than modes."""
    monkeypatch.setattr(spectral, "DENSE_BINS", dense_bins)
    g = regular_grid(spark, (0.0, 0.0), (1.0, 1.0), (4, 1), diagonal=False)
    g = subset(g, F.col("ix") != 1)
    values, modes = spectral.eigenbasis(g.bins, diffusion.grid_faces(g.bins, g.edges, (1.0, 1.0)), 5)
    found = sorted((r.component, r["mode"], round(r.eigenvalue, 9)) for r in values.collect())
    assert found == [(0, 0, 0.0), (1, 0, 0.0), (1, 1, 2.0)]
    assert modes.count() == 5


def truth(bins, occupancy, seed=1):
    r = np.random.default_rng(seed)
    x = np.array([(b.x, b.y) for b in bins])
    rate = np.stack([4 * np.exp(-((x - c) ** 2).sum(1) / 4) + 0.3 for c in ([3.0, 2.0], [9.0, 3.0], [1.0, 4.0])])
    return r.poisson(rate * occupancy)


def plain_fit(b, d, n_constants, seconds, y, log_penalty):
    """One unit at one penalty: (rates, restricted likelihood)."""
    lam, beta = math.exp(log_penalty), np.zeros(b.shape[1])
    beta[:n_constants] = math.log(y.sum() / seconds.sum()) / np.abs(b[:, :n_constants]).max(0)
    on = seconds > 0
    f = lambda v: -(y * (b @ v) - seconds * np.exp(b @ v))[on].sum() + 0.5 * lam * (d * v * v).sum()
    for _ in range(200):
        mu = seconds * np.exp(b @ beta)
        g = b.T @ np.where(on, y - mu, 0) - lam * d * beta
        h = b.T @ (mu[:, None] * b) + np.diag(lam * d + 1e-10)
        step, size = np.linalg.solve(h, g), 1.0
        while f(beta + size * step) > f(beta) + 1e-12 and size > 1e-12:
            size /= 2
        beta = beta + size * step
        if np.abs(step).max() < 1e-11:
            break
    mu = seconds * np.exp(b @ beta)
    h = b.T @ (mu[:, None] * b) + np.diag(lam * d + 1e-10)
    ll = (y * (b @ beta + np.log(np.where(on, seconds, 1.0))) - mu)[on].sum()
    rank = len(d) - n_constants
    return np.exp(b @ beta), -ll + 0.5 * lam * (d * beta * beta).sum() - 0.5 * rank * log_penalty + 0.5 * np.linalg.slogdet(h)[1]


@pytest.fixture(scope="module")
def recording(spark, layout, basis):
    bins = layout[0].orderBy("bin_id").collect()
    seconds = np.random.default_rng(0).uniform(2, 9, len(bins))
    seconds[4] = 0.0
    n = truth(bins, seconds)
    occupancy = spark.createDataFrame([(b.bin_id, float(s)) for b, s in zip(bins, seconds)], "bin_id long, seconds double")
    counts = spark.createDataFrame([(f"u{u}", b.bin_id, int(n[u, k])) for u in range(3) for k, b in enumerate(bins) if n[u, k]] + [("silent", 0, 0)], "unit string, bin_id long, n long")
    columns, d, n_constants = spectral.live_basis(layout[0], *basis, occupancy, 9)
    columns = columns.persist()
    b = np.array([r.basis for r in columns.orderBy("bin_id").collect()])
    return counts, occupancy, columns, d, n_constants, b, seconds, n


def test_live_basis(recording, layout):
    *_, d, n_constants, b, _, _ = recording
    _, area = dense(layout)
    assert n_constants == 2 and d[:2] == [0.0, 0.0] and d == [0.0, 0.0, *sorted(d[2:])] and b.shape == (25, 9)
    assert np.allclose(b.T @ (area[:, None] * b), np.eye(9), atol=1e-8)  # of length 1 by volume
    assert np.allclose(b[:15, 0], 1 / math.sqrt(30)) and np.allclose(b[15:, 0], 0)


@pytest.mark.parametrize("pooled", [True, False])
def test_penalised_maps(recording, pooled):
    counts, occupancy, columns, d, n_constants, b, seconds, n = recording
    maps, fits = gam.fit_rate_maps(counts, occupancy, columns, d, n_constants, pooled=pooled)
    found = {r.unit: r for r in fits.collect()}
    rates = {}
    for r in maps.collect():
        rates.setdefault(r.unit, np.zeros(25))[r.bin_id] = r.rate
    d = np.array(d)
    value = lambda u, x: plain_fit(b, d, n_constants, seconds, n[u] * (seconds > 0), x)[1]

    def least(f):
        low, high = -8.0, 20.0
        for _ in range(60):
            a, c = low + (high - low) * 0.382, low + (high - low) * 0.618
            low, high = (low, c) if f(a) < f(c) else (a, high)
        return (low + high) / 2

    shared = least(lambda x: sum(value(u, x) for u in range(3))) if pooled else None
    for u in range(3):
        best = shared if pooled else least(lambda x: value(u, x))
        r = found[f"u{u}"]
        assert r.converged and r.n == n[u][seconds > 0].sum()
        f = (lambda x: sum(value(k, x) for k in range(3))) if pooled else (lambda x: value(u, x))
        assert f(r.log_penalty) <= f(best) + 1e-4
        if not pooled:
            assert abs(r.objective - value(u, r.log_penalty)) < 1e-6
        assert np.allclose(rates[f"u{u}"], plain_fit(b, d, n_constants, seconds, n[u] * (seconds > 0), r.log_penalty)[0], rtol=1e-5)
    quiet = found["silent"]
    assert quiet.n == 0 and np.allclose(rates["silent"], 1e-10) and quiet.log_penalty == pytest.approx(np.mean([found[f"u{u}"].log_penalty for u in range(3)]))


def test_fixed_penalty_and_batches(recording, monkeypatch):
    monkeypatch.setattr(gam, "BATCH", 2)
    counts, occupancy, columns, d, n_constants, b, seconds, n = recording
    maps, fits = gam.fit_rate_maps(counts, occupancy, columns, d, n_constants, penalty=3.0)
    assert {round(r.log_penalty, 9) for r in fits.collect()} == {round(math.log(3.0), 9)}
    for r in maps.where("bin_id = 7 and unit <> 'silent'").collect():
        u = int(r.unit[1])
        assert r.rate == pytest.approx(plain_fit(b, np.array(d), n_constants, seconds, n[u] * (seconds > 0), math.log(3.0))[0][7], rel=1e-5)


def test_nobody_fired(spark, recording):
    _, occupancy, columns, d, n_constants, *_ = recording
    counts = spark.createDataFrame([("a", 0, 0)], "unit string, bin_id long, n long")
    maps, fits = gam.fit_rate_maps(counts, occupancy, columns, d, n_constants)
    assert {r.rate for r in maps.collect()} == {1e-10} and fits.first().n == 0
