"""Heat, transitions and filters against the dense exponential; decoding in tiles; constant groups."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.angles import circular_linear_r
from gridloom.functions.moments import correlation
from gridloom.operators import cells, decoding, diffusion, encoding, layouts, tiles
from gridloom.operators import grid as grids
from gridloom.operators.grid import polar_bins, regular_grid, subset, track_bins
from gridloom.sources import mazes


def shapes(spark):
    g = regular_grid(spark, (0.0, 0.0), (2.0, 1.0), (5, 4))
    yield "grid", g.bins, diffusion.grid_faces(g.bins, g.edges, (2.0, 1.0)), "area"
    split = subset(g, F.col("ix") != 2)
    yield "two parts", split.bins, diffusion.grid_faces(split.bins, split.edges, (2.0, 1.0)), "area"
    at = spark.createDataFrame([(float(x), float(y)) for x in range(12) for y in range(12)], "x double, y double")
    bins, edges = layouts.hex_environment(at, 1.5)
    yield "hexagons", bins, diffusion.hex_faces(edges), "area"
    bins = polar_bins(spark, (1.0, 5.0, 4), 6)
    yield "polar", bins, diffusion.polar_faces(bins, layouts.polar_edges(bins, 6), 6), "area"
    bins = track_bins(mazes.y_maze(spark, 10.0), 2.0)
    yield "track", bins, diffusion.track_faces(bins, layouts.track_edges(bins, 0.1)), "length"


def heat_matrix(bins, faces, volume, sigma):
    ids = [r.bin_id for r in bins.orderBy("bin_id").collect()]
    v = np.array([r[volume] for r in bins.orderBy("bin_id").collect()])
    w = np.zeros((len(ids), len(ids)))
    for r in faces.collect():
        w[r.src, r.dst] = r.face / r.distance
    assert np.allclose(w, w.T)  # what leaves one bin enters the other
    s = (np.diag(w.sum(1)) - w) / np.sqrt(np.outer(v, v))
    values, q = np.linalg.eigh(s)
    return (q * np.exp(-(sigma**2) / 2 * values)) @ q.T * np.sqrt(v)[None, :] / np.sqrt(v)[:, None], v


@pytest.mark.parametrize("k", range(5))
def test_heat_on_layouts(spark, k):
    name, bins, faces, volume = list(shapes(spark))[k]
    bins, faces = bins.persist(), faces.persist()
    h, v = heat_matrix(bins, faces, volume, 0.9)
    n = len(v)
    r = np.random.default_rng(k)
    fields = {"a": r.uniform(size=n), "b": np.ones(n)}
    field = spark.createDataFrame([(key, i, float(x)) for key, f in fields.items() for i, x in enumerate(f)], "key string, bin_id long, v double")
    for mass in (False, True):
        found = {}
        for row in diffusion.heat(field, bins, faces, 0.9, ["key"], volume, mass).collect():
            found.setdefault(row.key, np.zeros(n))[row.bin_id] = row.v
        for key, f in fields.items():
            assert np.allclose(found[key], v * (h @ (f / v)) if mass else h @ f, atol=1e-9), name
        if mass:
            assert found["a"].sum() == pytest.approx(fields["a"].sum())
        else:
            assert np.allclose(found["b"], 1)
    t = diffusion.diffusion_transitions(bins, faces, 0.9, volume).collect()
    p = np.zeros((n, n))
    for row in t:
        p[row.src, row.dst] = row.p
    assert np.allclose(p, h, atol=1e-9) and np.allclose(p.sum(1), 1)


def test_heat_of_any_time(spark):
    """A time that would take thousands of explicit steps."""
    g = regular_grid(spark, (0.0, 0.0), (1.0, 1.0), (6, 1))
    field = spark.createDataFrame([(0, 6.0)], "bin_id long, v double")
    out = diffusion.heat(field, g.bins, diffusion.grid_faces(g.bins, g.edges, (1.0, 1.0)), 12.0)
    assert [r.v for r in out.collect()] == pytest.approx([1.0] * 6, abs=1e-6)


def test_missing_values(spark):
    _, bins, faces, _ = list(shapes(spark))[1]
    h, v = heat_matrix(bins, faces, "area", 1.0)
    n = len(v)
    ids = {r.bin_id: r.ix for r in bins.collect()}
    values = {i: float(i) for i in range(n) if i % 3 and ids[i] < 2}  # nothing beyond the gap
    field = spark.createDataFrame([(i, values.get(i)) for i in range(n)], "bin_id long, v double")
    found = {r.bin_id: r.v for r in diffusion.diffused(field, bins, faces, 1.0).collect()}
    known = np.array([i in values for i in range(n)], dtype=float)
    smooth = h @ np.array([values.get(i, 0.0) for i in range(n)]) / np.maximum(h @ known, 1e-300)
    for i in range(n):
        assert found[i] is None if ids[i] > 2 else found[i] == pytest.approx(smooth[i])


def test_filters(spark):
    g = regular_grid(spark, (0.0, 0.0), (1.0, 1.0), (6, 5))
    lap = diffusion.graph_laplacian(g.bins, g.edges)
    m = np.zeros((30, 30))
    for r in lap.collect():
        m[r.src, r.dst] += r.w
    centers = g.bins.where("bin_id in (0, 14)").select("bin_id")
    top = diffusion.spectral_bound(lap)
    assert top >= np.linalg.eigvalsh(m)[-1]
    scaled = 2 / top * m - np.eye(30)
    polynomials = [np.eye(30), scaled]
    for _ in range(2):
        polynomials.append(2 * scaled @ polynomials[-1] - polynomials[-2])
    for r in diffusion.chebyshev_basis(centers, lap, 3).collect():
        assert r.v == pytest.approx(polynomials[r.degree][r.bin_id, r.center], abs=1e-12)
    values, q = np.linalg.eigh(m)
    wavelets = diffusion.heat_wavelets(centers, lap, (0.1, 1.5)).collect()
    assert len(wavelets) == 2 * 2 * 30
    for r in wavelets:
        assert r.v == pytest.approx(((q * np.exp(-r.scale * values)) @ q.T)[r.bin_id, r.center], abs=1e-9)


def test_series_of_a_constant():
    assert diffusion.series(lambda x: np.ones_like(x), 3.0) == pytest.approx([1.0])


@pytest.mark.parametrize("cells_at_once, times", [(250_000, 1_024), (7, 3)])
def test_decoding_in_tiles(spark, monkeypatch, cells_at_once, times):
    monkeypatch.setattr(tiles, "TILE_CELLS", cells_at_once)
    monkeypatch.setattr(tiles, "TIMES_AT_ONCE", times)
    r = np.random.default_rng(2)
    g = regular_grid(spark, (0.0, 0.0), (1.0, 1.0), (4, 5))
    rates = spark.createDataFrame([(f"u{u}", b, float(r.uniform(0, 9)) if (u + b) % 5 else None) for u in range(3) for b in range(20)], "unit string, bin_id long, rate double")
    counts = spark.createDataFrame([(t, f"u{u}", int(r.poisson(1.5)) if t else 0) for t in range(40) for u in range(3)] + [(3, "unknown", 4)], "t_idx long, unit string, n long")
    prior = spark.createDataFrame([(b, float(b + 1)) for b in range(20)], "bin_id long, p double")
    for q in (None, prior):
        expected = decoding.estimates(decoding.posterior(decoding.log_likelihood(counts, rates, 0.3), q), g.bins)
        want = {x.t_idx: x for x in expected.collect()}
        found = {x.t_idx: x for x in tiles.decode_summary(counts, rates, g.bins, 0.3, q).collect()}
        assert found.keys() == want.keys() and len(found) == 40
        for t, x in found.items():
            assert x.map_bin == want[t].map_bin
            assert [x[c] for c in expected.columns[2:]] == pytest.approx([want[t][c] for c in expected.columns[2:]], abs=1e-9)


def test_decoding_nothing(spark):
    g = regular_grid(spark, (0.0, 0.0), (1.0, 1.0), (2, 2))
    none = spark.createDataFrame([], "unit string, bin_id long, rate double")
    counts = spark.createDataFrame([(1, "a", 2)], "t_idx long, unit string, n long")
    assert tiles.decode_summary(counts, none, g.bins, 1.0).collect() == []
    assert tiles.decode_summary(counts.where("n < 0"), none.union(spark.createDataFrame([("a", 0, 1.0)], none.schema)), g.bins, 1.0).collect() == []


# Constant groups


@pytest.fixture(scope="module")
def silent(spark):
    """A unit that fires, one that never does, one at a constant rate, and one with a single bin."""
    rows = [("a", b, float(b % 4)) for b in range(12)] + [("silent", b, 0.0) for b in range(12)] + [("constant", b, 0.1) for b in range(12)] + [("one", 3, 2.0)]
    return spark.createDataFrame(rows, "unit string, bin_id long, rate double").repartition(5)


def test_correlation(spark):
    r = np.random.default_rng(0)
    x, y = r.normal(size=50), r.normal(size=50)
    rows = [("both", float(a), float(b)) for a, b in zip(x, y)] + [("both", None, 1.0), ("both", 2.0, None)] + [("flat", 0.1 + 1e-17, float(b)) for b in y] + [("pair", 1.0, 2.0), ("none", None, None)]
    d = spark.createDataFrame(rows, "k string, x double, y double").repartition(6)
    found = {r.k: r.r for r in d.groupBy("k").agg(correlation(F.col("x"), F.col("y")).alias("r")).collect()}
    assert found.pop("both") == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert found == {"flat": None, "pair": None, "none": None}


def test_measures_of_silent_units(spark, silent):
    g = regular_grid(spark, (0.0, 0.0), (1.0, 1.0), (3, 4))
    others = ("silent", "constant", "one")
    for d in (encoding.stability(silent, silent), encoding.coherence(silent, g.edges).withColumnRenamed("coherence", "r")):
        r = {x.unit: x.r for x in d.collect()}
        assert r["a"] is not None and all(r.get(u) is None for u in others)
    a, b = (g.bins.select(F.col("bin_id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")) for k in "ab")
    pairs = a.crossJoin(b).select("a", "b", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")).alias("distance"))
    rings = cells.radial_autocorrelation(silent, pairs, 1.0).collect()
    assert all(x.r is None for x in rings if x.unit != "a") and any(x.r is not None for x in rings if x.unit == "a")
    both = silent.withColumn("label", F.lit("out")).union(silent.withColumn("label", F.lit("back"))).select("label", "unit", "bin_id", "rate")
    found = {x.unit: (x.r, x.directionality) for x in cells.compare_directions(both, "out", "back").collect()}
    assert found["a"][0] == pytest.approx(1.0) and all(found[u][0] is None for u in others) and found["constant"][1] == 0
    vectors = encoding.population_vector_correlation(silent.where("unit <> 'one'"), silent.where("unit <> 'one'")).collect()
    assert len(vectors) == 12


def test_decoders_of_constants(spark):
    pairs = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.5), ("b", "c", 0.5)], "unit_a string, unit_b string, r double")
    assert decoding.explained_variance(pairs, pairs, pairs).first().ev is None
    still = spark.createDataFrame([(t, 5.0, 5.0, 0.3) for t in range(9)], "t_idx long, mean_x double, mean_y double, peak double")
    where = spark.createDataFrame([(t, float(t), 2.0) for t in range(9)], "t_idx long, x double, y double")
    assert decoding.decoding_correlation(still, where).first().r is None
    assert decoding.decoding_correlation(still.limit(0), where).first().r is None


def test_phases_of_constants(spark):
    rows = [("still", 1.0, 0.1 * k) for k in range(12)] + [("locked", float(k), 1.0) for k in range(12)] + [("runs", float(k), (-0.4 * k) % (2 * math.pi)) for k in range(12)]
    d = spark.createDataFrame(rows, "unit string, position double, phase double").repartition(4)
    found = {r.unit: r for r in cells.phase_precession(d, (-1.0, 1.0, 41)).collect()}
    assert found["still"].correlation is None and found["locked"].correlation is None and found["runs"].precesses
    r = d.groupBy("unit").agg(circular_linear_r(F.col("phase"), F.col("position")).alias("r")).collect()
    assert {x.unit: x.r is None for x in r} == {"still": True, "locked": True, "runs": False}


def test_polar_ring_width(spark):
    bins = grids.polar_bins(spark, (2.0, 8.0, 3), 8)
    faces = {(r.src, r.dst): (r.face, r.distance) for r in diffusion.polar_faces(bins, layouts.polar_edges(bins, 8), 8).collect()}
    turn = 2 * math.pi / 8
    assert faces[0, 1] == pytest.approx((2.0, 3.0 * turn)) and faces[7, 0] == pytest.approx((2.0, 3.0 * turn)) and faces[0, 8] == pytest.approx((4.0 * turn, 2.0))
