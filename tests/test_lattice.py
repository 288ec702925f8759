"""Peaks of planted lattices, profiles, meshes, composite environments."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import composite, diffusion, lattice, mesh
from gridloom.operators.grid import regular_grid


def hexagonal(x, y, spacing, degrees):
    k = 4 * math.pi / (math.sqrt(3) * spacing)
    return sum(math.cos(k * (x * math.cos(a) + y * math.sin(a))) for a in (math.radians(degrees + 30 + 60 * i) for i in range(3)))


@pytest.mark.parametrize("spacing, degrees", [(12.0, 0.0), (12.0, 20.0), (15.0, 47.0)])
def test_planted_lattices(spark, spacing, degrees):
    g = regular_grid(spark, (0.0, 0.0), (1.0, 1.0), (40, 40))
    bins = g.bins.collect()
    rows = [("grid", b.bin_id, 3 + hexagonal(b.x, b.y, spacing, degrees)) for b in bins] + [("silent", b.bin_id, 0.0) for b in bins] + [("hole", b.bin_id, None if 5 < b.x < 15 else 3 + hexagonal(b.x, b.y, spacing, degrees)) for b in bins]
    rates = spark.createDataFrame(rows, "unit string, bin_id long, rate double")
    found = lattice.peaks(lattice.autocorrelogram(rates, g), (40, 40), (1.0, 1.0), apart=3)
    p = {r.unit: r for r in lattice.grid_properties(found).collect()}
    assert p.keys() == {"grid", "hole"}
    for r in p.values():
        turned = (r.orientation - degrees + 30) % 60 - 30
        assert r.n_peaks == 6 and r.scale == pytest.approx(spacing, abs=0.6) and abs(turned) < 2.5 and r.orientation_std < 4
        assert r.major == pytest.approx(spacing, abs=1) and r.minor == pytest.approx(spacing, abs=1)


def test_correlogram_of_constants(spark):
    g = regular_grid(spark, (0.0, 0.0), (1.0, 1.0), (6, 6))
    rates = spark.createDataFrame([("flat", b, 0.1) for b in range(36)], "unit string, bin_id long, rate double")
    d = lattice.autocorrelogram(rates, g)
    assert d.where("r is not null").count() == 0 and d.count() > 0
    assert lattice.peaks(d, (6, 6), (1.0, 1.0)).count() == 0


def test_profile_peaks(spark):
    wave = [(k, math.cos(2 * math.pi * k / 8) + 0.01 * k) for k in range(36)]
    small = [(k, v + (0.02 if k % 2 else 0.0)) for k, v in wave]  # ripples that stand out by little
    rows = [("even", k, v) for k, v in wave] + [("ripples", k, v) for k, v in small] + [("falls", k, -float(k)) for k in range(9)] + [("nulls", k, None) for k in range(4)]
    d = spark.createDataFrame(rows, "unit string, ring long, r double")
    rings = {}
    for r in lattice.profile_peaks(d).collect():
        rings.setdefault(r.unit, set()).add(r.ring)
    assert rings["even"] == {8, 16, 24, 32} and len(rings["ripples"]) == 4 and set(rings) == {"even", "ripples"}
    found = {r.unit: (r.n_peaks, r.score) for r in lattice.periodicity(d).collect()}
    assert found["even"] == (4, 1.0) and found["falls"] == (0, None) and found["nulls"] == (0, None)


# Meshes


def circles_are_empty(points, triangles):
    at = {i: (x, y) for i, x, y in points}
    for t in triangles:
        (ax, ay), (bx, by), (cx, cy) = (at[t[k]] for k in "abc")
        d = 2 * ((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
        u, v = (bx - ax) ** 2 + (by - ay) ** 2, (cx - ax) ** 2 + (cy - ay) ** 2
        ox, oy = ax + ((cy - ay) * u - (by - ay) * v) / d, ay + ((bx - ax) * v - (cx - ax) * u) / d
        r = math.hypot(ox - ax, oy - ay)
        assert all(math.hypot(x - ox, y - oy) > r - 1e-6 for x, y in at.values())


def test_delaunay_of_scattered_points(spark):
    r = np.random.default_rng(3)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(r.uniform(0, 10, (150, 2)))]
    frame = spark.createDataFrame([*points, (900, *points[5][1:])], "id long, x double, y double").repartition(4)
    triangles = mesh.delaunay(frame, 4.0).collect()
    circles_are_empty(points, triangles)
    # All small circles of brute force, and no other.
    every = set()
    for a in range(150):
        for b in range(a + 1, 150):
            for c in range(b + 1, 150) if math.dist(points[a][1:], points[b][1:]) < 3 else ():
                if math.dist(points[a][1:], points[c][1:]) < 3 and math.dist(points[b][1:], points[c][1:]) < 3:
                    every.add((a, b, c))
    small = {(t.a, t.b, t.c) for t in triangles} & every
    at = np.array([p[1:] for p in points])
    for t in every - small:
        (ax, ay), (bx, by), (cx, cy) = at[list(t)]
        d = 2 * ((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
        u, v = (bx - ax) ** 2 + (by - ay) ** 2, (cx - ax) ** 2 + (cy - ay) ** 2
        o = np.array([ax + ((cy - ay) * u - (by - ay) * v) / d, ay + ((bx - ax) * v - (cx - ax) * u) / d])
        radius = np.hypot(*(o - at[t[0]]))
        others = np.delete(at, list(t), 0)
        assert radius > 4.0 or np.hypot(*(others - o).T).min() < radius


def test_mesh_of_a_lattice(spark):
    """Four points on each circle: the triangles still cover the square once."""
    square = [(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0)]
    points = mesh.lattice_points(spark, square, 1.0)
    assert points.count() == 49
    bins, faces = mesh.mesh(points, 1.0)
    bins, faces = bins.persist(), faces.persist()
    assert bins.count() == 72 and bins.agg(F.sum("area")).first()[0] == pytest.approx(36.0)
    assert faces.count() == 2 * (72 * 3 - 24) // 2
    spots = [(i, 0.01 + 0.37 * i % 6.5, 0.02 + 0.53 * i % 6.5) for i in range(300)] + [(1000, 1.0, 1.0), (1001, -1.0, 2.0)]
    found = {r.id: r.bin_id for r in mesh.mesh_bin_at(spark.createDataFrame(spots, "id long, x double, y double"), bins, 1.7).collect()}
    corners = {b.bin_id: ((b.ax, b.ay), (b.bx, b.by), (b.cx, b.cy)) for b in bins.collect()}
    for i, x, y in spots:
        inside = []
        for k, t in corners.items():
            s = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for (ax, ay), (bx, by) in zip(t, (*t[1:], t[0]))]
            if min(s) >= 0 or max(s) <= 0:
                inside.append(k)
        assert found[i] == min(inside, default=-1)
    counts = spark.createDataFrame([(7, 5.0)], "bin_id long, v double")
    spread = diffusion.heat(counts, bins, faces, 1.0, mass=True)
    assert spread.agg(F.sum("v")).first()[0] == pytest.approx(5.0)
    # Right triangles: across the diagonal the centers' line is upright, across the legs it isn't.
    assert 0 < mesh.skewed_share(bins, faces, 10.0).first()[0] < 1 and mesh.skewed_share(bins, faces, 60.0).first()[0] == 0


def test_mesh_inside_a_polygon_and_of_nothing(spark):
    points = mesh.lattice_points(spark, [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)], 0.5)
    bins, _ = mesh.mesh(points, 0.5, F.col("x") + F.col("y") < 2)
    assert all(b.x + b.y < 2 for b in bins.collect())
    assert mesh.delaunay(points.limit(2), 1.0).count() == 0 and mesh.delaunay(points.limit(0), 1.0).count() == 0


# Composite environments


def test_composite(spark):
    left = regular_grid(spark, (0.0, 0.0), (1.0, 1.0), (3, 2))
    right = regular_grid(spark, (4.0, 0.0), (1.0, 1.0), (2, 2))
    whole = composite.compose([left, right], 3.0)
    assert whole.offsets == [0, 6] and whole.bins.count() == 10
    assert {(r.src, r.dst) for r in whole.bridges.collect()} == {(4, 6), (5, 7)}
    at = spark.createDataFrame([(0, 0.5, 0.5), (1, 4.5, 1.5), (2, 3.5, 0.5), (3, None, 1.0)], "id long, x double, y double")
    assert {r.id: r.bin_id for r in composite.composite_bin_at(at, whole).collect()} == {0: 0, 1: 7, 2: -1, 3: -1}
    assert [tuple(r) for r in composite.bridges_between(whole).collect()] == [(0, 1, 2)]
    assert composite.compose([left, right]).bridges.count() == 0
