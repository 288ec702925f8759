"""Outlines of planted and drawn masks, and regions made larger and smaller."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import outlines, regions


def test_planted_rings(spark):
    ring = [("ring", i, j) for i in range(5) for j in range(4) if (i, j) not in {(1, 1), (2, 1), (3, 2)}]
    rows = [("one", -2, 3), ("one", -2, 3), ("one", None, 3), (None, 1, 1), ("corner", 0, 0), ("corner", 1, 1), *ring, *[("bar", i, 0) for i in range(9)]]
    mask = spark.createDataFrame(rows, "k string, ix int, iy int")
    got = {}
    for r in outlines.outlines(mask, (10.0, 0.0), (2.0, 1.0), by=("k",)).collect():
        got.setdefault(r.k, []).append(r)
    assert got.keys() == {"one", "corner", "ring", "bar"}
    (one,) = got["one"]
    assert [tuple(v) for v in one.verts] == [(6.0, 3.0), (8.0, 3.0), (8.0, 4.0), (6.0, 4.0)] and (one.area, one.length, one.hole, one.n_corners) == (2.0, 6.0, False, 4)
    assert [(r.x, r.y, r.area) for r in sorted(got["corner"])] == [(10.0, 0.0, 2.0), (12.0, 1.0, 2.0)]
    (bar,) = got["bar"]
    assert (bar.n_corners, bar.length, bar.area) == (4, 38.0, 18.0)
    holes = [r for r in got["ring"] if r.hole]
    outer = [r for r in got["ring"] if not r.hole]
    assert [(r.x, r.y, r.area) for r in outer] == [(10.0, 0.0, 40.0)]
    # Holes that touch at a corner are one ring, as the mask does not go through there.
    assert sum(r.area for r in holes) == -6.0 and len(holes) == 1 and holes[0].n_corners == 8
    assert outlines.outlines(mask.where("false"), (0.0, 0.0), (1.0, 1.0)).collect() == []


def winding(p, rings):
    """How often rings go round a point, by angles."""
    total = 0.0
    for ring in rings:
        for a, b in zip(ring, [*ring[1:], ring[0]]):
            t = math.atan2(b[1] - p[1], b[0] - p[0]) - math.atan2(a[1] - p[1], a[0] - p[0])
            total += (t + math.pi) % (2 * math.pi) - math.pi
    return round(total / (2 * math.pi))


def test_rings_hold_the_mask_and_nothing_else(spark):
    r = random.Random(5)
    cells = {(i, j) for i in range(14) for j in range(14) if r.random() < 0.6}
    mask = spark.createDataFrame(sorted(cells), "ix int, iy int")
    found = outlines.outlines(mask, (0.0, 0.0), (1.0, 1.0)).collect()
    rings = [[tuple(v) for v in f.verts] for f in found]
    for i in range(-1, 15):
        for j in range(-1, 15):
            assert winding((i + 0.5, j + 0.5), rings) == ((i, j) in cells)
    assert sum(f.area for f in found) == len(cells)
    for f in found:
        twice = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(f.verts, [*f.verts[1:], f.verts[0]]))
        assert twice / 2 == f.area and (f.area < 0) == f.hole
        assert f.length == sum(math.dist(a, b) for a, b in zip(f.verts, [*f.verts[1:], f.verts[0]]))
        assert (f.x, f.y) == min(tuple(v) for v in f.verts)


@pytest.mark.parametrize("reach, area", [(2.0, 100 + 40 * 2 + math.pi * 4), (-3.0, 16.0), (-6.0, 0.0), (0.0, 100.0)])
def test_area_of_buffers(spark, reach, area):
    n = 200
    points = spark.range(n * n).select((F.floor(F.col("id") / n) * 0.1 - 4.97).alias("x"), (F.col("id") % n * 0.1 - 4.97).alias("y"))
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    held = points.where(regions.buffered(F.col("x"), F.col("y"), square, reach)).count()
    assert held * 0.01 == pytest.approx(area, abs=1.0)
    around = points.where(regions.buffered(F.col("x"), F.col("y"), (5.0, 5.0), reach)).count()
    assert around * 0.01 == pytest.approx(math.pi * reach * reach if reach > 0 else 0.0, abs=0.2)
