"""What is seen, followed where the observer's row is, against steps joined to bins."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import grid as grids
from gridloom.operators import visibility

SCHEMA = "idx long, x double, y double, heading double"


def observers(spark):
    draw = random.Random(3)
    rows = [(i, draw.uniform(-5, 45), draw.uniform(-5, 35), draw.uniform(-math.pi, math.pi)) for i in range(60)]
    return spark.createDataFrame(rows + [(60, None, 1.0, 0.0), (61, 5.0, 5.0, None), (62, float("nan"), 5.0, 0.0), (63, 5.0, 5.0, float("nan"))], SCHEMA)


def arena(spark):
    places = spark.createDataFrame([(x + 0.5, y + 0.5) for x in range(0, 40, 5) for y in range(0, 30, 5) if (x * 7 + y * 3) % 11 > 1], "x double, y double")
    return grids.regular_grid(spark, (0.0, 0.0), (5.0, 5.0), (8, 6), places)


def test_views_against_plain_steps_and_the_join(spark, monkeypatch):
    g, d = arena(spark), observers(spark)
    active = {(r.ix, r.iy): r.bin_id for r in g.bins.collect()}
    expected = set()
    for r in d.collect():
        if None in tuple(r) or any(v != v for v in r):
            continue
        for ray in range(7):
            angle = r.heading + (-0.8 + (ray + 0.5) * (1.6 / 7))
            for k in range(15):
                s = k * (30.0 / 15)
                b = active.get((math.floor((r.x + s * math.cos(angle)) / 5), math.floor((r.y + s * math.sin(angle)) / 5)))
                if b is None:
                    break
                expected.add((r.idx, b))
    monkeypatch.setattr(visibility, "STEPS_AT_ONCE", 7 * 15 * 9)
    seen = visibility.viewshed(d, g, 7, 0.8, 30.0, 15)
    assert seen.columns == ["idx", "x", "y", "heading", "bin_id"]
    assert sorted((r.idx, r.bin_id) for r in seen.collect()) == sorted(expected)
    monkeypatch.setattr(grids, "BROADCAST_BINS", 10)
    joined = visibility.viewshed(d, g, 7, 0.8, 30.0, 15)
    assert sorted((r.idx, r.bin_id) for r in joined.collect()) == sorted(expected)


@pytest.mark.parametrize("of", ["viewshed", "view_occupancy"])
def test_no_step_of_a_ray_is_shuffled(spark, of):
    g, d = arena(spark), observers(spark)
    if of == "viewshed":
        found = visibility.viewshed(d, g, 7, 0.8, 30.0, 15)
    else:
        found = visibility.view_occupancy(d.withColumns({"session": F.lit(0), "t": F.col("idx").cast("double")}), g, 7, 0.8, 30.0, 15)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Window [min" not in plan and plan.count("Join") == 0
