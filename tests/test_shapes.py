"""Mazes, simulated sessions, affine maps, fields of view and shuffles: against what their shapes tell."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import affine
from gridloom.operators import cells, encoding, grid as grids, layouts, navigation, visibility
from gridloom.sources import mazes, sessions


@pytest.mark.parametrize(("maze", "n", "length"), [
    (lambda s: mazes.y_maze(s, 50.0), 3, 150.0), (lambda s: mazes.repeated_y(s, 3, 20.0, 10.0), 9, 120.0), (lambda s: mazes.comb(s, 3, 40.0, 60.0, 15.0), 11, 350.0),
    (lambda s: mazes.lattice(s, 3, 2, 30.0), 7, 210.0), (lambda s: mazes.rings(s, [40.0, 80.0], 6, 6), 18, 6 * 40.0 + 6 * 80.0 + 6 * 40.0),
    (lambda s: mazes.rings(s, [40.0, 80.0], 1, 6, [0, 3]), 11, 5 * 40.0 + 5 * 80.0 + 40.0), (lambda s: mazes.honeycomb(s, 1, 25.0), 12, 300.0),
])
def test_mazes_are_connected(spark, maze, n, length):
    d = maze(spark)
    size = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    assert d.count() == n and abs(d.agg(F.sum(size)).first()[0] - length) < 1e-6
    bins = grids.track_bins(d, 5.0)
    links = [(r.src, r.dst) for r in layouts.track_edges(bins, 0.1).collect()]
    assert {(b, a) for a, b in links} == set(links)
    reached, grown = set(), {0}
    while grown != reached:
        reached, grown = grown, grown | {b for a, b in links if a in grown}
    assert reached == set(range(bins.count()))


def test_round_arenas():
    pool, regions = mazes.watermaze()
    assert len(pool) == 64 and set(regions) == {"platform", "quadrant_ne", "quadrant_nw", "quadrant_sw", "quadrant_se"}
    assert len(mazes.barnes()[1]) == 18 and "escape" in mazes.barnes()[1]
    assert all(math.hypot(*p) <= 55 for p in mazes.cheeseboard()[1].values())
    assert sorted(mazes.corridor((0, 0), (10, 0), 4)) == [(0, -2), (0, 2), (10, -2), (10, 2)] and mazes.square(3)[2] == (3, 3)


def test_to_linear_and_back(spark):
    track = mazes.star(spark, 4, 50.0)
    rows = spark.range(40).select((F.col("id") * 5.0 + 1).alias("position"))
    back = layouts.to_linear(layouts.from_linear(rows, track).withColumnRenamed("position", "was"), track)
    assert all(abs(r.was - r.position) < 1e-9 and r.offset < 1e-9 for r in back.collect())


def test_sessions_tell_their_cells(spark):
    s = sessions.direction_cells(spark, duration=60.0, n_cells=4, dt=0.05)
    tuning = encoding.directional_tuning(s.spikes, s.samples.select("session", "idx", "t", "heading"), 12)
    found = {r.unit: r for r in cells.direction_cells(tuning, 12).collect()}
    for k in range(4):
        off = (found[k].preferred - k * math.pi / 2 + math.pi) % (2 * math.pi) - math.pi
        assert found[k].head_direction and abs(off) < 0.5 and abs(found[k].length - sessions.mean_vector_length(3.0)) < 0.15
    assert abs(sessions.mean_vector_length(3.0) - 0.8100) < 1e-3


@pytest.mark.parametrize("make", [sessions.open_field, sessions.linear_track, sessions.boundary_cells, sessions.grid_cells])
def test_sessions_repeat_and_fill_their_arena(spark, make):
    a, b = (make(spark, duration=30.0, dt=0.1) for _ in range(2))
    assert a.samples.count() == 300
    assert sorted(map(tuple, a.spikes.collect())) == sorted(map(tuple, b.spikes.collect())) != []
    assert grids.bin_at(a.samples, a.grid).where("bin_id < 0").count() == 0


def test_alternation(spark):
    s = sessions.t_alternation(spark, n_trials=4, dt=0.1)
    ends = s.samples.groupBy("trial").agg(F.max_by("x", "t").alias("x")).orderBy("trial").collect()
    assert [r.x > 0 for r in ends] == [False, True, False, True] and s.spikes.count() > 0


def test_affine_fits():
    r = np.random.default_rng(0)
    a = r.normal(size=(20, 2))
    turn = np.array([[math.cos(0.7), -math.sin(0.7)], [math.sin(0.7), math.cos(0.7)]])
    for kind, m in (("rigid", turn), ("similarity", 2.5 * turn), ("affine", np.array([[1.0, 0.5], [0.2, 3.0]]))):
        found = affine.fit(a, a @ m.T + [3, -1], kind).matrix
        assert np.allclose(found[:2, :2], m) and np.allclose(found[:2, 2], [3, -1])
    m = affine.translate(1.0, 2.0) @ affine.scale(3.0)
    assert np.allclose((m @ m.inverse()).matrix, np.eye(3)) and np.allclose(affine.identity(3).matrix, np.eye(4))
    c = affine.by_scale(0.25, (640, 480))
    assert c.cm_per_px == 0.25 and affine.Calibration.from_dict(c.as_dict()).frame == (640, 480)
    for bad in (lambda: affine.rotation([[2.0, 0.0], [0.0, 1.0]]), lambda: affine.by_scale_bar((0, 0), (0, 0), 1.0, (1, 1)), lambda: affine.by_landmarks([(0, 0), (1, 1), (2, 2)], [(0, 0), (1, 1), (2, 2)], (9, 9)), lambda: affine.Affine([[1, 0], [1, 1]])):
        with pytest.raises(ValueError):
            bad()


def test_fields_of_view(spark):
    d = spark.range(360).select(F.radians(F.col("id") - 179.5).alias("b"))
    rat, primate = (visibility.ANIMALS[k] for k in ("rat", "primate"))
    seen = d.agg(F.count_if(rat.sees(F.col("b"))), F.count_if(rat.both_eyes(F.col("b"))), F.count_if(primate.sees(F.col("b")))).first()
    assert list(seen) == [320, 50, 180]
    g = grids.regular_grid(spark, (0.0, 0.0), (10.0, 10.0), (10, 10))
    shed = visibility.viewshed(spark.createDataFrame([(0, 50.0, 50.0, 0.0)], "idx int, x double, y double, heading double"), g, 64, math.pi, 200.0)
    assert visibility.visible_share(shed, g, ["idx"]).first().share == 1.0


def test_shuffles_keep_each_map(spark):
    g = grids.regular_grid(spark, (0.0, 0.0), (1.0, 1.0), (4, 3))
    rates = g.bins.select(F.lit("a").alias("unit"), "bin_id", F.col("bin_id").cast("double").alias("rate"))
    moved = navigation.shifted_place_fields(rates, g.bins, (4, 3), 3).collect()
    for k in range(3):
        at = {(r.ix, r.iy): r.rate for r in moved if r.shuffle == k}
        assert sorted(at.values()) == [float(v) for v in range(12)]
        assert len({(at[i, j] - at[i, (j + 1) % 3]) % 3 for i in range(4) for j in range(3)}) == 1
    post = spark.createDataFrame([(t, b, float(b == (0 if t % 2 else 10))) for t in range(6) for b in range(21)], "t_idx int, bin_id int, p double")
    peaks = [(r.t_idx, r.bin_id) for r in navigation.weighted_shift(post, 21, 3, 20).where("p = 1").collect()]
    assert len(peaks) == 120 and all(b <= 3 or b >= 18 for t, b in peaks if t % 2) and len({b for t, b in peaks if t % 2 == 0}) > 10


def test_modulation_and_empty_input(spark):
    d = spark.createDataFrame([(1.0, 0.0, 0.01, 0.01, 0.0), (0.1, 0.0, 0.01, 0.01, 0.0), (1.0, 0.0, 4.0, 4.0, 0.0), (1.0, 0.0, 0.0, 0.0, 0.0)], "s double, c double, vs double, vc double, cov double")
    assert [r[0] for r in d.select(cells.circular_modulation(*[F.col(c) for c in d.columns])).collect()] == [True, False, False, False]
    none = spark.createDataFrame([], "session long, idx long, t double, x double, y double")
    assert navigation.goal_directed(none, (0.0, 0.0), 1.0).collect() == [] and navigation.angular_efficiency(none).collect() == []
    assert layouts.hex_environment(none, 5.0)[0].collect() == []
