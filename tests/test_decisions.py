"""Goals and boundaries, verdicts, nearest bins, fields within fields."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import decisions, nearest, place_fields
from gridloom.operators.encoding import mutual_information
from gridloom.operators.grid import regular_grid, track_bins
from gridloom.sources import mazes


def test_boundary_between_goals(spark):
    g = regular_grid(spark, (0.0, 0.0), (1.0, 1.0), (7, 1))
    goals = {"left": g.bins.where("bin_id = 0"), "right": g.bins.where("bin_id = 6")}
    found = {r.bin_id: (r.goal, r.nearest, r.margin) for r in decisions.goal_distances(g.edges, goals).collect()}
    assert found[0] == ("left", 0.0, 6.0) and found[3] == ("left", 3.0, 0.0) and found[5] == ("right", 1.0, 4.0)
    alone = decisions.goal_distances(g.edges, {"left": goals["left"]}).collect()
    assert {r.margin for r in alone} == {None}
    with pytest.raises(ValueError):
        decisions.goal_distances(g.edges, {})


def test_analysis_and_verdicts(spark):
    pre = spark.createDataFrame([(1, 0.8, 2.0), (2, 0.8, 20.0)], "session long, variance double, mean_speed double")
    near = spark.createDataFrame([(1, 4.0), (1, 2.0), (2, None), (3, 1.0)], "session long, margin double")
    crossings = spark.createDataFrame([(1,), (1,)], "session long")
    found = {r.session: (r.suggests_deliberation, r.n_crossings, r.mean_margin) for r in decisions.decision_analysis(pre, near, crossings).collect()}
    assert found == {1: (True, 2, 3.0), 2: (False, 0, None), 3: (None, 0, 1.0)}
    e = spark.createDataFrame([(1, 0.9), (2, None)], "session long, efficiency double")
    b = spark.createDataFrame([(1, 0.1), (3, 0.5)], "session long, bias double")
    told = {r.session: (r.is_efficient, r.is_goal_directed) for r in decisions.path_verdicts(e, b).collect()}
    assert told == {1: (True, False), 2: (False, False), 3: (False, True)}


def test_trial_ends(spark):
    trials = spark.createDataFrame([(1, 10.0, 25.0, "left"), (1, 30.0, 31.0, "timeout"), (2, 0.0, 5.0, "right")], "session long, start_t double, stop_t double, outcome string")
    s = spark.createDataFrame([(1, t) for t in (9.9, 10.0, 24.0, 25.0, 30.5)] + [(2, 4.0)], "session long, t double")
    found = {(r.session, r.t): (r.start_bin, r.goal_bin) for r in decisions.trial_ends(s, trials, 0, {"left": 5, "right": 6}, 7.0).collect()}
    assert found == {(1, 9.9): (-1, -1), (1, 10.0): (0, 5), (1, 24.0): (0, 5), (1, 25.0): (-1, -1), (1, 30.5): (0, -1), (2, 4.0): (0, 6)}


def test_linear_bins(spark):
    bins = track_bins(mazes.linear(spark, 10.0), 2.0)
    at = [(-0.1, -1), (0.0, 0), (1.99, 0), (2.0, 1), (9.0, 4), (10.0, 4), (10.1, -1), (None, -1)]
    d = decisions.linear_bin_at(spark.createDataFrame([(p,) for p, _ in at], "position double"), bins, 1.5)
    assert {r.position: r.bin_id for r in d.collect()} == dict(at)


def test_operator_makes_the_laplacian(spark):
    g = regular_grid(spark, (0.0, 0.0), (2.0, 1.0), (3, 3))
    d = np.zeros((9, g.edges.count() // 2))
    for r in decisions.differential_operator(g.bins, g.edges).collect():
        d[r.bin_id, r.edge_id] = r.v
    w = np.zeros((9, 9))
    for r in g.edges.collect():
        w[r.src, r.dst] = r.distance
    assert np.allclose(d @ d.T, np.diag(w.sum(1)) - w)


def test_spread_out_points(spark):
    g = regular_grid(spark, (0.0, 0.0), (1.0, 1.0), (5, 5))
    assert decisions.farthest_points(g.bins, 4) == [0, 24, 4, 20]
    assert decisions.farthest_points(g.bins.limit(2), 9) == [0, 1] and decisions.farthest_points(g.bins.limit(0), 3) == []


def test_scores(spark):
    e = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, None), (3, 9.0)], "t_idx long, error double")
    assert tuple(decisions.decoder_score(e).first()) == (2.0, 3, 1) and decisions.decoder_score(e, "mean").first().score == 4.0
    with pytest.raises(ValueError):
        decisions.decoder_score(e, "best")
    t = spark.createDataFrame([(1, 2.0, True), (2, 4.0, False)], "trial long, sweep double, deliberate boolean")
    assert tuple(decisions.deliberation_summary(t).first()) == (2, 1, 3.0, 1.0, 0.5)


def test_mutual_information(spark):
    rows = [("a", 0, 1.0, 4.0), ("a", 1, 3.0, 0.0), ("flat", 0, 1.0, 2.0), ("flat", 1, 3.0, 2.0), ("silent", 0, 1.0, 0.0), ("a", 2, 0.0, None)]
    d = spark.createDataFrame(rows, "unit string, bin_id long, seconds double, rate double")
    found = {r.unit: r.bits for r in mutual_information(d).collect()}
    assert found["a"] == pytest.approx(0.25 * 4 * math.log2(4)) and found["flat"] == pytest.approx(0.0, abs=1e-12) and found["silent"] is None


@pytest.mark.parametrize("seed, n_bins", [(0, 60), (1, 3), (2, 1), (3, 400)])
def test_nearest_bin(spark, seed, n_bins):
    """Uneven bins, points among them and very far away."""
    r = np.random.default_rng(seed)
    bins = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate((r.normal(0, 1, (n_bins, 2)), r.normal(50, 0.01, (n_bins // 2, 2)))))]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate((r.normal(0, 2, (150, 2)), r.uniform(-1e4, 1e4, (40, 2)), r.uniform(-60, 60, (80, 2)))))]
    points += [(900, float("nan"), 0.0), (901, None, 1.0), (902, float("inf"), 1.0), (903, 1e9, -1e9)]
    found = {p.id: p.bin_id for p in nearest.nearest_bin(spark.createDataFrame(points, "id long, x double, y double").repartition(3), spark.createDataFrame(bins, "bin_id long, x double, y double")).collect()}
    assert len(found) == len(points)
    for i, x, y in points:
        if x is None or not math.isfinite(x):
            assert found[i] == -1
            continue
        assert found[i] == min((round(math.hypot(x - a, y - b), 9), k) for k, a, b in bins)[1]


def test_nearest_of_none(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    assert nearest.nearest_bin(points, spark.createDataFrame([], "bin_id long, x double, y double")).first().bin_id == -1
    assert nearest.nearest_bin(points.limit(0), points.withColumnRenamed("id", "bin_id")).count() == 0


def bumps(bins, *at):
    return {b.bin_id: sum(h * math.exp(-((b.x - x) ** 2 + (b.y - y) ** 2) / (2 * w * w)) for x, y, h, w in at) for b in bins}


def test_fields_within_fields(spark):
    g = regular_grid(spark, (0.0, 0.0), (1.0, 1.0), (24, 12))
    bins = g.bins.collect()
    maps = {
        "one": bumps(bins, (6, 6, 8, 2)),
        "saddle": bumps(bins, (7, 6, 8, 1.8), (13, 6, 8, 1.8)),  # one field at a fifth of the peak, two at half
        "two": bumps(bins, (4.5, 6.5, 8, 1.5), (19.5, 6.5, 8, 1.5)),
        "tiny": bumps(bins, (6, 6, 8, 0.4)),
        "fast": {b.bin_id: 20.0 for b in bins},
        "silent": {b.bin_id: 0.0 for b in bins},
    }
    rates = spark.createDataFrame([(u, b, v if (u, b) != ("one", 0) else None) for u, m in maps.items() for b, v in m.items()], "unit string, bin_id long, rate double")
    fields = {}
    for r in place_fields.place_fields(rates, g.edges).collect():
        fields.setdefault((r.unit, r.field), set()).add(r.bin_id)
    count = lambda u: sum(k[0] == u for k in fields)
    assert (count("one"), count("saddle"), count("two"), count("tiny"), count("fast"), count("silent")) == (1, 2, 2, 0, 0, 0)
    peak = max(maps["one"].values())
    assert fields["one", 0] == {b for b, v in maps["one"].items() if v >= 0.2 * peak and b}
    assert fields["saddle", 0].isdisjoint(fields["saddle", 1])
    whole = {}
    for r in place_fields.place_fields(rates, g.edges, levels=()).collect():
        whole.setdefault((r.unit, r.field), set()).add(r.bin_id)
    assert sum(k[0] == "saddle" for k in whole) == 1 and fields["saddle", 0] | fields["saddle", 1] < whole["saddle", 0]
    assert {r.unit: r.fast for r in place_fields.fast_units(rates).collect()}["fast"]
    assert place_fields.place_fields(rates.where(F.col("unit") == "none"), g.edges).count() == 0
