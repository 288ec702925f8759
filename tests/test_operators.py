"""Operators on small tables: stretches of time, ties, empty inputs, and brute-force results."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import angles, binning, geometry
from gridloom.operators import behavior, decoding, encoding, events, fields, grid, regions, stats, trajectory
from gridloom.operators import timeseries as ts
from gridloom.sources import simulate, tables


@pytest.fixture(scope="module")
def walk(spark):
    r = random.Random(1)
    rows = [(s, i, float(r.randrange(200)), r.random() * 100, r.random() * 50) for s in range(3) for i in range(s * 100, s * 100 + (90 if s else 5))]
    return spark.createDataFrame(rows, "session int, idx long, t double, x double, y double").cache()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("span", [1.0, 17.0, 1000.0])
def test_stretches_change_nothing(spark, walk, span):
    keys, order = ["session"], ["t", "idx"]
    same(ts.with_next(walk, keys, order, ["x"], span), ts.with_next(walk, keys, order, ["x"]))
    same(ts.with_previous(walk, keys, order, ["x"], span), ts.with_previous(walk, keys, order, ["x"]))
    total = lambda s: ts.running_sum(walk, keys, order, F.col("idx"), "total", s)
    same(total(span), total(None))
    right = walk.where("idx % 3 = 0").select("session", "t", "idx")
    left = walk.where("idx % 3 = 1").select("session", "t", F.col("idx").alias("k"))
    for backward in (True, False):
        for strict in (True, False):
            same(ts.asof(left, right, keys, "t", ["idx"], "p_", backward, strict, span), ts.asof(left, right, keys, "t", ["idx"], "p_", backward, strict))


@pytest.mark.parametrize(("backward", "strict"), [(True, False), (True, True), (False, False), (False, True)])
def test_asof_against_brute_force(spark, walk, backward, strict):
    rows = walk.collect()
    left = walk.where("idx % 2 = 0").select("session", "t", F.col("idx").alias("k"))
    right = walk.where("idx % 2 = 1").select("session", "t", "idx")
    for r in ts.asof(left, right, ["session"], "t", ["t", "idx"], "p_", backward, strict, 20.0).collect():
        seen = [(o.t, o.idx) for o in rows if o.session == r.session and o.idx % 2 == 1]
        if backward:
            seen = [o for o in seen if (o[0] < r.t if strict else o[0] <= r.t)]
        else:
            seen = [o for o in seen if (o[0] > r.t if strict else o[0] >= r.t)]
        assert (r.p_t, r.p_idx) == ((max if backward else min)(seen) if seen else (None, None))


@pytest.mark.parametrize("closed", ["both", "left", "right", "neither"])
def test_interval_join(spark, closed):
    points = spark.createDataFrame([(float(i),) for i in range(20)], "t double")
    spans = spark.createDataFrame([(2.0, 5.0), (5.0, 5.0), (7.5, 30.0), (9.0, 8.0)], "a double, b double")
    found = {(r.t, r.a) for r in ts.interval_join(points, spans, "t", "a", "b", 3.0, closed=closed).collect()}
    low = lambda t, a: t >= a if closed in ("both", "left") else t > a
    high = lambda t, b: t <= b if closed in ("both", "right") else t < b
    assert found == {(float(t), a) for t in range(20) for a, b in ((2.0, 5.0), (5.0, 5.0), (7.5, 30.0)) if low(t, a) and high(t, b)}


def holed(spark):
    g = grid.regular_grid(spark, (0.0, 0.0), (1.0, 1.0), (6, 6))
    return grid.subset(g, ~((F.col("ix") == 2) & (F.col("iy") < 5)) & ~((F.col("ix") == 4) & (F.col("iy") > 0)))


def test_geodesic_distance_is_dijkstra(spark):
    g = holed(spark)
    edges = [(r.src, r.dst, r.distance) for r in g.edges.collect()]
    best, queue = {0: 0.0}, [(0.0, 0)]
    while queue:
        d, u = heapq.heappop(queue)
        if d > best[u]:
            continue
        for s, v, w in edges:
            if s == u and d + w < best.get(v, math.inf) - 1e-12:
                best[v] = d + w
                heapq.heappush(queue, (d + w, v))
    found = {r.bin_id: r.distance for r in fields.distance_field(g.edges, g.bins.where("bin_id = 0").select("bin_id")).collect()}
    assert found.keys() == best.keys()
    assert all(abs(found[k] - best[k]) < 1e-9 for k in best)


def test_components_and_boundary(spark):
    g = grid.regular_grid(spark, (0.0, 0.0), (1.0, 1.0), (5, 5))
    cut = grid.subset(g, F.col("ix") != 2)
    assert fields.components(cut.bins, cut.edges).select("component").distinct().count() == 2
    assert grid.boundary_bins(g).count() == 16


def test_heat_keeps_mass(spark):
    g = holed(spark)
    v = g.bins.select("bin_id", F.when(F.col("bin_id") == 3, 1.0).otherwise(0.0).alias("v"))
    kernel = fields.heat_kernel(g.edges, g.bins, 1.0)
    out = fields.spread(v, kernel)
    assert abs(out.agg(F.sum("v")).first()[0] - 1) < 1e-6
    assert out.where("v < 0").count() == 0


def test_occupancy_edges(spark):
    g = grid.regular_grid(spark, (0.0, 0.0), (10.0, 10.0), (2, 2))
    schema = "session int, idx long, t double, x double, y double"
    still = spark.createDataFrame([(0, 0, 0.0, 5.0, 5.0), (0, 1, 10.0, 5.0, 5.0)], schema)
    assert trajectory.occupancy(still, g).agg(F.sum("seconds")).first()[0] == 10.0
    assert trajectory.occupancy(still, g, max_gap=1.0).agg(F.sum("seconds")).first()[0] == 0.0
    none = trajectory.occupancy(spark.createDataFrame([], schema), g)
    assert [r.seconds for r in none.collect()] == [0.0] * 4
    edge = grid.bin_at(spark.createDataFrame([(20.0, 5.0), (float("nan"), 5.0), (0.0, 0.0)], "x double, y double"), g)
    assert sorted(r.bin_id for r in edge.collect()) == [-1, -1, 0]
    diagonal = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 4.0, 15.0, 15.0)], schema)
    shared = {r.bin_id: r.seconds for r in trajectory.occupancy_linear(diagonal, g).collect()}
    assert abs(shared[0] - 8 / 3) < 1e-9 and abs(shared[3] - 4 / 3) < 1e-9


def test_transitions_of_a_path(spark):
    g = grid.regular_grid(spark, (0.0, 0.0), (1.0, 1.0), (3, 1))
    path = spark.createDataFrame([(0, i, float(i), b + 0.5, 0.5) for i, b in enumerate([0, 1, 2, 1, 0])], "session int, idx long, t double, x double, y double")
    assert {(r.src, r.dst): r.n for r in trajectory.transitions(path, g).collect()} == {(0, 1): 1, (1, 2): 1, (2, 1): 1, (1, 0): 1}


def test_peri_event_single(spark):
    spikes = spark.createDataFrame([("a", t) for t in (9.5, 10.0, 10.5, 11.0, 11.5, 12.0, 12.1)], "unit string, t double")
    refs = spark.createDataFrame([(0, 10.0)], "ref_id int, t double")
    found = {r.bin: (r.mean, r.sem) for r in events.psth(spikes, refs, (-1.0, 2.0), 1.0).collect()}
    assert found == {0: (1.0, None), 1: (2.0, None), 2: (3.0, None)}


def test_angles_and_hexagons(spark):
    a = spark.createDataFrame([(math.pi,), (-math.pi,), (3 * math.pi,), (0.5,)], "a double")
    r = a.select(angles.wrap(F.col("a")).alias("l"), angles.wrap_right(F.col("a")).alias("r")).collect()
    assert [round(x.l, 9) for x in r] == [round(x, 9) for x in (-math.pi, -math.pi, -math.pi, 0.5)]
    assert [round(x.r, 9) for x in r] == [round(x, 9) for x in (math.pi, math.pi, math.pi, 0.5)]
    p = spark.createDataFrame([(x * 1.3 - 20, y * 1.7 - 20) for x in range(30) for y in range(30)], "x double, y double")
    q, s = binning.hex_axial(F.col("x"), F.col("y"), 3.0)
    cx, cy = binning.hex_center(F.col("q"), F.col("s"), 3.0)
    far = p.select("x", "y", q.alias("q"), s.alias("s")).select(geometry.distance(F.col("x"), F.col("y"), cx, cy).alias("d"))
    assert far.agg(F.max("d")).first()[0] <= 3.0 + 1e-9
    z = spark.range(1).select(angles.erf(F.lit(0.7)).alias("e")).first().e
    assert abs(z - math.erf(0.7)) < 2e-7


def test_regions_round_trip(spark, tmp_path):
    shapes = {"tri": [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)], "spot": (1.0, 1.0)}
    table = regions.to_dataframe(spark, shapes)
    tables.write_regions(table, str(tmp_path / "r"))
    assert regions.from_dataframe(tables.read_regions(spark, str(tmp_path / "r"))) == shapes
    p = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "x double, y double")
    assert [r.regions for r in regions.label_points(p, shapes).collect()] == [["spot", "tri"], ["tri"], []]
    assert [r.regions for r in regions.label_points(p, shapes, boundary=False).collect()] == [["spot", "tri"], [], []]


def test_grid_and_annotation_files(spark, tmp_path):
    g = grid.regular_grid(spark, (0.0, 0.0), (1.0, 2.0), (2, 3))
    tables.write_grid(g, str(tmp_path / "g"))
    back = tables.read_grid(spark, str(tmp_path / "g"))
    same(back.bins, g.bins)
    assert (back.lo, back.width, back.shape) == (g.lo, g.width, g.shape)
    (tmp_path / "a.json").write_text('{"shapes": [{"label": "box", "points": [[0, 1], [2, 3]], "shape_type": "polygon"}]}')
    assert tables.read_labelme(spark, str(tmp_path / "a.json")).first().verts[1].y == 3.0
    (tmp_path / "a.xml").write_text('<annotations><image name="i"><polygon label="p" points="1.0,2.0;3.0,4.0"/><polygon label="q" points="0,0;1,1"/></image></annotations>')
    assert [(r.name, r.verts[1].x) for r in tables.read_cvat(spark, str(tmp_path / "a.xml")).collect()] == [("p", 3.0), ("q", 1.0)]


def test_simulated_place_cell_is_found(spark):
    path = simulate.foraging(spark, 40_000, 0.05, 100.0)
    train = simulate.spikes(path, {0: simulate.place_rate(F.col("x"), F.col("y"), (40.0, 60.0), 10.0, 20.0)}, 0.05)
    g = grid.regular_grid(spark, (0.0, 0.0), (10.0, 10.0), (10, 10), path)
    rates = encoding.rate_map(train, path, g, max_gap=1.0, span=200.0)
    peak = encoding.peak_bins(rates).join(g.bins, "bin_id").first()
    assert math.hypot(peak.x - 40, peak.y - 60) < 15
    assert encoding.map_measures(rates).first().information > 0.5
    same(simulate.spikes(path, {0: F.lit(1.0)}, 0.05), simulate.spikes(path, {0: F.lit(1.0)}, 0.05))


def test_decoding_finds_the_bin(spark):
    rates = spark.createDataFrame([(u, b, 10.0 if u == b else 0.5) for u in range(4) for b in range(4)], "unit int, bin_id long, rate double")
    counts = spark.createDataFrame([(t, u, 8 if u == t % 4 else 0) for t in range(8) for u in range(4)], "t_idx long, unit int, n long")
    bins = spark.createDataFrame([(b, float(b), 0.0) for b in range(4)], "bin_id long, x double, y double")
    post = decoding.posterior(decoding.log_likelihood(counts, rates, 1.0))
    assert all(abs(r.s - 1) < 1e-9 for r in post.groupBy("t_idx").agg(F.sum("p").alias("s")).collect())
    assert all(r.map_bin == r.t_idx % 4 for r in decoding.estimates(post, bins).collect())
    units, found = decoding.assemblies(decoding.pairwise_correlations(counts), 8)
    assert units == [0, 1, 2, 3] and all(v > decoding.marchenko_pastur(4, 8) for v, _ in found)


def test_shuffles(spark):
    d = spark.createDataFrame([(i % 2, i, i * i) for i in range(40)], "g int, i long, v long")
    p = stats.permuted(d, "v", ["g"], "i", 5)
    for r in p.groupBy("shuffle", "g").agg(F.sort_array(F.collect_list("v")).alias("v")).collect():
        assert r.v == [i * i for i in range(40) if i % 2 == r.g]
    same(p, stats.permuted(d, "v", ["g"], "i", 5))
    null = spark.createDataFrame([(float(i),) for i in range(99)], "score double")
    assert stats.p_value(null, 98.0).first().p == 0.02
    counts = spark.range(4000).select(F.col("id").alias("t_idx"), F.lit(0).alias("unit"))
    drawn = counts.withColumn("n", stats.poisson_counts(counts, F.lit(3.0))).agg(F.avg("n"), F.var_pop("n")).first()
    assert abs(drawn[0] - 3) < 0.15 and abs(drawn[1] - 3) < 0.3


def test_trials_and_labels(spark):
    steps = [(0.0, "start"), (1.0, ""), (2.0, "left"), (3.0, ""), (4.0, "start"), (5.0, ""), (6.0, "start"), (7.0, ""), (30.0, "right")]
    d = spark.createDataFrame([(0, i, t, r) for i, (t, r) in enumerate(steps)], "session int, idx long, t double, region string")
    found = behavior.trials(d, F.col("region") == "start", {"left": F.col("region") == "left", "right": F.col("region") == "right"}, 0.5, 10.0)
    assert [(r.start_t, r.stop_t, r.outcome) for r in found.orderBy("trial").collect()] == [(1.0, 2.0, "left"), (5.0, 6.0, "aborted"), (7.0, 17.0, "timeout")]
    spans = spark.createDataFrame([(0, 0.0, 5.0, "a"), (1, 4.0, 6.0, "b")], "ord int, start_t double, stop_t double, name string")
    labels = events.label_by_intervals(d.select("idx", "t"), spans, F.col("name"), 5.0, "idx")
    assert [r.label for r in labels.orderBy("idx").collect()][:6] == ["a", "a", "a", "a", "b", "b"]


def test_streaming_counts(spark, tmp_path):
    from gridloom.streaming import counts

    rows = spark.range(200).select(F.pmod("id", F.lit(3)).alias("session"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), (F.col("id") % 20).cast("double").alias("x"), F.lit(0.5).alias("y"))
    rows.write.parquet(str(tmp_path / "in"))
    g = grid.regular_grid(spark, (0.0, 0.0), (10.0, 1.0), (2, 1))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = counts.binned_counts(stream, g).writeStream.outputMode("complete").format("memory").queryName("binned").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM binned").first()[0] == 200


def test_fitted_transforms(spark):
    from gridloom.operators import alignment

    r = random.Random(4)
    p = [(r.random() * 10, r.random() * 10) for _ in range(50)]
    for kind, m in (("affine", [[2.0, 0.3, 1.0], [-0.4, 1.5, -2.0]]), ("similarity", [[1.2, -1.6, 3.0], [1.6, 1.2, 4.0]]), ("rigid", [[0.6, -0.8, 3.0], [0.8, 0.6, 4.0]])):
        rows = [(x, y, m[0][0] * x + m[0][1] * y + m[0][2], m[1][0] * x + m[1][1] * y + m[1][2]) for x, y in p]
        found = alignment.fit_transform(spark.createDataFrame(rows, "x double, y double, u double, v double"), kind)
        assert all(abs(a - b) < 1e-6 for s, t in zip(found, m) for a, b in zip(s, t))


def test_hexagonal_map_scores_high(spark):
    g = grid.regular_grid(spark, (0.0, 0.0), (2.0, 2.0), (40, 40))
    hexagonal = simulate.grid_rate(F.col("x"), F.col("y"), 24.0, 10.0)
    square = 5 + 2.5 * F.cos(F.col("x") * 0.26) + 2.5 * F.cos(F.col("y") * 0.26)
    rates = g.bins.select(F.explode(F.array(F.struct(F.lit(0).alias("unit"), hexagonal.alias("rate")), F.struct(F.lit(1).alias("unit"), square.alias("rate")))).alias("u"), "bin_id")
    scores = {r.unit: r.score for r in encoding.grid_scores(rates.select("u.unit", "bin_id", "u.rate"), g).collect()}
    assert scores[0] > 0.7 and scores[1] < 0.3


def test_recording_and_cues(spark, walk):
    from gridloom.operators import visibility
    from gridloom.operators.session import Recording

    g = grid.regular_grid(spark, (0.0, 0.0), (10.0, 10.0), (10, 5))
    spikes = walk.select("session", F.lit("a").alias("unit"), "t")
    epochs = spark.createDataFrame([(10.0, 20.0)], "start_t double, stop_t double")
    cut = Recording(g, walk, spikes).restrict(epochs, 10.0).units("a")
    assert cut.samples.count() == cut.spikes.count() == walk.where("t between 10 and 20").count()
    eyes = spark.createDataFrame([(5.0, 5.0, 0.0)], "x double, y double, heading double")
    cues = {"ahead": (55.0, 5.0), "behind": (-5.0, 5.0), "side": (5.0, 45.0)}
    assert [r.cue for r in visibility.visible_cues(eyes, g, cues, 1.0).collect()] == ["ahead"]
    walled = grid.subset(g, F.col("ix") != 3)
    assert visibility.visible_cues(eyes, walled, cues, 1.0).collect() == []
    rates = g.bins.select(F.lit(0).alias("unit"), "bin_id", F.when(F.col("ix") == 0, 5.0).otherwise(0.1).alias("rate"))
    assert encoding.border_scores(rates, g).first().score > 0.9
