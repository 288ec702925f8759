"""Hard negatives against brute force; the query against its SQL is in test_queries."""

import math
import random

import numpy as np
import pytest

from gridloom.llm import hard_negatives
from gridloom.llm.hard_negatives import Best, mine, sliced_scores

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=100, n_positives=5, n_negatives=10, low=30, high=90):
    sound = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            v = [float(np.float32(x)) for x in v]
            sound[i] = min(sound.get(i, (label, v)), (label, v))
    vectors = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in sound.items()}
    out = []
    for a, (label, v) in vectors.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in vectors.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if vectors[i][0] == label][:n_positives]:
            fits = [i for i in order if vectors[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fits[:n_negatives])]
    return sorted(out)


def found(spark, rows, **options):
    got = mine(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


def drawn(seed, n, dims, labels=4, spread=0.2):
    r = random.Random(seed)
    return [(i, [r.gauss(0.1, spread) for _ in range(dims)], r.randrange(labels)) for i in range(n)]


def test_sliced_scores():
    r = np.random.default_rng(0)
    for trial in range(150):
        n, a, d, most = (int(r.integers(*x)) for x in ((1, 60), (1, 20), (0, 9), (1, 5)))
        size = int(r.choice([1, 3, 300, 40_000]))
        rows, anchors, may = r.integers(-size, size + 1, (n, d)), r.integers(-size, size + 1, (a, d)), r.random((n, a)) < 0.7
        exact = rows @ anchors.T
        low = r.integers(-size * size, size * size + 1, (most, a))
        high = low + r.integers(0, size * size + 1, (most, a))
        i, k, score = sliced_scores(rows, anchors, may, low, high)
        inside = may & ((exact >= low[:, None, :]) & (exact <= high[:, None, :])).any(0)
        assert set(zip(i.tolist(), k.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(inside)))), trial
        assert (exact[i, k] == score).all()


def test_best_keeps_smaller_ids_of_ties():
    best = Best(3, 2)
    best.add(np.array([0, 0, 2]), np.array([5, 5, 1]), np.array([9, 4, 7]))
    best.add(np.array([0, 2]), np.array([5, 3]), np.array([6, 8]))
    assert list(zip(best.slot, best.score, best.id)) == [(0, 5, 4), (0, 5, 6), (2, 3, 8), (2, 1, 7)]
    assert best.floor().tolist()[0] == 5 and best.floor()[1] < -(1 << 61)


@pytest.mark.parametrize("tile", [1_000_000, 700])
def test_against_brute_force(spark, monkeypatch, tile):
    rows = drawn(1, 420, 12)
    monkeypatch.setattr(hard_negatives, "PAIRS_AT_ONCE", tile)
    expected = plain(rows, every=20)
    assert len(expected) > 500 and found(spark, rows, every=20) == expected


def test_blocks_and_shards(spark, monkeypatch):
    """Many small blocks, shards and blocks of anchors give the same rows."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 50)
    rows = drawn(2, 260, 6, labels=70)
    assert found(spark, rows, every=7, n_positives=2) == plain(rows, every=7, n_positives=2)


def test_odd_rows(spark):
    """Nulls, non-finite components, ties, repeated ids, unequal lengths, one label alone."""
    rows = drawn(3, 150, 5, labels=2)
    rows += [(None, [1.0] * 5, 0), (500, None, 1), (600, [0.1, None, 0.2], 0), (700, [float("nan")] * 5, 1), (701, [float("inf")] * 5, 1), (702, [0.3] * 5, None)]
    rows += [(800 + i, [0.25] * 5, i % 2) for i in range(40)] + [rows[7], rows[7], (7, [0.9] * 5, 0)]
    rows += [(900, [0.5, 0.5], 1), (901, [0.4] * 9, 0), (1000, [], 0), (1100, [0.1] * 5, 9)]
    assert found(spark, rows, every=10) == plain(rows, every=10)


def test_most_rows_of_one_label_and_one_vector(spark):
    rows = [(i, [0.5, 0.25, -0.125], 0 if i % 10 else i % 3) for i in range(400)] + [(1000 + i, [0.2, 0.1 * i, 0.3], 1) for i in range(5)]
    assert found(spark, rows, every=100) == plain(rows, every=100)


def test_large_components(spark):
    rows = [(i, [1000.0 * i, -3e4, 2e5 + i], i % 2) for i in range(120)]
    assert found(spark, rows, every=30) == plain(rows, every=30)


def test_nothing_to_return(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []  # no anchor
    assert found(spark, [(100, [1.0], 0), (2, [1.0], 1)]) == []  # no positive
    assert found(spark, [(100, [-1.0], 0), (2, [1.0], 0), (3, [1.0], 1)]) == []  # a window below zero is empty


def test_other_columns(spark):
    rows = drawn(4, 60, 4)
    wide = spark.createDataFrame([(*x, 1, "y", 2) for x in rows], SCHEMA + ", score int, block string, bucket int")
    got = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in mine(wide, every=10).collect())
    assert got == plain(rows, every=10)
