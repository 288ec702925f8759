"""Moving means over stretches, and intervals in another order."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import stats
from gridloom.operators import timeseries as ts


@pytest.mark.parametrize("rows, span", [(4, None), (7, 30.0), (1, 5.0), (1000, 2000.0)])
def test_moving_mean_whatever_the_stretches(spark, rows, span):
    r = random.Random(3)
    data = [("a", float(t), i, None if r.random() < 0.2 else r.random()) for i, t in enumerate(sorted(r.randrange(200) for _ in range(60)))] + [("b", 1.0, 0, 2.0), ("c", 1.0, 0, None)]
    d = spark.createDataFrame(data, "k string, t double, i long, v double")
    found = {(x.k, x.i): x.m for x in ts.moving_mean(d, ("k",), ("t", "i"), F.col("v"), 3, "m", span, rows).collect()}
    assert len(found) == len(data) and found["b", 0] == 2.0 and found["c", 0] is None
    a = [x[3] for x in data if x[0] == "a"]
    for i in range(60):
        near = [v for v in a[max(0, i - 3) : i + 4] if v is not None]
        assert found["a", i] == (pytest.approx(sum(near) / len(near)) if near else None)


def test_shuffled_intervals_keep_what_they_should(spark):
    times = [0.5, 1.0, 3.0, 3.0, 7.5, 8.0, 20.0]
    d = spark.createDataFrame([("u", t) for t in times] + [("v", 4.0)], "unit string, t double")
    trains = {}
    for x in stats.shuffled_intervals(d, 20, seed=1).collect():
        trains.setdefault((x.unit, x.surrogate), []).append(x.t)
    assert len(trains) == 40 and all(trains["v", s] == [4.0] for s in range(20))
    gaps = sorted(b - a for a, b in zip(times, times[1:]))
    orders = set()
    for s in range(20):
        t = sorted(trains["u", s])
        assert t[0] == 0.5 and t[-1] == pytest.approx(20.0) and sorted(b - a for a, b in zip(t, t[1:])) == pytest.approx(gaps)
        orders.add(tuple(round(b - a, 6) for a, b in zip(t, t[1:])))
    assert len(orders) > 10
    again = {(x.unit, x.surrogate, round(x.t, 9)) for x in stats.shuffled_intervals(d, 20, seed=1).collect()}
    assert again == {(*k, round(t, 9)) for k, v in trains.items() for t in v}
