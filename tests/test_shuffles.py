"""Shuffles of groups of any size."""

import re

from pyspark.sql import functions as F

from gridloom.operators import stats


def test_values_are_dealt_without_a_broadcast_of_rows(spark):
    d = spark.range(3000).select((F.col("id") % 3).alias("g"), "id", (F.col("id") * 7 % 1000).alias("v"), (F.col("id") + 0.5).alias("x"))
    p = stats.permuted(d, "v", ["g"], "id", 4, span=100, pieces=8)
    assert p.columns == ["shuffle", "g", "id", "v", "x"]
    found = {(r.shuffle, r.id): (r.g, r.v, r.x) for r in p.collect()}
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[[^]]*_at", plan) and not re.search(r"Broadcast\w*Join \[[^]]*_at", plan)
    drawn = d.select("*", *[stats.uniform(F.lit(s), F.col("id"), F.col("g"), seed=0).alias(f"u{s}") for s in range(4)]).collect()
    expected = {}
    for s in range(4):
        for g in range(3):
            rows = sorted((r for r in drawn if r.g == g), key=lambda r: r.id)
            dealt = sorted(rows, key=lambda r: (r[f"u{s}"], r.id))
            expected |= {(s, a.id): (g, b.v, a.x) for a, b in zip(rows, dealt)}
    assert found == expected
