"""Named queries that take all their rows."""

from collections import Counter

import __spark_entry__ as entry
import bench
from gridloom.plans.activity import _post
from gridloom.plans.catalog import samples

DATA = "/root/testdata/sf0.001"


def test_viewshed_of_every_event(spark):
    found = {r.idx for r in entry.queries()["viewshed_all"](spark, DATA).select("idx").distinct().collect()}
    rows = samples(spark, DATA).select("session", "idx", "t", "x", "y").collect()
    last = {}
    for r in sorted(rows, key=lambda r: (r.t, r.idx)):
        last[r.session] = r.idx
    bins = {(r.x // 20, r.y // 10) for r in rows if 0 <= r.x < 200 and 0 <= r.y < 100}
    counts = {b: sum((r.x // 20, r.y // 10) == b for r in rows) for b in bins}
    expected = {r.idx for r in rows if r.idx != last[r.session] and counts.get((r.x // 20, r.y // 10), 0) >= 3}
    assert found == expected and {i % 10 for i in found} == set(range(10))


def test_radon_line_of_every_time_bin(spark):
    found = entry.queries()["radon_line"](spark, DATA).collect()
    post = _post(spark, DATA).collect()
    score = Counter()
    for r in post:
        for k in range(21):
            slope = -25.0 + k * 2.5
            for near in (-1, 0, 1):
                score[slope, round(r.bin_id - slope * r.t_idx) + near] += r.p
    assert len(found) == 1 and {r.t_idx for r in post} == set(range(120))
    assert abs(found[0].score - max(score.values())) < 1e-9
    assert abs(score[found[0].slope, found[0].offset] - found[0].score) < 1e-9


def test_bench_times_every_text_query():
    assert {n for n in entry.queries() if n.startswith("op") and n[2].isdigit()} | {"pipeline"} <= set(bench.HEADLINE)
