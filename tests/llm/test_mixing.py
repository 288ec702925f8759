import re
from collections import defaultdict

from pyspark.sql import functions as F

from gridloom.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, share, most):
    """Targets by repeating the cut until no source is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1.0, 2.0, 3.0)[i % 3] for i, s in enumerate(order)}
    left, capped, total = set(sizes), {}, share * sum(sizes.values())
    while left:
        rest, w = total - sum(capped.values()), sum(weight[s] for s in left)
        over = {s for s in left if rest * weight[s] / w > most * sizes[s] + 1e-9}
        if not over:
            return capped | {s: rest * weight[s] / w for s in left}
        capped |= {s: most * sizes[s] for s in over}
        left -= over
    return capped


def test_plan_meets_targets(odd, odd_rows):
    sizes = defaultdict(int)
    for _, text, _, source, _ in odd_rows:
        sizes[source] += len(WORD.findall(text or ""))
    expected = water(sizes, 1.0, 3.0)
    plan = mixing.plan_mix(odd).collect()
    assert len(plan) == len(odd_rows)
    taken = defaultdict(int)
    for r in plan:
        assert r.source_size == sizes[r.source] and abs(r.target - expected[r.source]) < 1e-6 * max(1, expected[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - expected[s]) < 1 for s in sizes)


def test_reruns_agree_and_ranges_change_nothing(odd, monkeypatch):
    rows = lambda d: sorted(map(str, d.collect()))
    once = rows(mixing.plan_mix(odd))
    assert once == rows(mixing.plan_mix(odd.repartition(3)))
    monkeypatch.setattr(mixing, "ROWS_A_RANGE", 3)
    sums = mixing.plan_mix(odd).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(r.t == int(r.g + 1e-6) for r in sums)


def test_mixed_documents(odd):
    wide = odd.withColumns({"size": F.lit("clash"), "key": F.lit(1), "row": F.lit(2), "target": F.lit(3)})
    mixed = mixing.mix(wide)
    assert mixed.columns == wide.columns
    plan = {r.source: r.t for r in mixing.plan_mix(odd).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert got == {s: t for s, t in plan.items() if t}
    whole = {r.text for r in odd.collect()}
    assert all(any(w.startswith(r.text) for w in whole if w) for r in mixed.collect())


def test_empty(empty):
    assert mixing.plan_mix(empty).collect() == [] and mixing.mix(empty).collect() == []
