"""Importance resampling against plain Python; the query against its SQL is in test_queries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from gridloom.llm import importance
from gridloom.llm.importance import TournamentTree, draw, merged, ranges_of

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=1):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lower)
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def plain(docs, target, percent=10, min_words=20, longest=1, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, longest)[0]) for texts in ([x for _, x in docs], target))
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * float(S + buckets) / ((s[b] + 1) * float(T + buckets))))
    rows = []
    for i, text in docs:
        found, n = features(text, longest)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(found), weight, score, n))
    order = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks, out = {}, []
    for k, r in enumerate(order[: percent * len(order) // 100]):
        ranks.setdefault(r, []).append(k + 1)
    for r in rows:
        out.append((*r[:4], ranks[r].pop() if ranks.get(r) else None))
    return sorted(out, key=str)


def found(frame, target, **options):
    return sorted(((r.id, r.n_features, r.weight, r.score, r["rank"]) for r in draw(frame, target, **options).collect()), key=str)


def texts(seed, n):
    r = random.Random(seed)
    return [" ".join(r.choice(["alpha", "Beta", "gamma", "x1", "für", "the", "of", f"w{r.randrange(50)}"]) for _ in range(r.randrange(5, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([("gamma the alpha für x1 gamma",), (None,), ("w3, w4-W5!",)], "text string")


TARGET = ["gamma the alpha für x1 gamma", None, "w3, w4-W5!"]


def test_tournament_tree():
    r = random.Random(2)
    for k in (1, 2, 3, 7, 20):
        runs = [sorted((r.randrange(50), i) for _ in range(r.randrange(9))) for i in range(k)]
        left = [list(x) for x in runs]
        tree, out = TournamentTree([x.pop(0) if x else None for x in left]), []
        while (head := tree.heads[tree.first()]) is not None:
            at = tree.first()
            out.append(head)
            tree.replace(at, left[at].pop(0) if left[at] else None)
        assert out == sorted(x for run in runs for x in run)


def test_merge_opens_blocks_in_order():
    r = random.Random(4)
    for _ in range(50):
        runs = [sorted((r.randrange(30),) for _ in range(r.randrange(40))) for _ in range(r.randrange(1, 9))]
        blocks = [(i, run[a : a + 4], a) for i, run in enumerate(runs) for a in range(0, len(run), 4)]
        blocks.sort(key=lambda b: (b[1][0], b[0], b[2]))
        assert list(merged((i, rows) for i, rows, _ in blocks)) == sorted(x for run in runs for x in run)
    assert list(merged(iter([]))) == []


def test_ranges(monkeypatch):
    monkeypatch.setattr(importance, "RANGE_ROWS", 10)
    assert ranges_of({5: 4, 4: 5, 3: 25, 2: 1, 1: 9}, 36) == ([4, 3, 1], [0, 9, 34])
    assert ranges_of({5: 4, 4: 5, 3: 25, 2: 1, 1: 9}, 9) == ([4], [0])
    assert ranges_of({5: 4}, 0) == ([], []) and ranges_of({}, 0) == ([], [])


@pytest.mark.parametrize("options", [{}, {"percent": 100}, {"percent": 37, "min_words": 8, "longest": 2}, {"buckets": 7}])
def test_against_plain(spark, target, options):
    docs = list(enumerate(texts(1, 300)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert found(frame, target, **options) == plain(docs, TARGET, **options)


def test_small_ranges_and_blocks(spark, target, monkeypatch):
    monkeypatch.setattr(importance, "RANGE_ROWS", 20)
    monkeypatch.setattr(importance, "BLOCK_ROWS", 3)
    monkeypatch.setattr(importance, "FEATURES_KEPT", 5)
    docs = list(enumerate(texts(2, 400)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    assert found(frame, target, percent=60) == plain(docs, TARGET, percent=60)


def test_odd_rows(odd, odd_rows, target):
    docs = [(i, t) for i, t, *_ in odd_rows]
    for percent in (10, 90):
        assert found(odd, target, percent=percent) == plain(docs, TARGET, percent=percent)


def test_one_score_for_a_third(spark, target, monkeypatch):
    """Rows that repeat share id, text and score: all are drawn, each with its own rank."""
    monkeypatch.setattr(importance, "RANGE_ROWS", 10)
    docs = [(1, "alpha " * 30)] * 100 + list(enumerate(texts(3, 200), start=2))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert found(frame, target, percent=70) == plain(docs, TARGET, percent=70)


def test_string_ids(spark, target):
    docs = [(f"d{i}", t) for i, t in enumerate(texts(5, 60))] + [(None, "alpha " * 25)]
    frame = spark.createDataFrame(docs, "doc_id string, text string").repartition(4)
    got = found(frame, target, percent=50)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, len([1 for _, t in docs if features(t)[1] >= 20]) // 2 + 1))
    drawn = sorted((r for r in got if r[4]), key=lambda r: r[4])
    assert drawn == sorted(drawn, key=lambda r: (-r[3], r[0] is None, r[0] or ""))


def test_empty_tables(spark, empty, target):
    assert draw(empty, target).collect() == []
    none = spark.createDataFrame([], "text string")
    docs = list(enumerate(texts(6, 40)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(frame, none, percent=50) == plain(docs, [], percent=50)
