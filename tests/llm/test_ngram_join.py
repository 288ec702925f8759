import random
from collections import defaultdict

import pytest

from gridloom.llm import components, ngram_join


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    """(id, n, component) for rows of (id, text)."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(str((i, len(s), None if i is None else find(i))) for i, s in sets)


def found(docs):
    return sorted(str((r.id, r.n_shingles, r.component_id)) for r in ngram_join.link_documents(docs).collect())


def near_copies(seed, n, sizes):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            words = list(r.choice(rows)[1])
            for _ in range(r.randrange(1, 4)):
                at = r.randrange(len(words) + 1)
                words[at : at + r.randrange(2)] = [r.choice(vocabulary)] * r.randrange(2)
        else:
            words = [r.choice(vocabulary) for _ in range(r.choice(sizes))]
            if r.random() < 0.3:
                words += passage
        rows.append((i, words or ["w"]))
    return [(i, " ".join(w)) for i, w in rows]


@pytest.mark.parametrize("sizes", [[1, 3, 5, 6, 8, 12, 20], [30, 40, 60, 90], [150, 300, 700]])
def test_links_against_brute_force(spark, sizes):
    rows = near_copies(len(sizes), 250, sizes)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 10)
    monkeypatch.setattr(ngram_join, "SMALLEST_BAND", 4)
    rows = near_copies(11, 200, [40, 60])
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_too_few_parts_sign_by_shingles(spark, monkeypatch):
    plain = ngram_join.signatures
    monkeypatch.setattr(ngram_join, "signatures", lambda s, band: [plain(s, band)[0][:1], plain(s, 0)[0] + ngram_join._tag(band)] if band else plain(s, band))
    rows = near_copies(5, 60, [60, 90])
    # The patched function runs on the driver's side only where tasks see it too, so check it by hand.
    for a, ta in rows[:30]:
        for b, tb in rows[:a]:
            x, y = ngram_join.Shingler()(ta), ngram_join.Shingler()(tb)
            if ngram_join.linked(x, y):
                common = set(ngram_join.bands(len(x))) & set(ngram_join.bands(len(y)))
                sign = lambda s, band: {v for g in ngram_join.signatures(s, band) for v in ngram_join.first_in_order(g, len(s), s[:0], s[:0])[0].tolist()}
                assert common and any(sign(x, c) & sign(y, c) for c in common) or len(x) == len(y) and (x == y).all()


def test_bitmaps_never_lose_a_link():
    import numpy as np

    rows = near_copies(3, 120, [6, 30, 200])
    sets = [ngram_join.Shingler()(t) for _, t in rows]
    maps = [np.frombuffer(ngram_join.bitmap(s), np.uint8) for s in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if ngram_join.linked(a, b):
                assert ngram_join.may_link(maps[i], len(a), maps[j], len(b))


def test_odd_rows(odd, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows]
    assert found(odd) == brute(rows)
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    first = {eval(x)[0] for x in brute(rows) if eval(x)[0] == eval(x)[2]}
    assert {r.doc_id for r in kept.collect()} == first


def test_an_id_with_two_texts_links_them(spark):
    r = random.Random(2)
    a, b = (" ".join(r.choice("abcdefghijklmnop") + str(r.randrange(99)) for _ in range(40)) for _ in range(2))
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, "z")], "doc_id long, text string")
    assert {(r.id, r.component_id) for r in ngram_join.link_documents(docs).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, 102), (102, 101), (7, 7)]
    d = spark.createDataFrame(chain, "a long, b long")
    groups = defaultdict(set)
    for r in components.connected_components(d).collect():
        groups[r.component].add(r.node)
    assert groups == {0: set(range(61)), 100: {100, 101, 102}}


def test_empty(empty):
    assert ngram_join.link_documents(empty).collect() == [] and ngram_join.keep_one(empty).collect() == []


def test_the_query_against_brute_force(spark):
    """All pairs of documents whose sizes allow a link."""
    from gridloom.llm import queries

    data = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    sets = {i: shingles(t) for i, t in rows}
    of_set = defaultdict(list)
    for i, s in sets.items():
        of_set[frozenset(s)].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(i, j):
        x, y = find(i), find(j)
        parent[max(x, y)] = min(x, y)

    for same in of_set.values():
        for j in same[1:] if sets[same[0]] else ():
            join(same[0], j)
    distinct = sorted(((len(s), same[0]) for s, same in of_set.items() if s), reverse=True)
    for k, (n, i) in enumerate(distinct):
        for m, j in distinct[k + 1 :]:
            if 100 * m < 80 * n:
                break
            common = len(sets[i] & sets[j])
            if 100 * common >= 80 * (n + m - common):
                join(i, j)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op9_ngram_join(spark, data).collect()}
    assert found == {i: (len(s), find(i)) for i, s in sets.items()}
