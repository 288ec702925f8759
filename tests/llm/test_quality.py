import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from gridloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_measures_against_brute_force(spark, odd, odd_rows):
    texts = ["a b c d e f a b c d e", "x x x x x x", "a\n\na\na b\nb", "p q r s t | p q r s t | z p q r s t"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = quality.judge(odd.select("doc_id", "text").union(more)).collect()
    expected = Counter((i, *brute(t)) for i, t in [(r[0], r[1]) for r in odd_rows] + [(1000 + i, t) for i, t in enumerate(texts)])
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == expected
    for r in found:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_votes_part_junk_from_prose(spark):
    good = [f"The people of town {i} went to the market and bought what they wanted for the winter, as it was said by the others number {i}." for i in range(200)]
    junk = [" ".join(f"ZZ{i}Q{k}!!" for k in range(20)) for i in range(20)] + [" ".join(f"w{i}x{k}***" for k in range(20)) for i in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + junk)], "doc_id long, text string")
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert kept == set(range(200))
    wide = docs.withColumns({"_m": F.lit(1), "n_words": F.lit("x")})
    left = quality.keep_good(wide)
    assert left.columns == wide.columns and {r.doc_id for r in left.collect()} == kept


def test_estimate_finds_planted_accuracies():
    """Rules that vote bad on 5 % of good and 70 % of bad documents: weights as planted, and one bad vote of four is kept."""
    r, n = random.Random(1), Counter()
    for _ in range(100_000):
        wrong = 0.05 if r.random() < 0.8 else 0.7
        n[tuple(-1 if r.random() < wrong else 1 for _ in range(4))] += 1
    odds, weights = quality.estimate(sorted(n.items()))
    assert abs(odds - math.log(4)) < 0.1
    for good, bad in weights:
        assert abs(good / math.log(0.95 / 0.3) - 1) < 0.1 and abs(bad / math.log(0.05 / 0.7) - 1) < 0.1
    assert odds + 3 * weights[0][0] + weights[0][1] > 0 > odds + 2 * weights[0][0] + 2 * weights[0][1]
    assert quality.estimate([])[1] == []


def brute_estimate(patterns):
    """The same model by plain sums over documents, without patterns or logarithms."""
    rules = range(len(patterns[0][0]))
    p, g, b = 0.5, None, None
    for _ in range(quality.ROUNDS):
        good = []
        for votes, _ in patterns:
            x, y = p, 1 - p
            for j in rules:
                if g and votes[j]:
                    x *= g[j] if votes[j] < 0 else 1 - g[j]
                    y *= b[j] if votes[j] < 0 else 1 - b[j]
            good.append(x / (x + y) if g else 1 / (1 + math.exp(4.0 if min(votes) < 0 else -4.0)))
        p = (sum(n * w for (_, n), w in zip(patterns, good)) + 1) / (sum(n for _, n in patterns) + 2)
        share = lambda j, weights, seen: (
            (seen[0] + sum(n * w for (v, n), w in zip(patterns, weights) if v[j] < 0)) / (seen[1] + sum(n * w for (v, n), w in zip(patterns, weights) if v[j]))
        )
        g = [share(j, good, quality.ASSUMED_GOOD) for j in rules]
        b = [share(j, [1 - w for w in good], quality.ASSUMED_BAD) for j in rules]
    return p, g, b


def test_the_query_against_brute_force(spark):
    """Every verdict of the registered query, from its measures on: votes, estimation and posterior."""
    from gridloom.llm import queries

    found = queries.op3_quality_rules(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    m = F.struct(*[F.col(c) for c in found.columns if c.startswith("n_") or c == "word_chars"])
    rows = found.withColumns({f"v{j}": v for j, v in enumerate(quality.rules(m).values())}).collect()
    assert len(rows) == len(texts)
    votes = {r.doc_id: tuple(r[f"v{j}"] for j in range(9)) for r in rows}
    patterns = sorted(Counter(votes[r.doc_id] for r in rows if not r.base_failed).items())
    p, g, b = brute_estimate(patterns)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
        if r.base_failed:
            assert not r.kept and r.quality is None
            continue
        x, y = p, 1 - p
        for v, good, bad in zip(votes[r.doc_id], g, b):
            x, y = (x * good, y * bad) if v < 0 else (x * (1 - good), y * (1 - bad)) if v > 0 else (x, y)
        assert abs(r.quality - x / (x + y)) < 1e-6 and r.kept == (r.quality >= 0.5)


def test_labelled_documents(spark):
    """Held-out labels: almost all good documents stay, and most of the bad ones that pass the base rules go."""
    from gridloom.llm import queries

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    found = queries.op3_quality_rules(spark, "/root/testdata/sf0.01").where("not base_failed").join(labels, "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in found.groupBy(labels["quality"], "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n.get((0, True), 0) <= 0.1 * n[0, False]


def test_empty(empty):
    assert quality.judge(empty).collect() == [] and quality.keep_good(empty).collect() == []
