"""Quality rules combined by weak supervision.

Each rule votes good or bad, or abstains.  Expectation-maximisation over the counts of
vote patterns estimates how accurate each rule is on good and on bad documents, without
labels; a document's posterior probability of being good replaces all-must-pass filtering.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: A word: characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"
#: Words in a window that counts as repeated when found twice.
WINDOW = 5
#: Frequent short words of English, French, German and Spanish.
FUNCTION_WORDS = (
    "the of and to in is it that with for was on are as by at an be this from or a "
    "le la les de des du et un une est que qui en dans pour par sur au aux pas "
    "der die das und ein eine ist von zu den dem nicht mit sich auf für "
    "el los las y del se una por con su para no lo como más o"
).split()
#: Rounds of estimation; it ends sooner once nothing moves.
ROUNDS = 200
#: What is assumed of each rule before any document is seen, as (bad votes, votes): on good
#: documents, where rules are written to be rarely wrong, and on bad ones. The counts of a
#: corpus outweigh them.
ASSUMED_GOOD, ASSUMED_BAD = (10.0, 2000.0), (2.0, 10.0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def repeat_words(grams: Column) -> Column:
    """Words that lie in windows found at least twice, from the hashes of all windows."""

    def covered(pairs: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(pairs, i)["h"] == x["h"], F.lit(False))
        repeated = F.filter(pairs, lambda x, i: same(x, i - 1) | same(x, i + 1))
        starts = F.sort_array(F.transform(repeated, lambda x: x["i"]))
        # A window adds its words but those that the one before it has added.
        new = lambda s: F.transform(s, lambda p, i: F.least(F.lit(WINDOW), F.when(i > 0, p - F.get(s, i - 1)).otherwise(WINDOW)))
        return let(starts, lambda s: F.aggregate(new(s), F.lit(0), lambda a, x: a + x))

    pairs = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # Most texts repeat no window; the sort is for the rest.
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), let(pairs, covered)).otherwise(0)


def measures(text: Column) -> Column:
    """A struct of the measures that the rules read, of each whole text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))

    def of_words(words: Column) -> Column:
        n = F.size(words)
        starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
        grams = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
        found = {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": _count(text, "[#*$%&|<>]"),
            "n_lines": let(lines, lambda x: F.size(x)).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": let(grams, repeat_words).cast("long"),
            "n_upper": _count(text, r"\p{Lu}"),
            "n_shouts": _count(text, r"!!|\?\?"),
            "n_echoes": F.size(F.filter(words, lambda w, i: w == F.get(words, i + 1))).cast("long"),
            "n_function": F.size(F.filter(words, lambda w: F.lower(w).isin(FUNCTION_WORDS))).cast("long"),
        }
        return F.struct(*[c.alias(k) for k, c in found.items()])

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def rules(m: Column) -> dict[str, Column]:
    """The vote of each rule: 1 good, -1 bad, 0 none."""
    words = F.greatest(m["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(m["word_chars"], F.lit(1)).cast("double")

    def vote(value: Column, good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    symbols, length, upper, shouts = m["n_symbols"] / words, chars / words, m["n_upper"] / chars, m["n_shouts"] / words
    repeat, dup, function = m["n_repeat_words"] / words, m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)), m["n_function"] / words
    echoes = m["n_echoes"] / words
    long_text = m["n_words"] >= 30
    return {
        "symbols": vote(symbols, symbols < 0.02, symbols > 0.1),
        "word_length": vote(length, length.between(3.5, 9), (length < 2.5) | (length > 12)),
        "upper_case": vote(upper, upper < 0.15, upper > 0.35),
        "shouting": vote(shouts, shouts == 0, shouts > 0.1),
        "repeated_words": vote(repeat, repeat < 0.02, repeat > 0.15),
        "echoed_words": vote(echoes, echoes < 0.05, echoes > 0.2),
        "repeated_lines": vote(dup, (dup == 0) & (m["n_lines"] > 1), dup > 0.3),
        "function_words": vote(function, function > 0.1, long_text & (function < 0.02)),
        "length": vote(words, m["n_words"] >= 20, m["n_words"] < 10),
    }


def estimate(patterns: Sequence[tuple[tuple[int, ...], int]]) -> tuple[float, list[tuple[float, float]]]:
    """Log odds of being good before any vote, and for each rule of its good and bad vote.

    ``patterns``: votes and how many documents cast them so, at most 3 ** rules rows.
    Votes are taken to be independent within good and within bad documents.  How often a rule
    votes bad in a class has a beta prior, ``ASSUMED_GOOD`` or ``ASSUMED_BAD``, and no bounds:
    rules that are often wrong come out so.  To begin with, a document with any bad vote is
    likely to be bad, which settles that the good class is the one with fewer bad votes.
    """
    if not patterns:
        return 0.0, []
    n_rules = len(patterns[0][0])
    total = sum(n for _, n in patterns)
    prior, bad_if_good, bad_if_bad = 0.5, [0.5] * n_rules, [0.5] * n_rules  # P(bad vote | class), of those that vote
    for step in range(ROUNDS):
        good_mass = 0.0
        sums = [[*ASSUMED_GOOD, *ASSUMED_BAD] for _ in range(n_rules)]  # good: bad votes, votes; bad: bad votes, votes
        for votes, n in patterns:
            odds = math.log(prior / (1 - prior))
            for j, v in enumerate(votes):
                if v < 0:
                    odds += math.log(bad_if_good[j] / bad_if_bad[j])
                elif v > 0:
                    odds += math.log((1 - bad_if_good[j]) / (1 - bad_if_bad[j]))
            if step == 0:
                odds = -4.0 if min(votes) < 0 else 4.0
            good = n / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            good_mass += good
            for j, v in enumerate(votes):
                if v:
                    sums[j][1] += good
                    sums[j][3] += n - good
                    if v < 0:
                        sums[j][0] += good
                        sums[j][2] += n - good
        new_prior = (good_mass + 1) / (total + 2)
        new_good, new_bad = [s[0] / s[1] for s in sums], [s[2] / s[3] for s in sums]
        moved = max(abs(a - b) for a, b in zip([new_prior, *new_good, *new_bad], [prior, *bad_if_good, *bad_if_bad]))
        prior, bad_if_good, bad_if_bad = new_prior, new_good, new_bad
        if moved < 1e-9:
            break
    weights = [(math.log((1 - g) / (1 - b)), math.log(g / b)) for g, b in zip(bad_if_good, bad_if_bad)]
    return math.log(prior / (1 - prior)), weights


def votes_of(m: Column) -> Column:
    """The votes of all rules, in their order; null for base_failed texts."""
    return F.when(~base_failed(m), F.array(*rules(m).values()))


def fit(voted: DataFrame) -> tuple[float, list[tuple[float, float]]]:
    """``estimate`` over the vote patterns of all rows of ``voted`` (_votes)."""
    # At most 3 ** 9 rows, however many documents there are.
    counted = voted.where("_votes is not null").groupBy("_votes").agg(F.count("*").alias("n")).collect()
    return estimate(sorted((tuple(r["_votes"]), r["n"]) for r in counted))


def posterior(votes: Column, model: tuple[float, list[tuple[float, float]]]) -> Column:
    """Probability of being good; null without votes."""
    good, bad = (F.array(*[F.lit(w[k]) for w in model[1]]).cast("array<double>") for k in (0, 1))
    points = F.transform(votes, lambda v, j: F.when(v > 0, F.get(good, j)).when(v < 0, F.get(bad, j)).otherwise(0.0))
    return 1 / (1 + F.exp(-F.aggregate(points, F.lit(model[0]), lambda a, x: a + x)))


def judge(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id of each row with its measures, base_failed, quality (posterior) and kept.

    kept is false for base_failed rows, whose quality is null, else whether the quality
    reaches ``threshold``.  Null and empty texts have no words and fail.  Every row gets a
    row, repeated ones too; an empty table gives none.  Other columns of ``docs`` are ignored,
    whatever their names.
    """
    measured = docs.select(F.col(id_col).alias("_id"), measures(F.col(text_col)).alias("_m"))
    measured = Scratch(docs.sparkSession, "quality").keep("measures", measured).withColumn("_votes", votes_of(F.col("_m")))
    quality = posterior(F.col("_votes"), fit(measured))
    failed = base_failed(F.col("_m"))
    kept = F.coalesce(quality >= threshold, F.lit(False))
    return measured.select(F.col("_id").alias(id_col), "_m.*", failed.alias("base_failed"), quality.alias("quality"), kept.alias("kept"))


def keep_good(docs: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns.

    Texts are measured once: rows are written with their votes, and read again once the
    model is known.
    """
    measured = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), let(measures(docs[text_col]), votes_of).alias("_votes"))
    voted = Scratch(docs.sparkSession, "quality").keep("voted", measured)
    return voted.where(posterior(F.col("_votes"), fit(voted)) >= threshold).select("_row.*")
