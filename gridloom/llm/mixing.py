"""Mixing sources to target weights.

Each document gets a hash-random key.  Within a source, documents are range-partitioned
and sorted by that key, token counts are summed as distributed prefix sums, and the order
is cut at the source's exact budget; a budget of more than the source holds repeats it in
further epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_dir

#: A word: characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a range of keys holds on average; what one sort and prefix sum works on.
ROWS_A_RANGE = 5_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """``sizes`` (source, source_size, ...; one row a source) with ``target``.

    Sources in code-point order, null last, take ``weights`` in turn.  The mix has
    ``share`` of all tokens; a target stops at ``max_epochs`` times its source's size and
    the excess goes to the others by weight until none is above.  That is the level L where
    sum(min(cap, L * weight)) meets the total, found from prefix sums over cap / weight.
    The windows run over one row per source.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    s = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("_level", F.col("_cap") / F.col("_w"))
    whole = Window.partitionBy(F.lit(1))
    order = whole.orderBy("_level", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("_total", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("_cap_before", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_w_from", F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_l", (F.col("_total") - F.col("_cap_before")) / F.col("_w_from"))
    )
    # The first source whose cap the level doesn't reach settles it; with none, all are capped.
    level = F.min_by(F.when(F.col("_l") <= F.col("_level"), F.col("_l")), F.when(F.col("_l") <= F.col("_level"), F.col("_level"))).over(whole)
    target = F.coalesce(F.least("_cap", level * F.col("_w")), F.col("_cap"))
    return s.select(*sizes.columns, target.alias("target"))


def hash_key(id_col: Column, source: Column, seed: int) -> Column:
    """A uniform random integer below 2**52, the same in every run."""
    parts = [F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in (id_col, source))]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


def _planned(
    docs: DataFrame,
    carry: Column,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    share: float = 1.0,
    max_epochs: float = 3.0,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 0,
) -> DataFrame:
    """id, source, size, source_size, target and taken of each row, and ``carry`` as row."""
    key = hash_key(F.col(id_col), F.col(source_col), seed)
    base = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key")]
    shared_dir(docs.sparkSession)
    # A few numbers a row; three steps read them, and the texts are scanned for them once.
    counted = docs.select(*base).checkpoint()
    sizes = counted.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    targets = source_targets(sizes, weights, share, max_epochs)
    # Keys are uniform, so equal ranges of them hold about as many rows; a large source has
    # more ranges.
    targets = targets.select(
        F.col("source").alias("s"), "source_size", "target", F.ceil(F.col("_rows") / F.lit(float(ROWS_A_RANGE))).alias("_ranges")
    )
    key_range = F.floor(F.col("key") / F.lit(float(1 << 52)) * F.col("_ranges"))
    in_source = F.col("source").eqNullSafe(F.col("s"))
    # Ranges and their sums: one summary row for each ROWS_A_RANGE documents.
    sums = counted.join(targets, in_source).groupBy("s", key_range.alias("r")).agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("s").alias("_s"), "r", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))

    rows = counted.withColumn("row", F.lit(None)) if carry is None else docs.select(*base, carry.alias("row"))
    placed = rows.join(targets, in_source).withColumn("range", key_range)
    order = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_here", F.coalesce(F.sum("size").over(order), F.lit(0)))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("r")))
    # Whole epochs for all; then the order is cut where the rest of the budget ends.
    budget = F.floor(F.col("target") + F.lit(1e-6))
    epochs = F.floor(F.try_divide(budget, F.col("source_size")))
    rest = budget - epochs * F.col("source_size")
    last = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("_offset") - F.col("_here")))
    taken = F.coalesce(epochs * F.col("size") + last, F.lit(0)).cast("long")
    return placed.select("id", "source", "size", "source_size", "target", taken.alias("taken"), "row")


def plan_mix(docs: DataFrame, **options) -> DataFrame:
    """What the mix takes of each row of ``docs``.

    Options: ``weights`` (taken in turn by the sources in code-point order, null last),
    ``share`` (of all words, that the mix has), ``max_epochs``, ``source_col``, ``id_col``,
    ``text_col``, ``seed``.  Returns id, source, size (words; null texts 0), source_size,
    target (its source's) and taken: words over all epochs, that is taken // size whole
    repeats and a last one of taken % size words.  A source's taken words are its target
    rounded down.  Null sources are one source; an empty table gives no rows; repeated rows
    are rows of their own.  The order is a hash of id, source and seed, so reruns agree.
    """
    return _planned(docs, None, **options).drop("row")


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word."""
    words = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: the columns of ``docs``, a row for each time a document is taken.

    The text where a source's budget ends is cut after the last word taken, so that words
    taken meet the budget exactly.  Documents without words are never taken.  Takes the
    options of ``plan_mix``.
    """
    text_col = options.get("text_col", "text")
    plan = _planned(docs, F.struct(*[F.col(c) for c in docs.columns]), **options).where("taken > 0")
    plan = plan.select("row", "size", F.explode(F.sequence(F.col("taken"), F.lit(1), -F.col("size"))).alias("left"))
    text = F.col(f"row.{text_col}")
    cut = F.when(F.col("left") < F.col("size"), first_words(text, F.col("left"))).otherwise(text)
    return plan.select(*[(cut if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
