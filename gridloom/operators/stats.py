"""Shuffles, surrogates and tests against them.  Draws are seeded hashes, so reruns agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import timeseries as ts


def uniform(*what: Column, seed: int = 0) -> Column:
    """A number from 0 to 1 (exclusive), fixed by ``what`` and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *what), 11) / float(1 << 53)


def p_value(null: DataFrame, observed: float, tail: str = "greater") -> DataFrame:
    """(p, z, n) of ``observed`` among null (score)."""
    n = F.count("*")
    high, low = (F.count_if(F.col("score") >= observed) + 1) / (n + 1), (F.count_if(F.col("score") <= observed) + 1) / (n + 1)
    p = {"greater": high, "less": low, "two-sided": F.least(F.lit(1.0), 2 * F.least(high, low))}[tail]
    return null.agg(p.alias("p"), F.try_divide(observed - F.avg("score"), F.nullif(F.stddev_pop("score"), F.lit(0.0))).alias("z"), n.alias("n"))


#: Pieces of a draw from 0 to 1 that the rows of a shuffled group are numbered in.
PIECES = 256


def permuted(df: DataFrame, value: str, by: Sequence[str], row: str, n_shuffles: int, seed: int = 0, span: float | None = None, pieces: int = PIECES) -> DataFrame:
    """``df`` with shuffle, the values of each group dealt to its rows in another order, ``n_shuffles`` times.

    Rows are numbered by ``row``, in stretches of ``span`` of it where it is a number, and
    dealt values by a draw, in ``pieces`` of it; both numbers meet in a join of two shuffled
    sides, as either is as large as the data.
    """
    others = [c for c in df.columns if c != value]
    rows = ts.running_sum(df.select(*others), by, (row,), F.lit(1), "_at", span)
    d = df.select(*by, row, value).withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(n_shuffles - 1))))
    draw = uniform(F.col("shuffle"), F.col(row), *[F.col(c) for c in by], seed=seed)
    dealt = ts.running_sum(d.withColumn("_draw", draw), ["shuffle", *by], ("_draw", row), F.lit(1), "_at", 1.0 / pieces)
    return dealt.select("shuffle", *by, "_at", value).join(rows.hint("merge"), [*by, "_at"]).select("shuffle", *df.columns)


def circular_shift(df: DataFrame, position: str, n: int, by: Sequence[str], n_shuffles: int, seed: int = 0) -> DataFrame:
    """``df`` with shuffle and ``position`` moved round by one draw for each shuffle and group."""
    d = df.withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(n_shuffles - 1))))
    move = F.floor(uniform(F.col("shuffle"), *[F.col(c) for c in by], seed=seed) * n)
    return d.withColumn(position, F.pmod(F.col(position) + move, F.lit(n)))


def jittered(spikes: DataFrame, width: float, n: int, seed: int = 0) -> DataFrame:
    """(surrogate, unit, t): each spike moved by a normal draw of deviation ``width``."""
    d = spikes.withColumn("surrogate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    what = [F.col("surrogate"), F.col("unit"), F.col("t")]
    normal = F.sqrt(-2 * F.log(1 - uniform(*what, seed=seed))) * F.cos(2 * 3.141592653589793 * uniform(*what, seed=seed + 1))
    return d.select("surrogate", "unit", (F.col("t") + width * normal).alias("t"))


def shuffled_intervals(spikes: DataFrame, n: int, seed: int = 0, pieces: int = 64) -> DataFrame:
    """(surrogate, unit, t): trains with the same first spike and the same intervals in another order.

    The order is that of a draw from 0 to 1 for each interval, and sums run over stretches of
    one of ``pieces`` of it, so that a unit of any number of spikes is spread.  Spikes at one
    time draw alike, and their intervals of 0 come in any order.
    """
    d = ts.with_previous(spikes.select("unit", "t", F.monotonically_increasing_id().alias("idx")), ("unit",), ("t", "idx"), ("t",))
    first = d.groupBy("unit").agg(F.min("t").alias("t0"))
    gaps = d.where("prev_t is not null").select("unit", (F.col("t") - F.col("prev_t")).alias("gap"), "t")
    gaps = gaps.withColumn("surrogate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    gaps = gaps.withColumn("draw", uniform(F.col("surrogate"), F.col("unit"), F.col("t"), seed=seed))
    summed = ts.running_sum(gaps, ("surrogate", "unit"), ("draw", "t", "gap"), F.col("gap"), "s", 1.0 / pieces)
    start = first.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("surrogate"), "unit", F.col("t0").alias("t"))
    return summed.join(first, "unit").select("surrogate", "unit", (F.col("t0") + F.col("s")).alias("t")).union(start)


def poisson_counts(frame: DataFrame, rate: Column, seed: int = 0, most: int = 64) -> Column:
    """A Poisson draw of mean ``rate`` for each row of ``frame``, by its t_idx and unit: steps of the distribution up to ``most``."""
    u = uniform(F.col("t_idx"), F.col("unit"), seed=seed)
    zero = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("c"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.when(u > s["c"], F.struct(k.alias("k"), p.alias("p"), (s["c"] + p).alias("c"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), zero, step, lambda s: s["k"])


def moving_rate(counts: DataFrame, half: int, span: float = 65_536) -> DataFrame:
    """``counts`` (t_idx, unit, n) with the mean of the bins up to ``half`` away; ``span`` bins of a unit are numbered at a time."""
    return ts.moving_mean(counts, ("unit",), ("t_idx",), F.col("n"), half, "rate", span)
