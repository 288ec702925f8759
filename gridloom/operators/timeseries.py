"""Neighbouring rows, as-of joins, interpolation and interval joins over time-ordered tables.

Tables are keyed (a session, a unit) and ordered by a time column.  With ``span`` the rows
of a key are cut into stretches of time that tasks share, so that one key with very many
rows does not end in one task; what a stretch needs from its neighbours is a summary row
for each stretch.  Without it, a key is one window partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _stretch(t: str, span: float | None) -> Column:
    return F.floor(F.col(t) / span) if span else F.lit(0).cast("long")


def with_neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], prefix: str, following: bool, span: float | None = None) -> DataFrame:
    """``df`` with the ``columns`` of the next (or previous) row of the same keys, named with ``prefix``.

    ``order`` begins with the time column; null at the end (or start) of a key.
    """
    cut = df.withColumn("_cut", _stretch(order[0], span))
    values = F.struct(*columns)
    near = (F.lead if following else F.lag)(values).over(Window.partitionBy(*keys, "_cut").orderBy(*order))
    cut = cut.withColumn("_near", near)
    if span:
        pick = F.min_by if following else F.max_by
        edges = cut.groupBy(*keys, "_cut").agg(pick(values, F.struct(*order)).alias("_edge"))
        move = F.lead if following else F.lag
        edges = edges.select(*keys, "_cut", move("_edge").over(Window.partitionBy(*keys).orderBy("_cut")).alias("_beyond"))
        cut = cut.join(edges, [*keys, "_cut"]).withColumn("_near", F.coalesce("_near", "_beyond"))
    return cut.select(*df.columns, *[F.col(f"_near.{c}").alias(f"{prefix}{c}") for c in columns])


def with_next(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], span: float | None = None) -> DataFrame:
    return with_neighbour(df, keys, order, columns, "next_", True, span)


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], span: float | None = None) -> DataFrame:
    return with_neighbour(df, keys, order, columns, "prev_", False, span)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, span: float | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row."""
    cut = df.withColumn("_cut", _stretch(order[0], span)).withColumn("_value", value)
    rows = Window.partitionBy(*keys, "_cut").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn(out, F.sum("_value").over(rows))
    if span:
        sums = cut.groupBy(*keys, "_cut").agg(F.sum("_value").alias("_sum"))
        earlier = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(*keys, "_cut", F.sum("_sum").over(earlier).alias("_before"))
        total = F.when(F.col(out).isNull() & F.col("_before").isNull(), None).otherwise(F.coalesce(F.col(out), F.lit(0)) + F.coalesce("_before", F.lit(0)))
        cut = cut.join(sums, [*keys, "_cut"]).withColumn(out, total)
    return cut.drop("_cut", "_value", "_before")


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, backward: bool = True, span: float | None = None) -> DataFrame:
    """``df`` with the last ``value`` that is not null up to and with each row (the first from it on)."""
    cut = df.withColumn("_cut", _stretch(order[0], span)).withColumn("_value", value)
    rows = Window.partitionBy(*keys, "_cut").orderBy(*order)
    if backward:
        found = F.last("_value", ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, 0))
    else:
        found = F.first("_value", ignorenulls=True).over(rows.rowsBetween(0, Window.unboundedFollowing))
    cut = cut.withColumn(out, found)
    if span:
        edge = (F.max_by if backward else F.min_by)("_value", F.when(F.col("_value").isNotNull(), F.struct(*order)))
        edges = cut.groupBy(*keys, "_cut").agg(edge.alias("_edge"))
        stretches = Window.partitionBy(*keys).orderBy("_cut")
        if backward:
            beyond = F.last("_edge", ignorenulls=True).over(stretches.rowsBetween(Window.unboundedPreceding, -1))
        else:
            beyond = F.first("_edge", ignorenulls=True).over(stretches.rowsBetween(1, Window.unboundedFollowing))
        cut = cut.join(edges.select(*keys, "_cut", beyond.alias("_beyond")), [*keys, "_cut"]).withColumn(out, F.coalesce(out, "_beyond"))
    return cut.drop("_cut", "_value", "_beyond")


#: Rows of a key that one task goes through for a moving mean.
ROWS = 65_536


def moving_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, half: int, out: str, span: float | None = None, rows: int = ROWS) -> DataFrame:
    """``df`` with the mean of ``value`` over the rows up to ``half`` before and after each.

    A key's rows are numbered and cut into stretches of ``rows``; rows near an end are copied
    to the stretch beyond.  Null values are left out, and a mean of none is null.
    """
    numbered = running_sum(df.withColumn("_v", value), keys, order, F.lit(1), "_n", span)
    own = F.floor(F.col("_n") / rows)
    around = F.sequence(F.floor((F.col("_n") - half) / rows), F.floor((F.col("_n") + half) / rows))
    placed = numbered.withColumn("_own", own).withColumn("_piece", F.explode(around))
    near = Window.partitionBy(*keys, "_piece").orderBy("_n").rowsBetween(-half, half)
    return placed.withColumn(out, F.avg("_v").over(near)).where("_own = _piece").drop("_v", "_n", "_own", "_piece")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, columns: Sequence[str], prefix: str = "prev_", backward: bool = True, strict: bool = False, span: float | None = None) -> DataFrame:
    """``left`` with the ``columns`` of the last row of ``right`` at or before ``t`` (first at or after it).

    ``strict`` leaves out rows at the same time.  All rows of ``left`` stay; null where
    ``right`` has none.  Of equal times of ``right`` the largest (smallest) ``columns`` count.
    """
    both = left.select(*keys, t, F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(F.struct(*columns).alias("s")).schema["s"].dataType).alias("_seen"))
    other = right.select(*keys, t, F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), F.struct(*columns).alias("_seen"))
    # Which comes first at equal times decides whether ties are seen.
    tie = (F.col("_row").isNotNull() if backward != strict else F.col("_row").isNull()).cast("int")
    both = both.unionByName(other).withColumn("_tie", tie).withColumn("_cut", _stretch(t, span))
    order = Window.partitionBy(*keys, "_cut").orderBy(t, "_tie", "_seen")
    if backward:
        seen = F.last("_seen", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    else:
        seen = F.first("_seen", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumn("_found", seen)
    if span:
        pick = F.max_by if backward else F.min_by
        edge = pick("_seen", F.when(F.col("_seen").isNotNull(), F.struct(t, "_seen")))
        edges = both.groupBy(*keys, "_cut").agg(edge.alias("_edge"))
        stretches = Window.partitionBy(*keys).orderBy("_cut")
        if backward:
            beyond = F.last("_edge", ignorenulls=True).over(stretches.rowsBetween(Window.unboundedPreceding, -1))
        else:
            beyond = F.first("_edge", ignorenulls=True).over(stretches.rowsBetween(1, Window.unboundedFollowing))
        both = both.join(edges.select(*keys, "_cut", beyond.alias("_beyond")), [*keys, "_cut"]).withColumn("_found", F.coalesce("_found", "_beyond"))
    return both.where("_row is not null").select("_row.*", *[F.col(f"_found.{c}").alias(f"{prefix}{c}") for c in columns])


def interpolate(left: DataFrame, samples: DataFrame, keys: Sequence[str], t: str, columns: Sequence[str], span: float | None = None) -> DataFrame:
    """``left`` with ``columns`` of ``samples`` interpolated at ``t``; null outside the samples of a key."""
    found = asof(left, samples, keys, t, [t, *columns], "prev_", True, False, span)
    found = asof(found, samples, keys, t, [t, *columns], "next_", False, False, span)
    share = F.coalesce(F.try_divide(F.col(t) - F.col(f"prev_{t}"), F.col(f"next_{t}") - F.col(f"prev_{t}")), F.lit(0.0))
    at = [(F.col(f"prev_{c}") + share * (F.col(f"next_{c}") - F.col(f"prev_{c}"))).alias(f"at_{c}") for c in columns]
    return found.select("*", *at)


def interval_join(points: DataFrame, intervals: DataFrame, t: str, start: str, stop: str, width: float, keys: Sequence[str] = (), how: str = "inner", closed: str = "both") -> DataFrame:
    """Points within intervals: an equi-join on cells of ``width``, then the exact test.

    ``how``: inner, left_semi or left_anti; ``closed``: both, left, right or neither.  Each
    interval has a row for each cell that it meets; choose ``width`` near their length.
    """
    p = points.withColumn("_cell", F.floor(F.col(t) / width))
    cells = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))
    i = intervals.where(F.col(stop) >= F.col(start)).withColumn("_icell", F.explode(cells))
    renamed = [F.col(k).alias(f"_i_{k}") for k in keys]
    i = i.select(*[c for c in i.columns if c not in keys], *renamed)
    after = F.col(t) >= F.col(start) if closed in ("both", "left") else F.col(t) > F.col(start)
    before = F.col(t) <= F.col(stop) if closed in ("both", "right") else F.col(t) < F.col(stop)
    on = (F.col("_cell") == F.col("_icell")) & after & before
    for k in keys:
        on = on & (F.col(k) == F.col(f"_i_{k}"))
    return p.join(i, on, how).drop("_cell", "_icell", *[f"_i_{k}" for k in keys])
