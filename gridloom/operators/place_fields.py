"""Place fields within place fields: a component tree of each rate map over a few thresholds."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fast_units(rates: DataFrame, max_mean_rate: float = 10.0) -> DataFrame:
    """(unit, mean_rate, fast): units whose mean over bins is above ``max_mean_rate``, as that of interneurons is."""
    m = rates.where("rate is not null").groupBy("unit").agg(F.avg("rate").alias("mean_rate"))
    return m.select("unit", "mean_rate", (F.col("mean_rate") > max_mean_rate).alias("fast"))


def _grown(seed: int, above: set[int], links: dict[int, list[int]]) -> set[int]:
    found, edge = {seed}, [seed]
    while edge:
        edge = [b for a in edge for b in links[a] if b in above and b not in found and not found.add(b)]
    return found


def _parts(bins: set[int], level: float, rate: dict[int, float], links: dict[int, list[int]], min_size: int) -> list[set[int]]:
    """Components of the bins of a field at or above ``level`` that have ``min_size`` bins, the one of the highest peak first."""
    above, parts = {b for b in bins if rate[b] >= level}, []
    for b in sorted(above, key=lambda b: (-rate[b], b)):
        if not any(b in p for p in parts):
            parts.append(_grown(b, above, links))
    return [p for p in parts if len(p) >= min_size]


def _fields(rate: dict[int, float], links: dict[int, list[int]], threshold: float, min_size: int, levels: Sequence[float]) -> list[set[int]]:
    left, fields = dict(rate), []
    while left:
        peak = min(left, key=lambda b: (-left[b], b))
        top = left[peak]
        if top <= 0:
            break
        field = _grown(peak, {b for b, r in left.items() if r >= top * threshold}, links)
        for b in field:
            left[b] = 0.0
        if len(field) < min_size:
            continue
        inner = next((p for k in levels if len(field) > 2 * min_size and len(p := _parts(field, top * k, rate, links, min_size)) > 1), None)
        fields += inner or [field]
        if max(left.values()) < top * threshold:
            break
    return fields


def place_fields(
    rates: DataFrame, edges: DataFrame, threshold: float = 0.2, min_size: int = 9, max_mean_rate: float = 10.0, levels: Sequence[float] = (0.5, 0.7)
) -> DataFrame:
    """(unit, field, bin_id): fields of each unit, numbered from 0 in the order of their peaks.

    The bins that are linked to the highest peak at ``threshold`` of it or more are a field,
    if they are at least ``min_size``; then those of the highest peak that is left, until none
    reaches ``threshold`` of the last.  A field of more than twice ``min_size`` bins that
    falls apart into several of ``min_size`` at one of ``levels`` of its peak, the first that
    does it, is these.  Fast units (``fast_units``) have none.  A unit's map with its links is
    one small table, whose size is that of the layout; units are dealt to tasks.
    """
    near = edges.groupBy(F.col("src").alias("bin_id")).agg(F.collect_list("dst").alias("near"))
    slow = fast_units(rates, max_mean_rate).where("not fast").select("unit")
    maps = rates.where("rate is not null").join(slow, "unit", "left_semi").join(near, "bin_id", "left").select("unit", "bin_id", F.col("rate").cast("double"), "near")

    def find(rows: pa.Table) -> pa.Table:
        ids = rows.column("bin_id").to_pylist()
        rate = dict(zip(ids, rows.column("rate").to_pylist()))
        links = {b: [n for n in near or () if n in rate] for b, near in zip(ids, rows.column("near").to_pylist())}
        found = [(k, b) for k, f in enumerate(_fields(rate, links, threshold, min_size, levels)) for b in sorted(f)]
        unit = rows.column("unit")
        columns = [pa.array(unit[:1].to_pylist() * len(found), unit.type), pa.array([k for k, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())]
        return pa.table(columns, names=["unit", "field", "bin_id"])

    return maps.groupBy("unit").applyInArrow(find, f"unit {rates.schema['unit'].dataType.simpleString()}, field long, bin_id long")
