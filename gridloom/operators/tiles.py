"""Decoding without a posterior table: the rate matrix in tiles of bins, time in Arrow batches.

A task holds one tile (all units by at most ``TILE_CELLS`` / units bins) and streams time
bins past it, ``TIMES_AT_ONCE`` in one matrix product.  What leaves it for a time bin is one
row: its largest log-likelihood, where that is, and sums scaled by it.  Tiles are merged by
log-sum-exp, so that between tasks there are (time bins x tiles) rows and never (time bins x
bins).  With 100 units and 5,000 bins there are two tiles, and a task should need about 170 MB:
its tile twice (2 x 20 MB) and two products of 1,024 by 2,500 doubles (2 x 20 MB), the
batch, and what the products are made from.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rates in a tile at most.
TILE_CELLS = 250_000
#: Time bins in one matrix product.
TIMES_AT_ONCE = 1_024
#: Log-likelihoods this close to the largest count as equal to it; the first such bin is the best.
TIE = 1e-9

_TILE = "tile int, bins array<bigint>, xs array<double>, ys array<double>, log_rates binary, base array<double>"
_PART = "t_idx bigint, tile int, most double, best bigint, x double, y double, mass double, sum_x double, sum_y double, sum_ll double"


def _tiles(rates: DataFrame, bins: DataFrame, prior: DataFrame | None, units: DataFrame, n_units: int, dt: float, min_rate: float) -> DataFrame:
    """One row for each tile of consecutive active bins."""
    per_tile = max(1, TILE_CELLS // max(1, n_units))
    r = rates.select("unit", "bin_id", F.greatest(F.coalesce("rate", F.lit(0.0)), F.lit(min_rate)).alias("rate")).join(units, "unit")
    of_bin = r.groupBy("bin_id").agg(F.collect_list(F.struct("u", "rate")).alias("rates"))
    placed = bins.select("bin_id", "x", "y").join(of_bin, "bin_id")
    if prior is None:
        placed = placed.withColumn("log_prior", F.lit(0.0))
    else:
        total = F.sum("p").over(Window.partitionBy(F.lit(1)))
        q = prior.select("bin_id", F.log(F.greatest(F.col("p") / total, F.lit(1e-10))).alias("log_prior"))
        placed = placed.join(q, "bin_id")
    placed = placed.withColumn("tile", F.floor(F.col("bin_id") / per_tile).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["bin_id"])
        logs, base = np.zeros((n_units, len(rows))), np.zeros(len(rows))
        for k, row in enumerate(rows):
            rate = np.array([x["rate"] for x in row["rates"]]) * dt
            logs[[x["u"] for x in row["rates"]], k] = np.log(rate)
            base[k] = row["log_prior"] - rate.sum()
        column = lambda c: [[r[c] for r in rows]]
        values = [[rows[0]["tile"]], column("bin_id"), column("x"), column("y"), [logs.tobytes()], [base.tolist()]]
        kinds = [pa.int32(), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 2, pa.binary(), pa.list_(pa.float64())]
        return pa.table([pa.array(v, k) for v, k in zip(values, kinds)], names=["tile", "bins", "xs", "ys", "log_rates", "base"])

    return placed.groupBy("tile").applyInArrow(pack, _TILE)


class _Tile:
    def __init__(self, row: dict, n_units: int):
        self.number, self.bins = row["tile"], np.array(row["bins"])
        self.x, self.y, self.base = (np.array(row[c]) for c in ("xs", "ys", "base"))
        self.log_rates = np.frombuffer(row["log_rates"]).reshape(n_units, len(self.bins))

    def parts(self, times: list[int], fired: list[list[dict]]) -> pa.RecordBatch:
        n = np.zeros((len(times), len(self.log_rates)))
        for k, some in enumerate(fired):
            for f in some:
                n[k, f["u"]] += f["n"]
        ll = n @ self.log_rates + self.base
        most = ll.max(1)
        best = (ll >= (most - TIE)[:, None]).argmax(1)
        ll -= most[:, None]
        e = np.exp(ll)
        ll *= e
        columns = [np.array(times), np.full(len(times), self.number, np.int32), most, self.bins[best], self.x[best], self.y[best], e.sum(1), e @ self.x, e @ self.y, ll.sum(1)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _PART.split(", ")])


def _past_tiles(n_units: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, times, fired = None, [], []
        for batch in batches:
            for i in range(0, batch.num_rows, TIMES_AT_ONCE):
                for row in batch.slice(i, TIMES_AT_ONCE).to_pylist():
                    if row["tag"] == 0:
                        if times:
                            yield tile.parts(times, fired)
                            times, fired = [], []
                        tile = _Tile(row, n_units)
                        continue
                    times.append(row["t_idx"])
                    fired.append(row["fired"] or [])
                    if len(times) == TIMES_AT_ONCE:
                        yield tile.parts(times, fired)
                        times, fired = [], []
        if times:
            yield tile.parts(times, fired)

    return run


def decode_summary(counts: DataFrame, rates: DataFrame, bins: DataFrame, dt: float, prior: DataFrame | None = None, min_rate: float = 1e-10) -> DataFrame:
    """(t_idx, map_bin, map_x, map_y, mean_x, mean_y, entropy, peak) of every time bin in ``counts``.

    What ``decoding.estimates`` gives of ``decoding.posterior``: counts (t_idx, unit, n), rates
    (unit, bin_id, rate), bins (bin_id, x, y), prior (bin_id, p).  Missing rates count as
    ``min_rate``; a unit without rates is ignored; a bin without rates or without prior takes
    no part.  Time bins in which nobody fired are decoded as well.
    """
    spark = counts.sparkSession
    # The population's size: one row a unit.
    units = rates.select("unit").distinct().withColumn("u", (F.row_number().over(Window.orderBy("unit")) - 1).cast("int"))
    n_units = units.count()
    tiles = _tiles(rates, bins, prior, units, n_units, dt, min_rate)
    last = bins.agg(F.max("bin_id")).first()[0]
    if last is None or not n_units:
        return spark.createDataFrame([], "t_idx bigint, map_bin bigint, map_x double, map_y double, mean_x double, mean_y double, entropy double, peak double")
    n_tiles = last // max(1, TILE_CELLS // n_units) + 1
    shards = max(1, 2 * spark.sparkContext.defaultParallelism // n_tiles)
    heard = counts.where("n > 0").join(units, "unit").groupBy("t_idx").agg(F.collect_list(F.struct("u", "n")).alias("fired"))
    times = counts.select("t_idx").distinct().join(heard, "t_idx", "left").select(F.col("t_idx").cast("long"), F.expr("transform(fired, f -> struct(f.u as u, cast(f.n as double) as n))").alias("fired"))
    names = [c.split()[0] for c in _TILE.split(", ")]
    to_times = tiles.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).alias("tag"), *names, F.lit(None).cast("long").alias("t_idx"), F.lit(None).cast("array<struct<u:int,n:double>>").alias("fired"))
    none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _TILE.split(", ")[1:]]
    to_tiles = times.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(int(n_tiles) - 1)))).select(F.pmod(F.xxhash64("t_idx"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("tag"), "tile", *none, "t_idx", "fired")
    both = to_times.select("shard", "tag", *names, "t_idx", "fired").union(to_tiles.select("shard", "tag", *names, "t_idx", "fired"))
    met = both.repartition(int(n_tiles * shards), "tile", "shard").sortWithinPartitions("tile", "shard", "tag")
    parts = met.mapInArrow(_past_tiles(n_units), _PART)

    # One row for each tile of a time bin.
    rest = [c.split()[0] for c in _PART.split(", ")[1:]]
    m = parts.groupBy("t_idx").agg(F.max("most").alias("most"), F.collect_list(F.struct(*rest)).alias("parts"))

    def total(of: Callable[[Column], Column]) -> Column:
        return F.aggregate("parts", F.lit(0.0), lambda s, p: s + F.exp(p["most"] - F.col("most")) * of(p))

    mass = total(lambda p: p["mass"])
    winner = F.array_min(F.transform(F.filter("parts", lambda p: p["most"] >= F.col("most") - TIE), lambda p: F.struct(p["best"].alias("best"), p["x"].alias("x"), p["y"].alias("y"))))
    m = m.select("t_idx", "most", "parts", mass.alias("mass"), winner.alias("m"))
    spread = total(lambda p: p["sum_ll"] + p["mass"] * (p["most"] - F.col("most")))
    return m.select(
        "t_idx", F.col("m.best").alias("map_bin"), F.col("m.x").alias("map_x"), F.col("m.y").alias("map_y"),
        (total(lambda p: p["sum_x"]) / F.col("mass")).alias("mean_x"), (total(lambda p: p["sum_y"]) / F.col("mass")).alias("mean_y"),
        (F.log2("mass") - spread / F.col("mass") / math.log(2)).alias("entropy"), (1 / F.col("mass")).alias("peak"),
    )
