"""What is seen from a place: view points, viewsheds, lines of sight and the time bins are in view.

Rays are sampled at equal steps, and a ray ends at its first step outside.  All rays of an
observer are followed where its row is: the bins of an arena are few enough to be with every
task, so no step is a row and nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import angles, geometry
from . import grid as grids
from . import timeseries as ts
from .grid import Grid, bin_at
from .trajectory import KEYS, ORDER


def view_point(x: Column, y: Column, heading: Column, distance: float) -> tuple[Column, Column]:
    """The point ``distance`` ahead."""
    return x + distance * F.cos(heading), y + distance * F.sin(heading)


class FieldOfView(NamedTuple):
    """How far to the left and right an animal sees, where both eyes do, and the blind sector behind; in radians."""

    left: float
    right: float
    binocular: float
    blind: float = 0.0

    def sees(self, bearing: Column) -> Column:
        return in_field_of_view(bearing, self.left, self.right, self.blind)

    def both_eyes(self, bearing: Column) -> Column:
        return self.sees(bearing) & (F.abs(angles.wrap(bearing)) <= self.binocular)


def symmetric(half_angle: float, binocular: float = 0.0, blind: float = 0.0) -> FieldOfView:
    return FieldOfView(half_angle, -half_angle, binocular, blind)


#: Half the field, the binocular half-angle and the blind sector behind, in degrees.
ANIMALS = {k: symmetric(*map(math.radians, v)) for k, v in {"rat": (160, 25, 20), "mouse": (155, 20, 25), "primate": (90, 60, 0)}.items()}


def visible_share(seen: DataFrame, grid: Grid, by: Sequence[str]) -> DataFrame:
    """(by, n, share): how many of all active bins each observer of a ``viewshed`` sees."""
    n_bins = grid.bins.agg(F.count("*").alias("all"))
    return seen.groupBy(*by).agg(F.countDistinct("bin_id").alias("n")).join(F.broadcast(n_bins)).select(*by, "n", (F.col("n") / F.col("all")).alias("share"))


def in_field_of_view(bearing: Column, left: float, right: float, blind: float = 0.0) -> Column:
    """Whether a bearing (in [-pi, pi)) lies between ``right`` and ``left`` and not in the rear sector of half-width ``blind``."""
    b = angles.wrap(bearing)
    return (b >= right) & (b <= left) & (F.abs(b) <= math.pi - blind)


#: Steps of rays that a task follows at once.
STEPS_AT_ONCE = 1 << 19


def viewshed(observers: DataFrame, grid: Grid, n_rays: int, half_angle: float, reach: float, n_steps: int = 100) -> DataFrame:
    """(the columns of ``observers``, bin_id) of every bin that an observer (x, y, heading) sees, once for each row of ``observers``."""
    direction = lambda r: F.col("heading") + (-half_angle + (r + 0.5) * (2 * half_angle / n_rays))
    rays = F.sequence(F.lit(0), F.lit(n_rays - 1))
    turned = {"_cos": F.transform(rays, lambda r: F.cos(direction(r))), "_sin": F.transform(rays, lambda r: F.sin(direction(r)))}
    d = observers.select("*", *[v.alias(k) for k, v in turned.items()])
    if grid.n_cells > grids.BROADCAST_BINS:
        return _joined_viewshed(d, observers.columns, grid, reach, n_steps)
    bin_of = np.full(grid.n_cells + 1, -1, dtype=np.int32)  # the last is outside
    for r in grid.bins.select("cell", "bin_id").toLocalIterator():
        bin_of[r.cell] = r.bin_id
    radii = np.arange(n_steps) * (reach / n_steps)
    at_once, names = max(1, STEPS_AT_ONCE // (n_rays * n_steps)), list(observers.columns)
    place = (grid.lo, grid.width, grid.shape)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, at_once):
                batch = whole.slice(k, at_once)
                x, y = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y"))
                cos, sin = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_rays) for c in ("_cos", "_sin"))
                counts, bins = _seen(x, y, cos, sin, radii, *place, bin_of)
                ends = np.append(0, np.cumsum(counts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.ListArray.from_arrays(pa.array(ends), pa.array(bins, pa.int64()))], names=[*names, "_bins"])

    schema = T.StructType([*observers.schema.fields, T.StructField("_bins", T.ArrayType(T.LongType()))])
    return d.mapInArrow(look, schema).select(*observers.columns, F.explode("_bins").alias("bin_id"))


def _seen(x: np.ndarray, y: np.ndarray, cos: np.ndarray, sin: np.ndarray, radii: np.ndarray, lo: tuple, width: tuple, shape: tuple, bin_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bins each observer sees, and the bins of all in their order."""
    ix = np.floor((x[:, None, None] + radii * cos[:, :, None] - lo[0]) / width[0])
    iy = np.floor((y[:, None, None] + radii * sin[:, :, None] - lo[1]) / width[1])
    inside = (ix >= 0) & (ix < shape[0]) & (iy >= 0) & (iy < shape[1])  # false where anything is missing
    bins = bin_of[np.where(inside, ix * shape[1] + iy, len(bin_of) - 1).astype(np.int64)]
    bins = np.where(np.logical_and.accumulate(bins >= 0, axis=2), bins, -1).reshape(len(x), -1)
    bins.sort(axis=1)
    new = bins >= 0
    new[:, 1:] &= bins[:, 1:] != bins[:, :-1]
    return new.sum(axis=1), bins[new]


def _joined_viewshed(rays: DataFrame, columns: Sequence[str], grid: Grid, reach: float, n_steps: int) -> DataFrame:
    """``viewshed`` over more cells than every task may hold: each step is a row that is joined to its bin."""
    d = rays.select(F.struct(*columns).alias("o"), F.monotonically_increasing_id().alias("row"), F.arrays_zip("_cos", "_sin").alias("vs"))
    d = d.select("o", "row", F.posexplode("vs").alias("ray", "v"))
    # All steps of a ray stay in one row until the first one outside is known.
    steps = F.transform(F.sequence(F.lit(0), F.lit(n_steps - 1)), lambda k: F.struct(k.alias("k"), (k * (reach / n_steps)).alias("r")))
    d = d.select("o", "row", "ray", "v", F.explode(steps).alias("s"))
    d = d.withColumns({"x": F.col("o.x") + F.col("s.r") * F.col("v._cos"), "y": F.col("o.y") + F.col("s.r") * F.col("v._sin")})
    d = bin_at(d, grid).select("o", "row", "ray", F.col("s.k").alias("k"), "bin_id")
    ends = F.coalesce(F.min(F.when(F.col("bin_id") < 0, F.col("k"))).over(Window.partitionBy("row", "ray")), F.lit(n_steps))
    return d.withColumn("end", ends).where("k < end").select("row", "o", "bin_id").distinct().select("o.*", "bin_id")


def clear_line(pairs: DataFrame, grid: Grid, n_samples: int = 20) -> DataFrame:
    """``pairs`` (x, y, to_x, to_y) with clear: whether all points sampled between lie in active bins."""
    row = F.struct(*pairs.columns)
    d = pairs.select(row.alias("o"), F.monotonically_increasing_id().alias("pair"))
    d = d.select("o", "pair", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("k"))
    at = F.col("k") / (n_samples - 1)
    d = d.withColumns({"x": F.col("o.x") + at * (F.col("o.to_x") - F.col("o.x")), "y": F.col("o.y") + at * (F.col("o.to_y") - F.col("o.y"))})
    return bin_at(d, grid).groupBy("pair", "o").agg(F.min(F.col("bin_id") >= 0).alias("clear")).select("o.*", "clear")


def visible_cues(observers: DataFrame, grid: Grid, cues: dict[str, tuple[float, float]], half_angle: float, n_samples: int = 20) -> DataFrame:
    """(the columns of ``observers``, cue) of each cue within the field of view and in clear line."""
    listed = F.array(*[F.struct(F.lit(n).alias("cue"), F.lit(a).alias("x"), F.lit(b).alias("y")) for n, (a, b) in sorted(cues.items())])
    d = observers.select(*observers.columns, F.explode(listed).alias("c"))
    d = d.select(*observers.columns, F.col("c.cue").alias("cue"), F.col("c.x").alias("to_x"), F.col("c.y").alias("to_y"))
    seen = geometry.bearing(F.col("x"), F.col("y"), F.col("heading"), F.col("to_x"), F.col("to_y"))
    return clear_line(d.where(F.abs(seen) <= half_angle), grid, n_samples).where("clear").drop("to_x", "to_y", "clear")


def view_occupancy(samples: DataFrame, grid: Grid, n_rays: int, half_angle: float, reach: float, n_steps: int = 100, span: float | None = None) -> DataFrame:
    """(bin_id, seconds): how long each bin was in view of samples (session, idx, t, x, y, heading)."""
    d = ts.with_next(samples, KEYS, ORDER, ("t",), span).withColumn("dt", F.col("next_t") - F.col("t")).where("dt is not null")
    seen = viewshed(d.select("session", "idx", "x", "y", "heading", "dt"), grid, n_rays, half_angle, reach, n_steps)
    return seen.groupBy("bin_id").agg(F.sum("dt").alias("seconds"))
