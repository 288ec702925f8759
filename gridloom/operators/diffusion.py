"""Heat on any layout by finite volumes, and polynomial filters of a Laplacian.

A link of two bins has a ``face`` (what they share) and a ``distance``; a bin has an area,
its volume.  Heat flows over a link by face / distance and changes a bin by what flows in
over its volume.  exp(-t A) of that operator A is a Chebyshev series, whose terms come from
each other by one sparse product: a join of the field with the links, and a sum.  No kernel
is built, the series holds for any time, and its degree follows from time and tolerance.
Rows of several fields, told apart by key columns, go through together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .fields import components

#: What the first term left out may weigh.
TOLERANCE = 1e-12
#: Degrees in one job.
DEGREES_AT_ONCE = 6
#: Denominators of smoothed fields are this at least.
LEAST = 1e-12


# Faces of each layout


def _ends(bins: DataFrame, edges: DataFrame, *columns: str) -> DataFrame:
    at = lambda k: bins.select(F.col("bin_id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in columns])
    return edges.select("src", "dst", "distance").join(at("src"), "src").join(at("dst"), "dst")


def grid_faces(bins: DataFrame, edges: DataFrame, width: tuple[float, float]) -> DataFrame:
    """(src, dst, distance, face) of a regular grid; diagonal neighbours share none and have no row."""
    e = _ends(bins, edges, "ix", "iy")
    across, along = F.col("src_ix") != F.col("dst_ix"), F.col("src_iy") != F.col("dst_iy")
    face = F.when(across & ~along, F.lit(float(width[1]))).when(along & ~across, F.lit(float(width[0])))
    return e.select("src", "dst", "distance", face.alias("face")).where("face is not null")


def hex_faces(edges: DataFrame) -> DataFrame:
    """(src, dst, distance, face) of hexagons: a side is the distance of centers over the root of 3."""
    return edges.select("src", "dst", "distance", (F.col("distance") / math.sqrt(3)).alias("face"))


def polar_faces(bins: DataFrame, edges: DataFrame, n_angles: int) -> DataFrame:
    """(src, dst, distance, face) of polar bins: an arc between rings, and a ring's width between bearings."""
    e = _ends(bins, edges, "distance", "i_angle", "i_distance", "area")
    turn = 2 * math.pi / n_angles
    arc = (F.col("src_distance") + F.col("dst_distance")) / 2 * turn
    # A ring of width w at radius r has bins of area r * w * turn.
    ring = F.col("src_area") / (F.col("src_distance") * turn)
    face = F.when(F.col("src_i_angle") == F.col("dst_i_angle"), arc).when(F.col("src_i_distance") == F.col("dst_i_distance"), ring)
    return e.select("src", "dst", "distance", face.alias("face")).where("face is not null")


def track_faces(bins: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, distance, face) of track bins: one section everywhere, and the way along the track where segments meet.

    The volume of a track bin is its ``length``.
    """
    e = _ends(bins, edges, "segment", "length")
    along = (F.col("src_length") + F.col("dst_length")) / 2
    return e.select("src", "dst", F.when(F.col("src_segment") == F.col("dst_segment"), F.col("distance")).otherwise(along).alias("distance"), F.lit(1.0).alias("face"))


# Laplacians as rows (src, dst, w), with the diagonal


def _with_diagonal(off: DataFrame, bins: DataFrame) -> DataFrame:
    """Rows of a Laplacian from what leaves a bin by each link (src, dst, w)."""
    out = off.groupBy("src").agg(F.sum("w").alias("w"))
    whole = bins.select(F.col("bin_id").alias("src")).join(out, "src", "left").select("src", F.col("src").alias("dst"), F.coalesce("w", F.lit(0.0)).alias("w"))
    return off.select("src", "dst", (-F.col("w")).alias("w")).union(whole)


def graph_laplacian(bins: DataFrame, edges: DataFrame, weight: str = "distance") -> DataFrame:
    """Degrees less weights of the links, the weight being the column ``weight``."""
    return _with_diagonal(edges.select("src", "dst", F.col(weight).alias("w")), bins)


def heat_laplacian(bins: DataFrame, faces: DataFrame, volume: str = "area") -> DataFrame:
    """Of heat flow: what leaves a bin over each face, by its volume."""
    of = bins.select(F.col("bin_id").alias("src"), F.col(volume).alias("_v"))
    return _with_diagonal(faces.join(of, "src").select("src", "dst", (F.col("face") / F.col("distance") / F.col("_v")).alias("w")), bins)


def spectral_bound(laplacian: DataFrame) -> float:
    """A bound of the largest eigenvalue: twice the largest diagonal entry (Gershgorin)."""
    return 2 * (laplacian.where("src = dst").agg(F.max("w")).first()[0] or 0.0)


# Polynomials of a Laplacian


def series(f: Callable[[np.ndarray], np.ndarray], top: float, tolerance: float = TOLERANCE, most: int = 4096) -> list[float]:
    """Chebyshev coefficients of ``f`` on [0, top], up to the last that is not below ``tolerance``."""
    n = 64
    while True:
        at = (np.arange(n) + 0.5) * math.pi / n
        values = f((np.cos(at) + 1) * top / 2)
        c = 2 / n * np.cos(np.outer(np.arange(n), at)) @ values
        c[0] /= 2
        large = np.flatnonzero(np.abs(c) > tolerance * max(1.0, np.abs(c).max()))
        if not len(large) or large[-1] < n // 2 or n >= most:
            return c[: large[-1] + 1].tolist() if len(large) else [0.0]
        n *= 2


def filtered(field: DataFrame, laplacian: DataFrame, top: float, coefficients: Sequence[Sequence[float]], by: Sequence[str] = ()) -> DataFrame:
    """(by, bin_id, o0, o1, ...) of ``field`` (by, bin_id, v): each output a Chebyshev series of the Laplacian applied to v.

    Bins that a series doesn't reach have no row; a Laplacian needs its diagonal.  Each degree
    is a join with the links and a sum; every few of them are written in place of the last.
    """
    spark, keys, n = field.sparkSession, [*by, "bin_id"], len(coefficients)
    scratch = Scratch(spark, "filter")
    degree = max(map(len, coefficients)) - 1
    at = lambda j, k: float(coefficients[j][k]) if k < len(coefficients[j]) else 0.0
    scale = 2 / top if top else 0.0
    w = F.col("w") * scale - F.when(F.col("src") == F.col("dst"), 1.0).otherwise(0.0)
    # A bin sends its value over each link, and to itself what it keeps.
    sent = laplacian.select(F.col("dst").alias("bin_id"), F.col("src").alias("to"), w.alias("w"), F.lit(False).alias("stay"))
    kept = laplacian.where("src = dst").select(F.col("src").alias("bin_id"), F.col("src").alias("to"), F.lit(0.0).alias("w"), F.lit(True).alias("stay"))
    links = scratch.keep("links", sent.union(kept))
    outs = [f"o{j}" for j in range(n)]
    state = field.select(*keys, F.col("v").alias("now"), F.lit(0.0).alias("before"), *[(F.col("v") * at(j, 0)).alias(o) for j, o in enumerate(outs)])
    written = ""
    for k in range(1, degree + 1):
        moved = state.join(links, "bin_id").select(
            *by, F.col("to").alias("bin_id"),
            F.when(F.col("stay"), -F.col("before")).otherwise((1 if k == 1 else 2) * F.col("w") * F.col("now")).alias("now"),
            F.when(F.col("stay"), F.col("now")).otherwise(0.0).alias("before"),
            *[F.when(F.col("stay"), F.col(o)).otherwise(0.0).alias(o) for o in outs],
        )
        summed = moved.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("now", "before", *outs)])
        state = summed.select(*keys, "now", "before", *[(F.col(o) + at(j, k) * F.col("now")).alias(o) for j, o in enumerate(outs)])
        if k % DEGREES_AT_ONCE == 0 or k == degree:
            state = scratch.keep(f"degree-{k}", state)
            scratch.drop(*[written] * bool(written))
            written = f"degree-{k}"
    scratch.drop("links")
    return state.select(*keys, *outs)


def chebyshev_basis(centers: DataFrame, laplacian: DataFrame, max_degree: int, top: float | None = None) -> DataFrame:
    """(center, degree, bin_id, v): the Chebyshev polynomials of the scaled Laplacian at each of ``centers`` (bin_id).

    A polynomial of degree k is 0 beyond k links, and has no row there.
    """
    top = spectral_bound(laplacian) if top is None else top
    one_hot = [[float(i == k) for i in range(max_degree + 1)] for k in range(max_degree + 1)]
    field = centers.select(F.col("bin_id").alias("center"), "bin_id", F.lit(1.0).alias("v"))
    d = filtered(field, laplacian, top, one_hot, ["center"])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("degree"), F.col(f"o{k}").alias("v")) for k in range(max_degree + 1)]))
    return d.select("center", "bin_id", pairs.alias("p")).select("center", "p.degree", "bin_id", "p.v")


def heat_wavelets(centers: DataFrame, laplacian: DataFrame, scales: Sequence[float] = (0.5, 1.0, 2.0, 4.0), top: float | None = None) -> DataFrame:
    """(center, scale, bin_id, v): exp(-scale * Laplacian) at each of ``centers`` (bin_id), all scales in one series."""
    top = spectral_bound(laplacian) if top is None else top
    coefficients = [series(lambda x, s=s: np.exp(-s * x), top) for s in scales]
    field = centers.select(F.col("bin_id").alias("center"), "bin_id", F.lit(1.0).alias("v"))
    d = filtered(field, laplacian, top, coefficients, ["center"])
    pairs = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("scale"), F.col(f"o{j}").alias("v")) for j, s in enumerate(scales)]))
    return d.select("center", "bin_id", pairs.alias("p")).select("center", "p.scale", "bin_id", "p.v")


def heat(field: DataFrame, bins: DataFrame, faces: DataFrame, sigma: float, by: Sequence[str] = (), volume: str = "area", mass: bool = False) -> DataFrame:
    """(by, bin_id, v) after heat has flowed for sigma**2 / 2.

    A field of values keeps constants; with ``mass`` v are amounts, and their sum is kept.
    """
    laplacian = heat_laplacian(bins, faces, volume)
    top = spectral_bound(laplacian)
    by = list(by)
    of = bins.select("bin_id", F.col(volume).alias("_v"))
    start = field.join(of, "bin_id").select(*by, "bin_id", (F.col("v") / F.col("_v")).alias("v")) if mass else field
    d = filtered(start, laplacian, top, [series(lambda x: np.exp(-(sigma**2) / 2 * x), top)], by).withColumnRenamed("o0", "v")
    return d.join(of, "bin_id").select(*by, "bin_id", (F.col("v") * F.col("_v")).alias("v")) if mass else d


def diffused(field: DataFrame, bins: DataFrame, faces: DataFrame, sigma: float, by: Sequence[str] = (), volume: str = "area") -> DataFrame:
    """(by, bin_id, v): ``field`` smoothed by heat where some values are null.

    What flows in from values, by what would flow in from ones in their place.  A bin gets a
    value if its part of the layout holds any; else null.
    """
    by = list(by)
    known = field.where("v is not null")
    both = known.select(*by, F.lit(0).alias("_part"), "bin_id", "v").union(known.select(*by, F.lit(1).alias("_part"), "bin_id", F.lit(1.0).alias("v")))
    spread = heat(both, bins, faces, sigma, [*by, "_part"], volume)
    sums = spread.groupBy(*by, "bin_id").agg(F.sum(F.when(F.col("_part") == 0, F.col("v"))).alias("_a"), F.sum(F.when(F.col("_part") == 1, F.col("v"))).alias("_b"))
    labels = components(bins.select("bin_id"), faces.select("src", "dst")).select("bin_id", "component")
    support = known.join(labels, "bin_id").select(*by, "component").distinct()
    frame = field.select(*by, "bin_id").join(labels, "bin_id")
    d = frame.join(support.withColumn("_held", F.lit(True)), [*by, "component"], "left").join(sums, [*by, "bin_id"], "left")
    v = F.coalesce("_a", F.lit(0.0)) / F.greatest(F.coalesce("_b", F.lit(0.0)), F.lit(LEAST))
    return d.select(*by, "bin_id", F.when(F.col("_held"), v).alias("v"))


def diffusion_transitions(bins: DataFrame, faces: DataFrame, sigma: float, volume: str = "area", least: float = 1e-12) -> DataFrame:
    """(src, dst, p): the chance to be at dst after heat has flowed from src for sigma**2 / 2; rows below ``least`` are left out.

    A row of p sums to 1 whatever the volumes, though on bins of unequal volumes it isn't
    symmetric.  Its size is the square of the bins within reach, as a transition table's is.
    """
    ones = bins.select(F.col("bin_id").alias("dst"), "bin_id", F.lit(1.0).alias("v"))
    d = heat(ones, bins, faces, sigma, ["dst"], volume)
    return d.where(F.col("v") > least).select(F.col("bin_id").alias("src"), "dst", F.col("v").alias("p"))
