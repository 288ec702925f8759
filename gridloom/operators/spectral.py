"""Low modes of heat flow over any layout, by block Lanczos on the sparse link table.

The operator of ``diffusion`` made symmetric by the roots of the volumes falls apart into
the connected components of the layout, and each has its own modes.  All components go
through one iteration together, and what is summed is summed for each of them.  Blocks of
vectors are rows (bin, column); a step applies heat flow, as a Chebyshev series, which makes
the slow modes the large ones, and orthogonalises against all blocks before by two passes of
inner products that tasks add up.  Rayleigh's quotients of the operator itself then give
eigenvalues and modes.  A component of few bins is one small dense matrix instead.  What the driver sees are small matrices, whose sizes are those of
the blocks, one for each component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .diffusion import filtered, series, spectral_bound
from .fields import components

#: Columns of a block beyond the modes that are asked for.
SPARE = 6
#: Heat flows so long in a step that the fastest mode is damped by the exponential of this.
DAMPING = 20.0
#: Blocks at most, and the residual of a mode, by the largest eigenvalue, at which it is found.
BLOCKS = 8
RESIDUAL = 1e-9
#: Bins up to which a component is one dense matrix in one task; larger ones are iterated on.
DENSE_BINS = 400
#: Directions below this share of the largest are none.
DEPENDENT = 1e-9


def symmetric_operator(bins: DataFrame, faces: DataFrame, volume: str = "area") -> DataFrame:
    """Rows (src, dst, w) of M^-1/2 (D - W) M^-1/2, where W has face / distance and M the volumes."""
    of = lambda k: bins.select(F.col("bin_id").alias(k), F.sqrt(volume).alias(f"{k}_m"))
    flow = faces.select("src", "dst", (F.col("face") / F.col("distance")).alias("f")).join(of("src"), "src").join(of("dst"), "dst")
    off = flow.select("src", "dst", (-F.col("f") / (F.col("src_m") * F.col("dst_m"))).alias("w"))
    out = flow.groupBy("src").agg((F.sum(F.col("f")) / F.first("src_m") / F.first("src_m")).alias("w"))
    whole = bins.select(F.col("bin_id").alias("src")).join(out, "src", "left")
    return off.union(whole.select("src", F.col("src").alias("dst"), F.coalesce("w", F.lit(0.0))))


def _inner(table: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By component: basis^T block and block^T block of rows (component, basis, block), summed over tasks."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            which = batch.column(0).to_numpy()
            q, w = (np.array(c.to_pylist(), dtype=float).reshape(batch.num_rows, -1) for c in (batch.column(1), batch.column(2)))
            both = np.hstack((q, w))
            for c in np.unique(which).tolist():
                at = which == c
                sums[c] = sums.get(c, 0.0) + both[at].T @ w[at]
        for c, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["component", "width", "m"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in group.column("m").to_pylist())
        return pa.table({"component": group.column("component")[:1], "width": group.column("width")[:1], "m": pa.array([total.tobytes()], pa.binary())})

    schema = "component long, width int, m binary"
    parts = table.select("component", "basis", "block").mapInArrow(part, schema)
    out = {}
    for r in parts.groupBy("component").applyInArrow(add, schema).collect():
        m = np.frombuffer(r.m).reshape(-1, r.width)
        out[r.component] = m[: -r.width], m[-r.width :]
    return out


def _mapped(table: DataFrame, by_component: dict[int, list[np.ndarray]], change, names: str) -> DataFrame:
    """``table`` (component, bin_id, basis, block) with arrays ``names`` that ``change`` makes of basis, block and the component's matrices."""
    columns = names.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = batch.column(0).to_numpy()
            q, w = (np.array(c.to_pylist(), dtype=float).reshape(batch.num_rows, -1) for c in (batch.column(2), batch.column(3)))
            for c in np.unique(which).tolist():
                at = which == c
                arrays = change(q[at], w[at], *by_component[c])
                lists = [pa.array(list(a), pa.list_(pa.float64())) for a in arrays]
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(at)), batch.column(1).filter(pa.array(at)), *lists], names=["component", "bin_id", *columns])

    schema = "component long, bin_id long, " + ", ".join(f"{c} array<double>" for c in columns)
    return table.select("component", "bin_id", "basis", "block").mapInArrow(run, schema)


def _factor(gram: np.ndarray, scale: float) -> np.ndarray:
    """Columns that turn a block into orthonormal directions; 0 where it has fewer than columns."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    good = values > DEPENDENT * max(scale, values[-1], 0.0)
    return vectors * np.where(good, 1 / np.sqrt(np.where(good, values, 1.0)), 0.0)


def _rows(table: DataFrame, column: str) -> DataFrame:
    """(column, bin_id, v) of an array column, without zeros."""
    d = table.select("bin_id", F.posexplode(column).alias("column", "v"))
    return d.where("v <> 0")


def _arrays(rows: DataFrame, column: str, width: int, out: str) -> DataFrame:
    """(bin_id, out): the values of each bin by their columns; 0 where there is none."""
    m = rows.groupBy("bin_id").agg(F.map_from_entries(F.collect_list(F.struct("column", column))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0)))
    return m.select("bin_id", filled.alias(out))


def _dense(operator: DataFrame, labels: DataFrame, rank: int) -> DataFrame:
    """(component, mode, eigenvalue, residual, bin_id, v) of components of at most ``DENSE_BINS`` bins."""

    def solve(group: pa.Table) -> pa.Table:
        src, dst = (group.column(c).to_numpy() for c in ("src", "dst"))
        ids, at = np.unique(src, return_inverse=True)
        m = np.zeros((len(ids), len(ids)))
        np.add.at(m, (at, np.searchsorted(ids, dst)), group.column("w").to_numpy())
        values, vectors = np.linalg.eigh((m + m.T) / 2)
        n = min(rank, len(ids))
        k = np.repeat(np.arange(n, dtype=np.int32), len(ids))
        residual = np.abs(m @ vectors[:, :n] - vectors[:, :n] * values[:n]).max(0)
        columns = [np.full(len(k), group.column("component")[0].as_py()), k, np.maximum(values[:n], 0.0)[k], residual[k], np.tile(ids, n), vectors[:, :n].T.ravel()]
        return pa.table([pa.array(c) for c in columns], names=["component", "mode", "eigenvalue", "residual", "bin_id", "v"])

    rows = operator.join(labels.withColumnRenamed("bin_id", "src"), "src").select("component", "src", "dst", "w")
    return rows.groupBy("component").applyInArrow(solve, "component long, mode int, eigenvalue double, residual double, bin_id long, v double")


def eigenbasis(bins: DataFrame, faces: DataFrame, rank: int, volume: str = "area") -> tuple[DataFrame, DataFrame]:
    """The slowest modes of each component: (component, mode, eigenvalue, residual) and (component, mode, bin_id, v).

    ``rank`` modes of a component, or as many as it has bins, modes counted from 0 in order of
    their eigenvalues; v is of length 1 over the component's bins, and the first mode of a
    component has the eigenvalue 0.  Equal eigenvalues have modes that are orthogonal, but
    which ones is open.  Blocks are added until all residuals are small, ``BLOCKS`` at most;
    what is left is told.  Scratch tables go once the modes are written.
    """
    spark = bins.sparkSession
    work = Scratch(spark, "modes")
    labels = work.keep("labels", components(bins.select("bin_id"), faces.select("src", "dst")).select("bin_id", F.col("component").cast("long")))
    operator = work.keep("operator", symmetric_operator(bins, faces, volume))
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    of_size = lambda large: labels.join(sizes.where(F.col("n") > DENSE_BINS if large else F.col("n") <= DENSE_BINS), "component").select("bin_id", "component")
    told, rows = spark.createDataFrame([], "component long, mode int, eigenvalue double, residual double"), spark.createDataFrame([], "component long, mode int, bin_id long, v double")
    results = Scratch(spark, "eigenbasis")
    if not sizes.where(F.col("n") <= DENSE_BINS).isEmpty():
        small = results.keep("dense", _dense(operator, of_size(False), rank))
        told = told.union(small.select("component", "mode", "eigenvalue", "residual").distinct())
        rows = rows.union(small.select("component", "mode", "bin_id", "v"))
    if not sizes.where(F.col("n") > DENSE_BINS).isEmpty():
        large = of_size(True)
        found, modes = _iterated(operator.join(large.select(F.col("bin_id").alias("src")), "src", "left_semi"), large, rank)
        told, rows = told.union(found), rows.union(results.keep("modes", modes))
    work.drop("")
    return told, rows


def _iterated(operator: DataFrame, labels: DataFrame, rank: int) -> tuple[DataFrame, DataFrame]:
    """Block Lanczos over all components of ``labels`` (bin_id, component) at once."""
    spark = operator.sparkSession
    scratch = Scratch(spark, "lanczos")
    labels, operator = scratch.keep("labels", labels), scratch.keep("operator", operator)
    top = spectral_bound(operator)
    width = rank + SPARE
    flow = [series(lambda x: np.exp(-DAMPING * x / top), top, 1e-6)] if top else [[1.0]]
    # Draws by bin and column, so that a task that runs again draws the same.
    uniform = lambda k: (F.pmod(F.xxhash64("bin_id", F.lit(k)), F.lit(1 << 30)) + 0.5) / (1 << 30) - 0.5
    start = labels.select("component", "bin_id", F.array().cast("array<double>").alias("basis"), F.array(*[uniform(k) for k in range(width)]).alias("block"))

    live: dict[int, np.ndarray] = {}

    def orthogonal(table: DataFrame, name: str) -> DataFrame:
        """The block without what the basis has, of length 1, beside the basis."""
        for k in (1, 2):
            by = {}
            for c, (inside, gram) in _inner(table).items():
                left = gram - inside.T @ inside
                by[c] = [inside, _factor(left, np.trace(gram) / len(gram))]
            table = scratch.keep(f"{name}-{k}", _mapped(table, by, lambda q, w, inside, r: (q, (w - q @ inside) @ r), "basis block"))
        for c, (_, r) in by.items():
            live[c] = np.append(live.get(c, np.zeros(0, dtype=bool)), (r != 0).any(0))
        return table

    sizes = {r.component: r.n for r in labels.groupBy("component").agg(F.count("*").alias("n")).collect()}
    table = orthogonal(start, "start")
    for step in range(1, BLOCKS + 1):
        joined = table.select("component", "bin_id", F.concat("basis", "block").alias("basis"), "block")
        n_columns = width * step
        # The operator on all blocks so far: its Chebyshev series is top / 2 times (1 + the scaled operator).
        product = filtered(_rows(joined, "basis"), operator, top, [[top / 2, top / 2]], ["column"])
        zeros = F.array_repeat(F.lit(0.0), n_columns)
        applied = joined.drop("block").join(_arrays(product, "o0", n_columns, "block"), "bin_id", "left")
        applied = scratch.keep(f"applied-{step}", applied.select("component", "bin_id", "basis", F.coalesce("block", zeros).alias("block")))
        modes = {c: _ritz(inside, gram, live[c], min(rank, sizes[c])) for c, (inside, gram) in _inner(applied).items()}
        found = all(len(values) == min(rank, sizes[c]) and (residual <= RESIDUAL * max(top, 1e-300)).all() for c, (values, _, residual) in modes.items())
        if found or step == BLOCKS or not any(x[-width:].any() for x in live.values()):
            break
        moved = filtered(_rows(joined, "block"), operator, top, flow, ["column"])
        nxt = joined.drop("block").join(_arrays(moved, "o0", width, "block"), "bin_id", "left")
        nxt = nxt.select("component", "bin_id", "basis", F.coalesce("block", F.array_repeat(F.lit(0.0), width)).alias("block"))
        table = orthogonal(scratch.keep(f"moved-{step}", nxt), f"block-{step}")
    told = [(c, k, float(max(0.0, v)), float(r)) for c, (values, _, residual) in modes.items() for k, (v, r) in enumerate(zip(values, residual))]
    drawn = _mapped(applied, {c: [vectors] for c, (_, vectors, _) in modes.items()}, lambda q, w, vectors: (q @ vectors,), "modes")
    rows = drawn.select("component", F.posexplode("modes").alias("mode", "v"), "bin_id").select("component", "mode", "bin_id", "v")
    return spark.createDataFrame(told, "component long, mode int, eigenvalue double, residual double"), rows


def _ritz(inside: np.ndarray, gram: np.ndarray, live: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``rank`` lowest eigenvalues, their coefficients over all columns, and residuals."""
    small = inside[np.ix_(live, live)]
    values, some = np.linalg.eigh((small + small.T) / 2)
    values, some = values[:rank], some[:, :rank]
    vectors = np.zeros((len(live), len(values)))
    vectors[live] = some
    left = np.einsum("ik,ij,jk->k", vectors, gram, vectors) - values**2
    # A square below rounding tells nothing of its root.
    return values, vectors, np.sqrt(np.where(left > 1e-13 * np.abs(np.diag(gram)).max(initial=1e-300), left, 0.0))


def heat_rank(modes: DataFrame, sigma: float, tolerance: float) -> DataFrame:
    """(component, rank): modes that heat flow for sigma**2 / 2 leaves at ``tolerance`` or more; 1 at least."""
    kept = F.count_if(F.exp(F.col("eigenvalue") * (-sigma * sigma / 2)) >= tolerance)
    return modes.groupBy("component").agg(F.greatest(F.lit(1), kept).alias("rank"))


def live_basis(bins: DataFrame, values: DataFrame, modes: DataFrame, occupancy: DataFrame, rank: int, volume: str = "area") -> tuple[DataFrame, list[float], int]:
    """A basis of the bins where time was spent: (bin_id, basis array<double>), penalties, and how many of them are constants.

    ``values`` and ``modes`` are what ``eigenbasis`` gives.  Components with a positive sum of
    ``occupancy`` (bin_id, seconds) are live.  Columns are a constant for each of them, 1 over
    the root of its volume, with penalty 0, and then modes by their eigenvalues, those of
    eigenvalue 0 left out, as many as make ``rank`` columns.
    """
    spark = bins.sparkSession
    of_bin = modes.where("mode = 0").select("component", "bin_id").join(bins.select("bin_id", F.col(volume).alias("volume")), "bin_id")
    spent = of_bin.join(occupancy.select("bin_id", "seconds"), "bin_id").groupBy("component").agg(F.sum("seconds").alias("seconds")).where("seconds > 0")
    whole = of_bin.join(spent, "component").groupBy("component").agg(F.sum("volume").alias("total"), F.count("*").alias("n")).orderBy("component").collect()
    # A row for each component and mode: their number is the basis's, not the samples'.
    live = [r.component for r in whole]
    fills = sorted((r.eigenvalue, r.component, r["mode"]) for r in values.where(F.col("mode") > 0).collect() if r.component in live)
    n = max(len(live), min(sum(r.n for r in whole), rank))
    fills = fills[: n - len(live)]
    columns = [(c, 0, k) for k, c in enumerate(live)] + [(c, m, len(live) + k) for k, (_, c, m) in enumerate(fills)]
    if not columns:
        return spark.createDataFrame([], "bin_id long, basis array<double>"), [], 0
    names = spark.createDataFrame(columns, "component long, mode int, column int")
    roots = spark.createDataFrame([(r.component, 1 / float(r.total) ** 0.5) for r in whole], "component long, constant double")
    d = modes.join(names, ["component", "mode"]).join(bins.select("bin_id", F.col(volume).alias("volume")), "bin_id").join(roots, "component")
    d = d.select("bin_id", "column", F.when(F.col("mode") == 0, F.col("constant")).otherwise(F.col("v") / F.sqrt("volume")).alias("o0"))
    return _arrays(d, "o0", len(columns), "basis"), [0.0] * len(live) + [v for v, _, _ in fills], len(live)
