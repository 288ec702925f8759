"""Rate maps as penalised Poisson models, the penalty by restricted likelihood.

counts of a unit in a bin ~ Poisson(seconds * exp(basis . coefficients)), with a penalty of
lambda / 2 * sum(d * coefficients**2) over the modes of ``spectral.live_basis``.  Units come
in batches, and every unit is fitted at several penalties at once.  A Newton step is one job:
tasks take their bins' share of gradients and Gram matrices, shares are added up by batch,
and what is solved there comes back as a step for each unit and penalty.  The driver keeps
coefficients, whose number is units x columns x penalties, and decides on step lengths.
Log penalties lie on a grid that closes in on the least restricted likelihood.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Units whose counts share a row.
BATCH = 32
#: Rates are no lower.
RATE_FLOOR = 1e-10
#: Linear predictors are kept within this, so that their exponentials are finite.
LARGEST = 30.0
STEPS = 100
CONVERGED = 1e-10
JITTER = 1e-10
#: Log penalties that are searched, how many at once, and how far apart the last are, between
#: which a parabola tells the least; and how near an end counts as at it.
LOG_PENALTIES = (-8.0, 20.0)
AT_ONCE = 9
CLOSE = 0.06
AT_END = 5e-3

_FITS = "unit {unit}, n long, log_penalty double, objective double, at_bound boolean, converged boolean, deviance double"


class _Batch:
    """The state of a batch's units at some penalties: arrays (penalties, units, columns)."""

    def __init__(self, start: np.ndarray, n_penalties: int):
        self.now = np.repeat(start[None], n_penalties, 0)
        self.step = np.zeros_like(self.now)
        self.size = np.ones(self.now.shape[:2])
        self.value = np.full(self.now.shape[:2], np.inf)
        self.kept = self.now.copy()
        self.done = np.zeros(self.now.shape[:2], dtype=bool)
        self.failed = np.zeros(self.now.shape[:2], dtype=bool)
        self.log_det = np.zeros(self.now.shape[:2])
        self.log_lik = np.zeros(self.now.shape[:2])

    def take(self, value: np.ndarray, step: np.ndarray, log_det: np.ndarray, log_lik: np.ndarray) -> None:
        """Go on where the objective fell, else come back half the way."""
        better = np.isfinite(value) & (value <= self.value + 1e-9 * (1 + np.abs(value)))
        settled = better & np.isfinite(self.value) & (self.value - value <= CONVERGED * (1 + np.abs(value)))
        move, back = better & ~self.done, ~better & ~self.done
        self.log_det[move], self.log_lik[move] = log_det[move], log_lik[move]
        self.value[move], self.kept[move], self.step[move], self.size[move] = value[move], self.now[move], step[move], 1.0
        self.size[back] /= 2
        self.failed |= back & (self.size < 2.0**-30)
        self.done |= settled | self.failed
        self.now = self.kept + self.size[..., None] * np.where(self.done[..., None], 0.0, self.step)


def _shares(states: dict[int, np.ndarray], penalties: dict[int, np.ndarray]):
    """Each task's sums of likelihood, gradient and Gram matrix by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = batch.column(0).to_numpy()
            for b in np.unique(which).tolist():
                at = pa.array(which == b)
                seconds = batch.column(1).filter(at).to_numpy()
                basis, n = (np.array(batch.column(c).filter(at).to_pylist(), dtype=float) for c in (2, 3))
                beta = states[b]
                n_penalties, n_units, r = beta.shape
                eta = np.clip(basis @ beta.reshape(-1, r).T, -LARGEST, LARGEST).reshape(-1, n_penalties, n_units)
                mu = seconds[:, None, None] * np.exp(eta)
                y = n[:, None, :]
                on = (seconds > 0)[:, None, None]
                log_lik = np.where(on, y * (eta + np.log(np.where(seconds > 0, seconds, 1.0))[:, None, None]) - mu, 0.0).sum(0)
                gradient = np.einsum("blu,br->lur", np.where(on, y - mu, 0.0), basis)
                pairs = (basis[:, :, None] * basis[:, None, :]).reshape(len(basis), -1)
                gram = (mu.reshape(len(basis), -1).T @ pairs).reshape(n_penalties, n_units, r, r)
                whole = np.concatenate([x.ravel() for x in (log_lik, gradient, gram)])
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([whole.tobytes()], pa.binary())], names=["batch", "m"])

    def solve(group: pa.Table) -> pa.Table:
        b = group.column("batch")[0].as_py()
        total = sum(np.frombuffer(x) for x in group.column("m").to_pylist())
        beta, lam, d = states[b], np.exp(penalties[b]), penalties[-1]
        n_penalties, n_units, r = beta.shape
        k = n_penalties * n_units
        log_lik, gradient, gram = total[:k].reshape(n_penalties, n_units), total[k : k + k * r].reshape(beta.shape), total[k + k * r :].reshape(n_penalties, n_units, r, r)
        weight = lam[..., None] * d
        value = -log_lik + 0.5 * (weight * beta * beta).sum(-1)
        hessian = gram + (weight + JITTER)[..., None] * np.eye(r)
        step = np.linalg.solve(hessian, (gradient - weight * beta)[..., None])[..., 0]
        sign, log_det = np.linalg.slogdet(hessian)
        out = np.concatenate([x.ravel() for x in (value, np.where(sign > 0, log_det, np.inf), log_lik, step)])
        return pa.table({"batch": pa.array([b], pa.int32()), "m": pa.array([out.tobytes()], pa.binary())})

    return run, solve


def _fit(rows: DataFrame, states: dict[int, _Batch], log_penalties: dict[int, np.ndarray], d: np.ndarray) -> None:
    """Newton steps until every unit at every penalty has settled."""
    for _ in range(STEPS):
        active = {b: s for b, s in states.items() if not s.done.all()}
        if not active:
            return
        run, solve = _shares({b: s.now for b, s in states.items()}, {**log_penalties, -1: d})
        schema = "batch int, m binary"
        parts = rows.where(F.col("batch").isin(list(active))).mapInArrow(run, schema)
        for r in parts.groupBy("batch").applyInArrow(solve, schema).collect():
            s, m = states[r.batch], np.frombuffer(r.m)
            k = s.value.size
            value, log_det, log_lik = (m[i * k : (i + 1) * k].reshape(s.value.shape) for i in range(3))
            s.take(value, m[3 * k :].reshape(s.now.shape), log_det, log_lik)
    for s in states.values():
        s.failed |= ~s.done


def fit_rate_maps(
    counts: DataFrame, occupancy: DataFrame, basis: DataFrame, d: Sequence[float], n_constants: int, penalty: float | None = None, pooled: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Maps (unit, bin_id, rate) over the basis's bins, and fits (unit, n, log_penalty, objective, at_bound, converged, deviance).

    counts (unit, bin_id, n) needs no rows for zeros, but a row for each unit; occupancy
    (bin_id, seconds); basis (bin_id, basis) with penalties ``d``, of which the first
    ``n_constants`` belong to the constants of the basis.  ``penalty`` fixes lambda; without it
    one is chosen for all units together (``pooled``), or for each unit.  A unit without
    counts has the rate ``RATE_FLOOR`` everywhere and the penalty of all others together.
    ``at_bound`` tells that the penalty lies at an end of what is searched, as it does for a
    unit that the data tell nothing of but its mean.  Counts in bins outside the basis or
    without time are left out.
    """
    spark = counts.sparkSession
    scratch = Scratch(spark, "gam")
    d = np.array(d, dtype=float)
    n_free = int((d[n_constants:] >= 0).sum())
    kind = counts.schema["unit"].dataType.simpleString()
    time = occupancy.select("bin_id", F.coalesce("seconds", F.lit(0.0)).alias("seconds"))
    design = basis.join(time, "bin_id", "left").select("bin_id", "basis", F.coalesce("seconds", F.lit(0.0)).alias("seconds"))
    heard = counts.select("unit", "bin_id", "n").join(design.where("seconds > 0").select("bin_id"), "bin_id", "left_semi")
    # One row for each unit.
    totals = counts.select("unit").distinct().join(heard.groupBy("unit").agg(F.sum("n").alias("n")), "unit", "left").orderBy("unit").collect()
    live_units = [r.unit for r in totals if r.n]
    places = [(u, k // BATCH, k % BATCH) for k, u in enumerate(live_units)]
    n_batches = -(-len(live_units) // BATCH)
    width = {b: min(BATCH, len(live_units) - b * BATCH) for b in range(n_batches)}
    fits: dict = {}
    maps: list[tuple] = []
    if live_units and len(d):
        placed = heard.join(spark.createDataFrame(places, f"unit {kind}, batch int, k int"), "unit")
        filled = placed.groupBy("bin_id", "batch").agg(F.map_from_entries(F.collect_list(F.struct("k", F.col("n").cast("double")))).alias("m"))
        frame = design.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1))))
        wide = F.array(*[F.lit(width[b]) for b in range(n_batches)])
        n = F.transform(F.sequence(F.lit(0), F.element_at(wide, F.col("batch") + 1) - 1), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
        rows = frame.join(filled, ["bin_id", "batch"], "left").select("batch", "seconds", "basis", n.alias("n"))
        rows = scratch.keep("rows", rows)
        constants = [F.max(F.abs(F.col("basis")[k])).alias(f"c{k}") for k in range(n_constants)]
        found = design.agg(F.sum("seconds").alias("seconds"), *constants).first()
        start = {}
        for b in range(n_batches):
            rate = np.array([r.n for r in totals if r.n][b * BATCH : b * BATCH + width[b]]) / found.seconds
            start[b] = np.zeros((width[b], len(d)))
            start[b][:, :n_constants] = np.log(rate)[:, None] / np.array([found[f"c{k}"] for k in range(n_constants)])
        chosen, states = _choose(rows, start, d, n_free, penalty, pooled)
        for b, s in states.items():
            for k in range(width[b]):
                u = live_units[b * BATCH + k]
                maps.append((u, s.kept[0, k].tolist()))
                log_penalty, objective, at_bound = chosen[b][k]
                fits[u] = (log_penalty, objective, at_bound, bool(~s.failed[0, k]))
    silent = math.log(RATE_FLOOR)
    shared = [f[0] for f in fits.values() if f[0] is not None]
    common = float(np.mean(shared)) if shared else (math.log(penalty) if penalty else None)
    fitted = spark.createDataFrame(maps, f"unit {kind}, beta array<double>")
    eta = F.aggregate(F.zip_with("basis", "beta", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    drawn = design.crossJoin(fitted).select("unit", "bin_id", "seconds", F.greatest(F.lit(RATE_FLOOR), F.exp(F.least(F.lit(LARGEST), F.greatest(F.lit(-LARGEST), eta)))).alias("rate"))
    quiet = spark.createDataFrame([(r.unit,) for r in totals if not r.n], f"unit {kind}")
    drawn = drawn.union(design.crossJoin(quiet).select("unit", "bin_id", "seconds", F.lit(RATE_FLOOR)))
    drawn = Scratch(spark, "rate-maps").keep("maps", drawn)
    scratch.drop("")
    seen = drawn.join(heard, ["unit", "bin_id"], "left")
    y, mu = F.coalesce("n", F.lit(0)), F.col("rate") * F.col("seconds")
    part = F.when(F.col("seconds") > 0, 2 * (F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - (y - mu)))
    deviance = seen.groupBy("unit").agg(F.sum(part).alias("deviance"))
    told = [(r.unit, int(r.n or 0), *(fits.get(r.unit) or (common, None, None, True))) for r in totals]
    table = spark.createDataFrame(told, _FITS.format(unit=kind).replace(", deviance double", ""))
    return drawn.select("unit", "bin_id", "rate"), table.join(deviance, "unit", "left")


def _choose(rows: DataFrame, start: dict[int, np.ndarray], d: np.ndarray, n_free: int, penalty: float | None, pooled: bool) -> tuple[dict, dict[int, _Batch]]:
    """What each unit's penalty is, with the objective and whether it is at a bound, and the fits there."""
    if penalty is not None or not n_free:
        at = math.log(penalty) if penalty else 0.0
        states, value = _at(rows, start, d, n_free, {b: np.full((1, len(s)), at) for b, s in start.items()})
        told = math.log(penalty) if penalty else None
        return {b: [(told, float(v) if n_free else None, None) for v in value[b][0]] for b in start}, states
    centre = {b: np.full(len(s), sum(LOG_PENALTIES) / 2) for b, s in start.items()}
    reach, warm = (LOG_PENALTIES[1] - LOG_PENALTIES[0]) / 2, start
    while True:
        offsets = np.linspace(-reach, reach, AT_ONCE)[:, None]
        grid = {b: np.clip(c[None] + offsets, *LOG_PENALTIES) for b, c in centre.items()}
        states, value = _at(rows, warm, d, n_free, grid)
        if pooled:
            total = sum(v.sum(1) for v in value.values())
            best = {b: np.full(len(s), int(np.argmin(total))) for b, s in start.items()}
        else:
            best = {b: np.argmin(v, 0) for b, v in value.items()}
        centre = {b: np.take_along_axis(grid[b], i[None], 0)[0] for b, i in best.items()}
        spacing = 2 * reach / (AT_ONCE - 1)
        if spacing <= CLOSE:
            for b, i in best.items():
                of = np.broadcast_to(total[:, None], value[b].shape) if pooled else value[b]
                centre[b] = centre[b] + spacing * np.array([_dip(of[:, k], j) for k, j in enumerate(i)])
                centre[b] = np.clip(centre[b], *LOG_PENALTIES)
        warm = {b: np.stack([states[b].kept[i, k] for k, i in enumerate(best[b])]) for b in start}
        if spacing <= CLOSE:
            break
        reach = spacing
    states, value = _at(rows, warm, d, n_free, {b: c[None] for b, c in centre.items()})
    shared = float(sum(v.sum() for v in value.values()))
    ends = lambda x: bool(min(x - LOG_PENALTIES[0], LOG_PENALTIES[1] - x) <= AT_END)
    return {b: [(float(x), shared if pooled else float(v), ends(x)) for x, v in zip(centre[b], value[b][0])] for b in start}, states


def _at(rows: DataFrame, start: dict[int, np.ndarray], d: np.ndarray, n_free: int, log_penalties: dict[int, np.ndarray]) -> tuple[dict[int, _Batch], dict[int, np.ndarray]]:
    """Fits at the given log penalties (penalties, units), and their restricted likelihoods, negative."""
    states = {b: _Batch(s, len(log_penalties[b])) for b, s in start.items()}
    _fit(rows, states, log_penalties, d)
    value = {}
    for b, s in states.items():
        value[b] = np.where(s.failed, np.inf, s.value - 0.5 * n_free * log_penalties[b] + 0.5 * s.log_det)
    return states, value


def _dip(values: np.ndarray, at: int) -> float:
    """Where, in steps from ``at``, the parabola through the least value and its neighbours is least."""
    if not 0 < at < len(values) - 1 or not np.isfinite(values[at - 1 : at + 2]).all():
        return 0.0
    low, mid, high = values[at - 1 : at + 2]
    bend = low - 2 * mid + high
    return float(0.5 * (low - high) / bend) if bend > 0 else 0.0
