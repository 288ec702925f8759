"""Earth mover's distance between maps, in the plane and along links.

What has to move is the difference of two maps, so it is reckoned once for each pair in a
join, and each pair's flow is a problem of its own: pairs are spread over tasks, and a task
holds the bins of one arena.  Along links the flow runs on the sparse link table, without
distances between all bins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of the largest arena that is taken: in the plane a task weighs all pairs of the
#: bins that gain with those that lose.
MAX_BINS = 20_000
#: Shares of the mass below this are what sums leave in another order.
DUST = 1e-12


def minimal_cost(excess: np.ndarray, src: np.ndarray, dst: np.ndarray, cost: np.ndarray) -> float:
    """The least cost of moving ``excess`` (sum 0) along links without bounds; NaN where none reach.

    Network simplex: a spanning tree whose links carry the flow, improved by the link of the
    most negative reduced cost until there is none.  Links of the tree without flow point to
    its root (strongly feasible trees), and the last link that blocks leaves, so it ends.
    """
    n = len(excess)
    if n == 0 or not np.abs(excess).max() > 0:
        return 0.0
    far = (n + 1) * (float(cost.max()) if len(cost) else 0.0) + 1.0
    parent, depth = [n] * n + [-1], [1] * n + [0]
    upward, flow, price = [bool(e >= 0) for e in excess] + [True], [abs(float(e)) for e in excess] + [0.0], [far] * n + [0.0]
    children = [set() for _ in range(n)] + [set(range(n))]
    # A node's level is what a unit costs from the root to it, along the tree.
    level = np.array([-far if u else far for u in upward[:n]] + [0.0])
    least = -1e-10 * far / (n + 1)
    while len(cost):
        reduced = cost + level[src] - level[dst]
        best = int(reduced.argmin())
        if reduced[best] >= least:
            break
        k, l = int(src[best]), int(dst[best])
        down, up, a, b = [], [], k, l
        while a != b:
            if depth[a] >= depth[b]:
                down.append(a)
                a = parent[a]
            else:
                up.append(b)
                b = parent[b]
        # The cycle runs from the apex down to k, over the new link, and from l up.
        blocking = [(flow[v], v) for v in reversed(down) if upward[v]] + [(flow[v], v) for v in up if not upward[v]]
        theta = min(f for f, _ in blocking)
        leaving = [v for f, v in blocking if f <= theta][-1]
        for v in down:
            flow[v] += -theta if upward[v] else theta
        for v in up:
            flow[v] += theta if upward[v] else -theta
        # The part that the leaving link cuts off hangs on the new link from now on.
        inner, outer, rises = (k, l, True) if leaving in down else (l, k, False)
        children[parent[leaving]].discard(leaving)
        node, above, link = inner, outer, (rises, theta, float(cost[best]))
        while True:
            old, carried = parent[node], (not upward[node], flow[node], price[node])
            parent[node], (upward[node], flow[node], price[node]) = above, link
            if node != leaving:
                children[old].discard(node)
            children[above].add(node)
            if node == leaving:
                break
            node, above, link = old, node, carried
        shift = level[outer] + (-price[inner] if upward[inner] else price[inner]) - level[inner]
        moved = [inner]
        for v in moved:
            depth[v] = depth[parent[v]] + 1
            moved.extend(children[v])
        level[moved] += shift
    if any(parent[v] == n and flow[v] > 1e-9 and price[v] == far for v in range(n)):
        return float("nan")
    return float(sum(f * p for f, p, v in zip(flow, price, parent) if v != n and v >= 0))


def earth_movers_distance(a: DataFrame, b: DataFrame, bins: DataFrame, edges: DataFrame | None = None, by: tuple[str, ...] = ("unit",)) -> DataFrame:
    """(*by, cost): what it costs to turn one map into the other, each scaled to sum 1.

    ``a`` and ``b``: (*by, bin_id, rate), matched on ``by``; null, NaN and infinite rates
    count as 0, negative ones too.  Without ``edges`` a unit of mass costs the straight
    distance between centers (bins: bin_id, x, y), with ``edges`` (src, dst, distance) the
    way along links.  The cost is null where a map has no mass, and where mass would have to
    cross to bins that no link reaches.  A ``by`` that only one side has gives no row.  The
    number of bins is checked against ``MAX_BINS``.
    """
    n_bins = bins.count()
    if n_bins > MAX_BINS:
        raise ValueError(f"{n_bins} bins, more than {MAX_BINS}")
    place = {r["bin_id"]: (i, r["x"], r["y"]) for i, r in enumerate(bins.select("bin_id", "x", "y").orderBy("bin_id").collect())}
    xy = np.array([(x, y) for _, x, y in place.values()], dtype=float).reshape(-1, 2)
    index = {k: v[0] for k, v in place.items()}
    if edges is not None:
        # As many as the arena has links: a few for each bin.
        links = edges.select("src", "dst", "distance").toPandas()
        src, dst, length = links["src"].map(index).to_numpy(), links["dst"].map(index).to_numpy(), links["distance"].to_numpy(dtype=float)

    along, keys = edges is not None, list(by)
    taken = F.when((F.col("rate") > 0) & (F.col("rate") < float("inf")), F.col("rate")).otherwise(0.0)

    def mass(d: DataFrame, sign: int, side: str) -> DataFrame:
        d = d.select(*keys, "bin_id", taken.alias("v"))
        total = d.groupBy(*keys).agg(F.sum("v").alias("total"))
        return d.join(total, keys).select(*keys, "bin_id", (sign * F.try_divide("v", "total")).alias("v"), F.lit(side).alias("side"))

    both = mass(a, 1, "a").unionByName(mass(b, -1, "b")).groupBy(*keys, "bin_id").agg(F.sum("v").alias("v"), F.count_if(F.col("v").isNull()).alias("lost"), F.collect_set("side").alias("sides"))
    # A bin that one map lacks is a 0 there; a map without mass has shares of null.
    kinds = both.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_set("sides"))).alias("all_sides"), F.sum("lost").alias("lost"),
                                    F.collect_list(F.when(F.abs("v") > DUST, F.struct("bin_id", "v"))).alias("moves"))
    pairs = kinds.where(F.size("all_sides") == 2).select(*keys, (F.col("lost") == 0).alias("whole"), F.col("moves.bin_id").alias("bin_ids"), F.col("moves.v").alias("excess"))
    names = [f"_k{i}" for i in range(len(keys))]
    types = ", ".join(f"{n} {both.schema[k].dataType.simpleString()}" for n, k in zip(names, keys))

    def solve(batches):
        for batch in batches:
            costs = []
            for whole, at, v in zip(batch["whole"], batch["bin_ids"], batch["excess"]):
                at, v = np.array([index[i] for i in at], dtype=int), np.array(v, dtype=float)
                if not whole:
                    costs.append(None)
                    continue
                if not along:
                    gains, losses = np.flatnonzero(v < 0), np.flatnonzero(v > 0)
                    i, j = np.repeat(losses, len(gains)), np.tile(gains, len(losses))
                    found = minimal_cost(v, i, j, np.hypot(*(xy[at[i]] - xy[at[j]]).T)) if len(v) else 0.0
                else:
                    full = np.zeros(len(index))
                    full[at] = v
                    found = minimal_cost(full, src, dst, length)
                costs.append(None if np.isnan(found) else found)
            yield pd.DataFrame({**{n: batch[n] for n in names}, "cost": pd.Series(costs, dtype="float64")})

    spread = pairs.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "whole", "bin_ids", "excess").repartition(*names)
    out = spread.mapInPandas(solve, f"{types}, cost double")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.nanvl("cost", F.lit(None).cast("double")).alias("cost"))
