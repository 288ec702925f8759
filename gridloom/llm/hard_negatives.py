"""Hard negatives by bit-sliced integer products.

A row's score is the inner product of its whole-number components with an anchor's.  The
components of a block of rows are taken as bit-planes, the most significant first: after
each plane the score is known to lie in an interval, since the planes that are left can add
no more than all ones where the anchor is positive, and take no more than all ones where it
is negative.  A candidate whose interval cannot meet what still qualifies is dropped, and
the rest go to the next plane; after the last plane scores are exact.

Rows and anchors are packed into blocks.  Anchors' blocks are sent to shards of the rows,
bounded in rows, and a task streams the shard's blocks past one block of anchors, keeping
each anchor's best so far.  Positives come first, from rows of like labels alone; their
scores give the windows in which negatives are searched, over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..session import Scratch

#: Rows of a block at most, and anchors of one, about.
BLOCK_ROWS = 4_096
BLOCK_ANCHORS = 2_048
#: Rows that one task scores against one block of anchors, about.
SHARD_ROWS = 262_144
#: Buckets that labels are hashed to.
LABEL_BUCKETS = 64
#: Pairs scored together; bounds a task's memory.
PAIRS_AT_ONCE = 1_000_000
#: Of the pairs of a tile, the share from which they go on as a list of pairs.
SPARSE = 1 / 16

_LEAST, _MOST = np.iinfo(np.int64).min // 2, np.iinfo(np.int64).max // 2
_BLOCK = "a_block int, shard int, tag int, block long, dims int, width int, ids array<long>, labels array<long>, comps binary, n_windows array<int>, window_ids array<long>, window_scores array<long>"


def sliced_scores(rows: np.ndarray, anchors: np.ndarray, may: np.ndarray, low: np.ndarray, high: np.ndarray, best: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of the pairs in ``may`` whose score lies in a window of its anchor.

    ``low`` and ``high`` have a row for each window and a column for each anchor.  With
    ``best``, pairs that ``best`` others of the anchor are certain to beat are left out.
    """
    peak = int(max(np.abs(rows).max(initial=0), 1)) * int(max(np.abs(anchors).max(initial=0), 1)) * max(1, rows.shape[1])
    if peak >= 1 << 61:
        raise ValueError("components are too large for scores of 64 bits")
    planes = int(max(rows.max(initial=0), -rows.min(initial=0) - 1, 0)).bit_length() + 1
    exact = np.float32 if rows.shape[1] * int(np.abs(anchors).max(initial=0)) < 1 << 24 else np.float64
    gain, loss = np.maximum(anchors, 0).sum(1), np.minimum(anchors, 0).sum(1)
    across = anchors.T.astype(exact)
    r, a = np.arange(len(rows)), np.arange(len(anchors))
    score = np.zeros(may.shape, dtype=np.int64)
    plane = planes
    while plane and may.any():
        plane -= 1
        bits = ((rows[r] >> plane) & 1).astype(exact)
        score += (bits @ across[:, a]).astype(np.int64) * (-(1 << plane) if plane == planes - 1 else 1 << plane)
        left = (1 << plane) - 1
        least, most = score + left * loss[a], score + left * gain[a]
        alive = np.zeros(may.shape, dtype=bool)
        for lo, hi in zip(low[:, a], high[:, a]):
            alive |= (most >= lo) & (least <= hi)
        may = may & alive
        if best and len(r) > best:
            certain = np.where(may, least, _LEAST)
            may &= most >= np.partition(certain, len(r) - best, axis=0)[len(r) - best]
        if may.sum() < SPARSE * may.size:
            break
        some, of = may.any(1), may.any(0)
        if some.mean() < 0.7 or of.mean() < 0.7:
            r, a, score, may = r[some], a[of], score[np.ix_(some, of)], may[np.ix_(some, of)]
    i, k = np.nonzero(may)
    found, i, k = score[i, k], r[i], a[k]
    while plane and len(i):
        plane -= 1
        add = np.zeros(len(i), dtype=np.int64)
        for at in range(0, len(i), PAIRS_AT_ONCE // 16):
            part = slice(at, at + PAIRS_AT_ONCE // 16)
            add[part] = (((rows[i[part]] >> plane) & 1) * anchors[k[part]]).sum(1)
        found = found + add * (-(1 << plane) if plane == planes - 1 else 1 << plane)
        left = (1 << plane) - 1
        least, most = found + left * loss[k], found + left * gain[k]
        keep = ((most >= low[:, k]) & (least <= high[:, k])).any(0)
        i, k, found = i[keep], k[keep], found[keep]
    return i, k, found


class Best:
    """The best ``n`` (score, id) of each of ``size`` slots: higher scores, then smaller ids."""

    def __init__(self, size: int, n: int):
        self.size, self.n = size, n
        self.slot = self.score = self.id = np.zeros(0, dtype=np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot = slot[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        order = order[place < self.n]
        self.slot, self.score, self.id = slot[place < self.n], score[order], ids[order]

    def floor(self) -> np.ndarray:
        """The score that a newcomer has to reach in each slot."""
        out = np.full(self.size, _LEAST)
        full = np.bincount(self.slot, minlength=self.size) == self.n
        last = np.searchsorted(self.slot, np.arange(self.size), side="right") - 1
        out[full] = self.score[last[full]]
        return out


def _participants(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    given = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), vector.alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = given.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & sound)
    one = given.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("m"))
    return one.select("id", F.col("m.label").alias("label"), F.transform("m.vector", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")).alias("vector"), F.pmod(F.xxhash64("m.label"), F.lit(LABEL_BUCKETS)).cast("int").alias("bucket"))


def _packed(comps: list[np.ndarray]) -> tuple[int, int, bytes]:
    """(dims, bytes of a component, all components); shorter vectors end in zeros."""
    dims = max(map(len, comps), default=0)
    whole = np.zeros((len(comps), dims))
    for row, c in zip(whole, comps):
        row[: len(c)] = c
    if np.abs(whole).max(initial=0) >= 1 << 31:
        raise ValueError("a component is too large: scores would not fit 64 bits")
    width = 2 if np.abs(whole).max(initial=0) < 1 << 15 else 8
    return dims, width, whole.astype(f"<i{width}").tobytes()


def _unpacked(n: int, dims: int, width: int, comps: bytes) -> np.ndarray:
    return np.frombuffer(comps, dtype=f"<i{width}").reshape(n, dims).astype(np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one bucket each, from rows that are sorted by bucket."""
    part, number = TaskContext.get().partitionId(), 0
    ids, labels, comps, bucket = [], [], [], None

    def close() -> pa.RecordBatch:
        dims, width, code = _packed(comps)
        values = [[bucket], [part << 40 | number], [dims], [width], [ids], [labels], [code]]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["bucket", "block", "dims", "width", "ids", "labels", "comps"])

    for batch in batches:
        for i, (id_, label, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)))):
            if ids and (at != bucket or len(ids) == BLOCK_ROWS):
                yield close()
                number += 1
                ids, labels, comps = [], [], []
            bucket = at
            ids.append(id_)
            labels.append(label)
            comps.append(batch.column(2)[i].values.to_numpy(zero_copy_only=False))
    if ids:
        yield close()


def _anchors_in(every: int):
    """Rows of packed blocks whose ids are multiples of ``every``, each with its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.array(row["ids"], dtype=np.int64)
                at = np.flatnonzero(ids % every == 0)
                comps = _unpacked(len(ids), row["dims"], row["width"], row["comps"])[at].astype(np.float64)
                values = [ids[at], np.array(row["labels"], dtype=np.int64)[at], comps.tolist(), np.full(len(at), row["bucket"])]
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["id", "label", "vector", "bucket"])

    return run


def _block_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block of each run of rows with one ``a_block``."""
    rows: list[tuple] = []

    def close() -> pa.RecordBatch:
        dims, width, code = _packed([np.array(x[3]) for x in rows])
        windows = [x[4] or [] for x in rows]
        values = [[rows[0][0]], [0], [0], [0], [dims], [width], [[x[1] for x in rows]], [[x[2] for x in rows]], [code]]
        values += [[[len(w) for w in windows]], [[v["id"] for w in windows for v in w]], [[v["score"] for w in windows for v in w]]]
        longs = pa.list_(pa.int64())
        kinds = [pa.int32()] * 3 + [pa.int64(), pa.int32(), pa.int32(), longs, longs, pa.binary(), pa.list_(pa.int32()), longs, longs]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in _BLOCK.split(", ")])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and rows[0][0] != row[0]:
                yield close()
                rows = []
            rows.append(row)
    if rows:
        yield close()


class _AnchorBlock:
    def __init__(self, row: dict):
        self.ids, self.labels = np.array(row["ids"], dtype=np.int64), np.array(row["labels"], dtype=np.int64)
        self.comps = _unpacked(len(self.ids), row["dims"], row["width"], row["comps"])
        self.n_windows = np.array(row["n_windows"], dtype=np.int64)
        self.window_ids, self.window_scores = (np.array(row[c], dtype=np.int64) for c in ("window_ids", "window_scores"))
        self.first = np.cumsum(self.n_windows) - self.n_windows

    def tiles(self, row: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Parts of a block of rows: ids, labels, components, and the anchors' in as many dimensions."""
        ids, labels = np.array(row["ids"], dtype=np.int64), np.array(row["labels"], dtype=np.int64)
        comps = _unpacked(len(ids), row["dims"], row["width"], row["comps"])
        dims = max(comps.shape[1], self.comps.shape[1])
        comps, own = (np.pad(c, ((0, 0), (0, dims - c.shape[1]))) for c in (comps, self.comps))
        step = max(1, PAIRS_AT_ONCE // max(1, len(self.ids)))
        for at in range(0, len(ids), step):
            yield ids[at : at + step], labels[at : at + step], comps[at : at + step], own


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_AnchorBlock, Iterator[dict]]]:
    """Each block of anchors with the blocks of rows that follow it."""
    rows = (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist())
    ahead = next(rows, None)
    while ahead is not None:
        anchors = _AnchorBlock(ahead) if ahead["tag"] == 0 else None
        key = (ahead["a_block"], ahead["shard"])
        if anchors is not None:
            ahead = next(rows, None)

        def of_group() -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and (ahead["a_block"], ahead["shard"]) == key:
                yield ahead
                ahead = next(rows, None)

        own = of_group()
        if anchors is not None:
            yield anchors, own
        for _ in own:  # what was not read
            pass


def _find_positives(n_best: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, blocks in _streams(batches):
            best, n = Best(len(anchors.ids), n_best), len(anchors.ids)
            for row in blocks:
                for ids, labels, comps, own in anchors.tiles(row):
                    may = (labels[:, None] == anchors.labels) & (ids[:, None] != anchors.ids)
                    i, k, score = sliced_scores(comps, own, may, best.floor()[None, :], np.full((1, n), _MOST), n_best)
                    best.add(k, score, ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(anchors.ids[best.slot]), pa.array(best.id), pa.array(best.score)], names=["anchor_id", "id", "score"])

    return run


def _find_negatives(n_best: int, low_percent: int, high_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, blocks in _streams(batches):
            best = Best(len(anchors.window_ids), n_best)
            low = -(-low_percent * anchors.window_scores // 100)
            high = high_percent * anchors.window_scores // 100
            most = int(anchors.n_windows.max(initial=0))

            def spread(values: np.ndarray, none: int) -> np.ndarray:
                """A row for the first window of each anchor, one for the second, and so on."""
                out = np.full((most, len(anchors.ids)), none)
                for w in range(most):
                    has = anchors.n_windows > w
                    out[w, has] = values[anchors.first[has] + w]
                return out

            for row in blocks:
                for ids, labels, comps, own in anchors.tiles(row):
                    floor = spread(np.maximum(low, best.floor()), _MOST)
                    i, k, score = sliced_scores(comps, own, labels[:, None] != anchors.labels, floor, spread(high, _LEAST))
                    for w in range(most):
                        slot = anchors.first[k] + w
                        fits = anchors.n_windows[k] > w
                        fits[fits] = (score[fits] >= low[slot[fits]]) & (score[fits] <= high[slot[fits]])
                        best.add(slot[fits], score[fits], ids[i[fits]])
            of = np.repeat(anchors.ids, anchors.n_windows)
            columns = (of[best.slot], anchors.window_ids[best.slot], anchors.window_scores[best.slot], best.id, best.score)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def _meet(anchors: DataFrame, blocks: DataFrame, shards: Column, theirs: Column, groups: int) -> DataFrame:
    """Blocks of anchors, one in each of ``shards``, ahead of the blocks of rows that meet them.

    ``theirs`` are the numbers of the blocks of anchors that a block of rows meets.
    """
    names = [c.split()[0] for c in _BLOCK.split(", ")]
    to_rows = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1)))
    lists = [F.lit(None).cast("array<int>").alias("n_windows"), *(F.lit(None).cast("array<long>").alias(c) for c in ("window_ids", "window_scores"))]
    own = F.pmod(F.xxhash64("block"), shards).cast("int").alias("shard")
    to_anchors = blocks.select(F.explode(theirs).alias("a_block"), own, F.lit(1).alias("tag"), "block", "dims", "width", "ids", "labels", "comps", *lists)
    both = to_rows.select(*names).union(to_anchors.select(*names))
    return both.repartition(groups, "a_block", "shard").sortWithinPartitions("a_block", "shard", "tag", "block")


def mine(
    vectors: DataFrame,
    every: int = 100,
    n_positives: int = 5,
    n_negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose id is a multiple of ``every``; components x become
    floor(``scale`` * x).  An anchor's positives are its first ``n_positives`` other rows of
    its label by score, ties to the smaller id; for each of them the negatives are the first
    ``n_negatives`` rows of other labels whose score times 100 lies from ``low_percent`` to
    ``high_percent`` times the positive's, ranked from 1.

    Rows with a null id, label or vector, or with a null or non-finite component, take no
    part.  Of rows with one id the first by label and vector takes part, so repeated rows
    count once.  Of vectors of unequal lengths the shorter count as ending in zeros.  A
    component of 2^31 or more after scaling fails the job.  Anchors without positives or
    without rows in a window give no rows; an empty table gives none.  Other columns are
    ignored.  Jobs run when it is called: blocks, anchors and positives are written.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    part = _participants(vectors, id_col, vector_col, label_col, scale).sortWithinPartitions("bucket")
    kinds = "bucket int, block long, dims int, width int, ids array<long>, labels array<long>, comps binary"
    blocks = scratch.keep("blocks", part.mapInArrow(_pack, kinds))
    anchors = scratch.keep("anchors", blocks.mapInArrow(_anchors_in(every), "id long, label long, vector array<double>, bucket int"))

    # At most LABEL_BUCKETS rows each.
    rows = {r.bucket: r.n for r in blocks.groupBy("bucket").agg(F.sum(F.size("ids")).alias("n")).collect()}
    asked = {r.bucket: r.n for r in anchors.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    parts = [-(-asked.get(b, 0) // BLOCK_ANCHORS) for b in range(LABEL_BUCKETS)]
    first = [sum(parts[:b]) for b in range(LABEL_BUCKETS)]
    tasks = 2 * spark.sparkContext.defaultParallelism

    def of_bucket(values: list[int]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("bucket") + 1)

    own_block = (of_bucket(first) + F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), of_bucket(parts)))).cast("int").alias("a_block")

    def anchor_blocks(given: DataFrame, windows: Column) -> DataFrame:
        named = given.select(own_block, "id", "label", "vector", windows.alias("windows"))
        return named.repartition("a_block").sortWithinPartitions("a_block", "id").mapInArrow(_block_anchors, _BLOCK)

    kind = "array<struct<score:bigint,id:bigint>>"
    if not asked:
        found = spark.createDataFrame([], "anchor_id long, id long, score long")
    else:
        # A bucket's rows meet the blocks of anchors of its labels.
        shards = [max(1, -(-rows.get(b, 0) // SHARD_ROWS), -(-tasks // max(1, sum(parts)))) if parts[b] else 1 for b in range(LABEL_BUCKETS)]
        theirs = F.when(of_bucket(parts) > 0, F.sequence(of_bucket(first), of_bucket(first) + of_bucket(parts) - 1)).otherwise(F.array().cast("array<int>"))
        alike = F.element_at(F.array(*map(F.lit, shards)), F.col("bucket") + 1)
        with_bucket = anchor_blocks(anchors, F.lit(None).cast(kind)).withColumn("bucket", F.pmod(F.xxhash64(F.col("labels")[0]), F.lit(LABEL_BUCKETS)).cast("int"))
        met = _meet(with_bucket, blocks, alike, theirs, sum(p * s for p, s in zip(parts, shards)) or 1)
        found = met.mapInArrow(_find_positives(n_positives), "anchor_id long, id long, score long")
    place = F.row_number().over(W.Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    found = found.withColumn("place", place).where(F.col("place") <= n_positives)
    windows = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("score", "id")), asc=False).alias("windows"))
    asking = scratch.keep("asking", anchors.join(windows.withColumnRenamed("anchor_id", "id"), "id"))
    n_shards = max(1, -(-sum(rows.values()) // SHARD_ROWS), -(-tasks // max(1, sum(parts))))
    n_blocks = max(1, sum(parts))
    met = _meet(anchor_blocks(asking, F.col("windows")), blocks, F.lit(n_shards), F.sequence(F.lit(0), F.lit(n_blocks - 1)), n_blocks * n_shards)
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    made = met.mapInArrow(_find_negatives(n_negatives, low_percent, high_percent), schema)
    rank = F.row_number().over(W.Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = made.withColumn("rank", rank.cast("int")).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
