"""Target-distribution importance resampling without replacement.

Documents are weighed by how much more often their words occur in a target collection than
in the documents, over hashed buckets of word runs, and drawn by weight with Gumbel noise:
the draw is the documents of the highest scores.

Scores are whole thousandths of bounded logarithms, so all documents together have some
tens of thousands of different ones: their exact counts tell the driver where the draw
ends, and how to part it into ranges of scores of bounded size.  Each task sorts its own
eligible documents into a run and cuts it into blocks within ranges; a range's blocks meet
in one task, ordered by where they begin, and a tournament tree merges the runs, opening a
block only when the merge comes to it.  The range in which the draw ends stops at its exact
count.  Documents that are not drawn are not moved.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

BUCKETS = 10_000
#: Rows of a range of scores; only a single score that more rows have goes beyond it.
RANGE_ROWS = 10_000
#: Rows of a block at most.
BLOCK_ROWS = 2_048
#: Features whose buckets a worker remembers; bounds its memory.
FEATURES_KEPT = 500_000

# Bytes below 0x80 other than digits and letters part words; A-Z become a-z.
_CLEAN = bytes(b if 0x30 <= b < 0x3A or 0x61 <= b < 0x7B or b >= 0x80 else b + 32 if 0x41 <= b < 0x5B else 0x20 for b in range(256))


class _Remembered(dict):
    """Values of ``make`` by key, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, key):
        value = self[key] = self._make(key)
        return value


def _runs(text: str | None, longest: int) -> tuple[list[bytes], int]:
    """All runs of 1 to ``longest`` consecutive words of ``text``, and its number of words."""
    words = text.encode().translate(_CLEAN).split() if text else []
    found = words
    for n in range(2, longest + 1):
        found = found + [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return found, len(words)


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of features by bucket over all rows of ``texts``; null texts have none.

    Each task sends one row for each of its buckets, so the result, whose size is
    ``buckets``, is all that the driver gets.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0):
                seen.update(_runs(text.as_py(), longest)[0])
                if len(seen) > FEATURES_KEPT:
                    _add(total, seen)
                    seen.clear()
            _add(total, seen)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    def _add(total: np.ndarray, seen: Counter) -> None:
        if seen:
            at = np.fromiter((zlib.crc32(f) % buckets for f in seen), dtype=np.int64, count=len(seen))
            np.add.at(total, at, np.fromiter(seen.values(), dtype=np.int64, count=len(seen)))

    counted = texts.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths, rounded down, of the log ratio of the target's smoothed rates to the source's."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], dtype=np.int64)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise of ``key`` in thousandths, rounded down: the same on every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    u = (h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def weigh(docs: DataFrame, gains: np.ndarray, longest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, n_words, weight) of each row; a text without features weighs 0."""
    kind = docs.schema[id_col].dataType.simpleString()
    n_buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gains.tolist()
        gain = _Remembered(lambda f: table[zlib.crc32(f) % n_buckets])
        for batch in batches:
            features, words, weights = [], [], []
            for text in batch.column(1):
                found, n = _runs(text.as_py(), longest)
                features.append(len(found))
                words.append(n)
                weights.append(sum(map(gain.__getitem__, found)) // len(found) if found else 0)
                if len(gain) > FEATURES_KEPT:
                    gain.clear()
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (features, words, weights))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_features", "n_words", "weight"])

    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return given.mapInArrow(run, f"id {kind}, n_features long, n_words long, weight long")


class TournamentTree:
    """The least of the heads of k sorted sources; replacing one replays its way to the root.

    ``nodes[k + i]`` is source i and every inner node holds the winner of its two children,
    so a step takes log k comparisons.  A source that has ended has the head None.
    """

    def __init__(self, heads: list[tuple | None]):
        self.heads, self.k = heads, max(1, len(heads))
        self.nodes = [-1] * self.k + list(range(len(heads))) + [-1] * (self.k - len(heads))
        for i in range(self.k - 1, 0, -1):
            self.nodes[i] = self._winner(self.nodes[2 * i], self.nodes[2 * i + 1])

    def _winner(self, a: int, b: int) -> int:
        x, y = self.heads[a] if a >= 0 else None, self.heads[b] if b >= 0 else None
        return b if x is None or y is not None and y < x else a

    def first(self) -> int:
        """The source of the least head; its head is None where all have ended."""
        return self.nodes[1]

    def replace(self, source: int, head: tuple | None) -> None:
        self.heads[source] = head
        i = (self.k + source) // 2
        while i:
            self.nodes[i] = self._winner(self.nodes[2 * i], self.nodes[2 * i + 1])
            i //= 2

    def widen(self) -> int:
        """Room for more sources; the number of the first new one."""
        had = len(self.heads)
        self.__init__(self.heads + [None] * max(1, had))
        return had


def _columns(order: list[tuple], ranks: list[int | None], kinds: list[pa.DataType]) -> pa.RecordBatch:
    _, _, ids, features, weights, scores = zip(*order) if order else [()] * 6
    values = zip(([i if not gone else None for i, gone in zip(ids, (x[1] for x in order))], features, weights, scores, ranks), kinds)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in values], names=["id", "n_features", "weight", "score", "rank"])


def merged(blocks: Iterator[tuple[int, list[tuple]]]) -> Iterator[tuple]:
    """The rows of sorted runs in order.

    ``blocks`` gives (run, sorted rows) in order of the first rows; a run's blocks follow each
    other.  Only blocks whose first row has come up are held.
    """
    tree, slots, waiting, free = TournamentTree([None]), {}, {}, [0]

    def until(limit: tuple | None) -> Iterator[tuple]:
        while (head := tree.heads[tree.first()]) is not None and (limit is None or head < limit):
            at = tree.first()
            yield head
            rows = waiting[at][0]
            while waiting[at] and (row := next(rows, None)) is None:
                waiting[at].pop(0)
                rows = waiting[at][0] if waiting[at] else iter(())
            tree.replace(at, row if waiting[at] else None)

    for run, rows in blocks:
        if not rows:
            continue
        yield from until(rows[0])
        if run not in slots:
            if not free:
                first = tree.widen()
                free.extend(range(len(tree.heads) - 1, first - 1, -1))
            slots[run] = free.pop()
            waiting[slots[run]] = []
        at, own = slots[run], iter(rows)
        if tree.heads[at] is None:
            tree.replace(at, next(own))
        waiting[at].append(own)
    yield from until(None)


def ranges_of(counts: dict[int, int], draw: int) -> tuple[list[int], list[int]]:
    """The lowest scores and first ranks of ranges from the highest score down, until ``draw`` rows are in."""
    lowest, starts, had, start = [], [], 0, 0
    for score in sorted(counts, reverse=True):
        if start + had >= draw:
            break
        if had and had + counts[score] > RANGE_ROWS:
            starts.append(start)
            lowest.append(last)
            start, had = start + had, 0
        had, last = had + counts[score], score
    if had:
        starts.append(start)
        lowest.append(last)
    return lowest, starts


def draw(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    min_words: int = 20,
    seed: int = 2024,
    longest: int = 1,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """Every row's (id, n_features, weight, score, rank); rank is null where it is not drawn.

    Of the N rows with at least ``min_words`` words floor(percent * N / 100) are drawn: those
    of the highest scores, ties to the smaller id, ranks from 1.  Null ids come last among
    ties and share one noise; rows that repeat are drawn each on its own.  Null and empty
    texts have no features, weigh 0 and are never drawn where ``min_words`` is above 0.
    Empty tables give no rows; an empty target gives every bucket a gain by the documents
    alone.  Other columns are ignored.  Jobs run when it is called: the counts, the scores,
    which are written, and their histogram.
    """
    spark = docs.sparkSession
    gains = bucket_gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_text_col, longest, buckets))
    weighed = weigh(docs, gains, longest, id_col, text_col)
    eligible = (F.col("n_words") >= min_words).alias("eligible")
    scored = weighed.select("id", "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score"), eligible)
    scored = Scratch(spark, "importance").keep("scores", scored)
    # Weights and noise are thousandths of logarithms of 32-bit and 64-bit counts, so there
    # are at most some 100,000 different scores, whatever the number of rows.
    counts = {r.score: r.n for r in scored.where("eligible").groupBy("score").agg(F.count("*").alias("n")).collect()}
    n_drawn = percent * sum(counts.values()) // 100
    lowest, starts = ranges_of(counts, n_drawn)
    kind = docs.schema[id_col].dataType.simpleString()
    if not lowest:
        return scored.select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    in_draw = F.col("eligible") & (F.col("score") >= lowest[-1])
    ordered = scored.where(in_draw).select("id", "n_features", "weight", "score").sortWithinPartitions(F.desc("score"), F.asc_nulls_last("id"), "n_features", "weight")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run, number = TaskContext.get().partitionId(), 0
        bounds = -np.array(lowest)  # ascending
        for batch in batches:
            scores = batch.column(3).to_numpy()
            of = np.searchsorted(bounds, -scores)  # scores fall, so ranges rise
            edges = np.unique(np.concatenate((np.arange(0, len(of), BLOCK_ROWS), np.flatnonzero(np.diff(of)) + 1, [len(of)])))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                lists = [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), c.slice(a, b - a)) for c in batch.columns]
                head = [pa.array([int(of[a])], pa.int32()), pa.array([run], pa.int32()), pa.array([number], pa.int64()), batch.column(3).slice(a, 1), batch.column(0).slice(a, 1)]
                number += 1
                yield pa.RecordBatch.from_arrays([*head, *lists], names=["range", "run", "number", "score", "id", "ids", "features", "weights", "scores"])

    runs = ordered.mapInArrow(cut, f"range int, run int, number long, score long, id {kind}, ids array<{kind}>, features array<long>, weights array<long>, scores array<long>")
    dealt = runs.repartition("range").sortWithinPartitions("range", F.desc("score"), F.asc_nulls_last("id"), "run", "number")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        now: list[int] = []

        def blocks() -> Iterator[tuple[int, int, list[tuple]]]:
            for batch in batches:
                kinds[:] = [batch.column(4).type, *[pa.int64()] * 4]
                for i in range(batch.num_rows):
                    at, run = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                    ids, features, weights, scores = (batch.column(c)[i].values.to_pylist() for c in range(5, 9))
                    none = type(next((x for x in ids if x is not None), 0))()  # null ids come last and are compared with each other
                    yield at, run, [(-s, x is None, none if x is None else x, f, w, s) for x, f, w, s in zip(ids, features, weights, scores)]

        source = blocks()
        ahead = next(source, None)
        while ahead is not None:
            now[:] = [ahead[0]]

            def of_range() -> Iterator[tuple[int, list[tuple]]]:
                nonlocal ahead
                while ahead is not None and ahead[0] == now[0]:
                    yield ahead[1:]
                    ahead = next(source, None)

            some, rank = [], starts[now[0]]
            for row in merged(of_range()):
                some.append(row)
                if len(some) == BLOCK_ROWS:
                    yield _columns(some, _ranks(rank, len(some), n_drawn), kinds)
                    rank, some = rank + len(some), []
            if some:
                yield _columns(some, _ranks(rank, len(some), n_drawn), kinds)

    schema = f"id {kind}, n_features long, weight long, score long, rank long"
    rest = scored.where(~in_draw).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return dealt.mapInArrow(merge, schema).unionByName(rest)


def _ranks(before: int, n: int, n_drawn: int) -> list[int | None]:
    """The ranks of the next ``n`` rows; null past the draw's exact count."""
    return [r if r <= n_drawn else None for r in range(before + 1, before + n + 1)]
