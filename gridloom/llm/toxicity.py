"""Toxicity as ordered severity grades.

A cumulative-link model: P(grade >= k) = sigmoid(w . x - t_k) with one weight vector for
all grades and ordered thresholds t_1 < t_2 < ...  Features are sparse: words and the
beginnings of words, weighted by their rate in the whole text.  A document's expected
severity is the sum of P(grade >= k).
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Labelled rows that the model is fitted on at most.
MAX_LABELLED = 20_000
#: Features of the model; with their weights they go to every worker.
MAX_FEATURES = 4_000
#: Labelled documents that a feature must occur in.
MIN_DOCS = 4
#: Lengths of beginnings of words that are features.
BEGINNINGS = (3, 4, 5, 6)
GRADES = 4
#: Parts that labelled documents are dealt to; the others choose the features that mark a part's texts.
FOLDS = 5
L2 = 1e-3
#: Steps of the fit at most, and the largest part of the gradient at which it has converged.
STEPS = 500
CONVERGED = 1e-6

_WORD = re.compile(r"[^\W\d_]+")


def _features_of(word: str) -> list[str]:
    return [word + "$", *(word[:k] for k in BEGINNINGS if len(word) >= k)]


def _words(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


@dataclass
class Features:
    """Chosen features and their numbers; in order of how well they mark toxic documents."""

    numbers: dict[str, int]

    def __post_init__(self):
        self._heads = {f[:3] for f in self.numbers}

    def of(self, text: str | None) -> tuple[dict[int, int], int, int]:
        """(occurrences by feature, words with a feature, words)."""
        found: dict[int, int] = {}
        words, marked = _words(text), 0
        for w, n in words.items():
            if w[:3] in self._heads or w + "$" in self.numbers:
                hits = [i for f in _features_of(w) if (i := self.numbers.get(f)) is not None]
                marked += n * bool(hits)
                for i in hits:
                    found[i] = found.get(i, 0) + n
        return found, marked, words.total()


def rates(found: dict[int, int], n_words: int) -> tuple[list[int], list[float]]:
    return list(found), [math.sqrt(100 * n / max(1, n_words)) for n in found.values()]


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... as columns."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def maximise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int) -> np.ndarray:
    """Where ``f`` (value and gradient) is largest, by limited-memory BFGS from ``x`` on."""
    value, gradient = f(x)
    past: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=10)  # steps, and what the gradient fell by
    for _ in range(steps):
        if np.abs(gradient).max(initial=0.0) < CONVERGED:
            break
        way, shares = gradient.copy(), []
        for s, y in reversed(past):
            shares.append(s @ way / (s @ y))
            way -= shares[-1] * y
        if past:
            s, y = past[-1]
            way *= s @ y / (y @ y)
        for (s, y), share in zip(past, reversed(shares)):
            way += s * (share - y @ way / (s @ y))
        slope = gradient @ way
        size = 1.0 if past else min(1.0, 1 / np.abs(gradient).sum())
        while size > 1e-12:
            found, new = f(x + size * way)
            if found >= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        if size * (way @ (gradient - new)) > 1e-18:
            past.append((size * way, gradient - new))
        x, value, gradient = x + size * way, found, new
    return x


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, l2: float = L2, steps: int = STEPS) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty over a sparse matrix in triplets.

    Thresholds are kept in order as a first one and positive distances.  Grades that no row
    has still get their threshold.
    """
    n, top = len(grades), max(1, int(grades.max(initial=1)))

    def likelihood(params: np.ndarray) -> tuple[float, np.ndarray]:
        weights, free = params[:n_features], params[n_features:]
        distances = np.exp(np.clip(free[1:], -30, 30))
        thresholds = np.cumsum(np.concatenate([free[:1], distances]))
        score = np.bincount(rows, weights[columns] * values, minlength=n)
        bounds = np.concatenate([[-np.inf], thresholds, [np.inf]])
        lower, upper = bounds[grades] - score, bounds[grades + 1] - score
        f_lower = np.where(np.isinf(lower), 0.0, _sigmoid(np.where(np.isinf(lower), 0, lower)))
        f_upper = np.where(np.isinf(upper), 1.0, _sigmoid(np.where(np.isinf(upper), 0, upper)))
        p = np.maximum(f_upper - f_lower, 1e-12)
        d_score = f_upper + f_lower - 1  # of log p, by the score
        d_bounds = np.bincount(grades + 1, f_upper * (1 - f_upper) / p, top + 2) - np.bincount(grades, f_lower * (1 - f_lower) / p, top + 2)
        after = np.cumsum(d_bounds[1:-1][::-1])[::-1]  # a distance moves all thresholds from its own on
        # Distances have a weak penalty, which settles those of grades without rows.
        gradient = np.concatenate([np.bincount(columns, d_score[rows] * values, minlength=n_features), after[:1], after[1:] * distances]) / max(1, n)
        gradient[:n_features] -= l2 * weights
        gradient[n_features + 1 :] -= 1e-4 * free[1:]
        return np.log(p).sum() / max(1, n) - l2 / 2 * (weights @ weights) - 5e-5 * (free[1:] @ free[1:]), gradient

    found = maximise(likelihood, np.concatenate([np.zeros(n_features), [1.0], np.zeros(top - 1)]), steps)
    free = found[n_features:]
    return OrdinalModel(found[:n_features].copy(), np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])))


def sample_labelled(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, toxic, fold) of at most ``max_labelled`` labelled documents, the same in every run.

    Labels without an id or a value are left out.  Of repeated labels of an id the largest
    counts, of repeated documents with an id the first text.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    few = known.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id")
    found = found.groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return found.select("text", "toxic", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"))


def choose_features(sample: DataFrame, max_features: int = MAX_FEATURES, min_docs: int = MIN_DOCS) -> list[Features]:
    """For each fold the features that mark toxic rows of the others most: by log odds times the root of their number."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[int, bool], Counter] = {}
            for text, toxic, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                counts.setdefault((fold, toxic > 0), Counter()).update({f for w in _words(text.as_py()) for f in _features_of(w)})
            for (fold, toxic), found in counts.items():
                n = pa.array(found.values(), pa.int64())
                none = pa.array(np.zeros(len(found), dtype=np.int64))
                columns = [pa.array(found.keys(), pa.string()), pa.array(np.full(len(found), fold, dtype=np.int32)), *((none, n) if toxic else (n, none))]
                yield pa.RecordBatch.from_arrays(columns, names=["feature", "fold", "clean", "toxic"])

    n = {(r["fold"], r["toxic"]): r["count"] for r in sample.groupBy("fold", (F.col("toxic") > 0).alias("toxic")).count().collect()}
    at = lambda kind, k: F.sum(F.when(F.col("fold") != k, F.col(kind)).otherwise(0)).alias(f"{kind}_{k}")
    counted = sample.mapInArrow(explode, "feature string, fold int, clean bigint, toxic bigint").groupBy("feature")
    counted = counted.agg(*[at(kind, k) for kind in ("clean", "toxic") for k in range(FOLDS)], F.sum("toxic").alias("toxic"))
    counted = Scratch(sample.sparkSession, "toxicity").keep("features", counted.where(F.col("toxic") >= min_docs))
    chosen = []
    for k in range(FOLDS):
        n_clean, n_toxic = (sum(x for (fold, toxic), x in n.items() if fold != k and toxic == kind) for kind in (False, True))
        odds = F.log(((F.col(f"toxic_{k}") + 0.5) / (n_toxic + 1)) / ((F.col(f"clean_{k}") + 0.5) / (n_clean + 1)))
        best = counted.where(F.col(f"toxic_{k}") >= min_docs).withColumn("odds", odds).where("odds > 1")
        best = best.orderBy((F.col("odds") * F.sqrt(f"toxic_{k}")).desc(), "feature").limit(max_features)
        chosen.append(Features({r["feature"]: i for i, r in enumerate(best.select("feature").collect())}))
    return chosen


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **columns: str) -> tuple[Features, OrdinalModel]:
    """Features and model from labels that only tell toxic from not.

    Grade 0 is not toxic.  Toxic rows get grades 1 to ``GRADES - 1`` by how large a share of
    their words are marked, at that share's quantiles.  Rows are dealt to folds; a row's share
    and its features in the fit are those that the other folds' labels have chosen, so that
    no label grades or marks its own text.  Scoring uses the features of all.  Without toxic
    rows the model has no features and gives every text a small severity.
    """
    sample = Scratch(docs.sparkSession, "toxicity").keep("sample", sample_labelled(docs, labels, max_labelled, **columns))
    chosen = choose_features(sample)
    numbers = {f: i for i, f in enumerate(dict.fromkeys(f for c in chosen for f in c.numbers))}
    to_all = [[numbers[f] for f in c.numbers] for c in chosen]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, toxic, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found, marked, n_words = chosen[fold].of(text.as_py())
                found = {to_all[fold][i]: n for i, n in found.items()}
                for column, x in zip(out, (*rates(found, n_words), marked / max(1, n_words), toxic)):
                    column.append(x)
            kinds = (pa.list_(pa.int32()), pa.list_(pa.float64()), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["features", "rates", "share", "toxic"])

    # At most max_labelled rows, each with its few chosen features.
    found = sample.mapInArrow(vectors, "features array<int>, rates array<double>, share double, toxic int").collect()
    share = np.array([r["share"] for r in found])
    toxic = np.array([r["toxic"] > 0 for r in found], dtype=bool)
    if not toxic.any():
        return Features({}), OrdinalModel(np.zeros(0), np.arange(GRADES - 1) + 4.0)
    steps = np.quantile(share[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    grades = np.where(toxic, 1 + np.searchsorted(steps, share, side="left"), 0)
    order = sorted(range(len(found)), key=lambda i: (share[i], grades[i], found[i]["features"], found[i]["rates"]))  # sums in one order, whatever order rows come in
    rows = np.repeat(np.arange(len(order)), [len(found[i]["features"]) for i in order])
    flat = lambda key, kind: np.array([x for i in order for x in found[i][key]], dtype=kind)
    model = fit_ordinal(rows, flat("features", np.int64), flat("rates", float), grades[order].astype(np.int64), len(numbers))
    return Features(numbers), model


def score(docs: DataFrame, features: Features, model: OrdinalModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, severity (expected grade), p_toxic (P(grade >= 1)) and toxic of every row.

    Whole texts count; null and empty ones have no features.  Repeated rows each get a row.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((features, model))
    id_type = docs.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = shared.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(1)):
                found, _, n_words = features.of(text.as_py())
                if found:
                    columns, values = rates(found, n_words)
                    scores[i] = math.fsum(model.weights[c] * x for c, x in zip(columns, values))
            p = model.at_least(scores)
            arrays = [batch.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(p[:, 0] >= threshold)]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "severity", "p_toxic", "toxic"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(judge, f"`{id_col}` {id_type}, severity double, p_toxic double, toxic boolean")
