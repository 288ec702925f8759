import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import toxicity


def corpus(spark, n, seed):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [r.choice("the of and tree house river walks sees green old new small".split()) + r.choice(["", "s", "er"]) for _ in range(r.randrange(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(r.randrange(1, 2 + len(words) // 15)):
                words[r.randrange(len(words))] = "vilex" + r.choice(["a", "on", "ist", "um", "er"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark, 600, 1)
    features, model = toxicity.fit(docs, labels.where("doc_id % 3 <> 0"))
    found = toxicity.score(docs.where("doc_id % 3 = 0"), features, model).join(labels.withColumnRenamed("toxic", "truth"), "doc_id").collect()
    wrong = [r for r in found if r.toxic != (r.truth > 0)]
    assert len(found) == 200 and len(wrong) <= 4
    assert len(model.thresholds) == toxicity.GRADES - 1 and (np.diff(model.thresholds) > 0).all()


def test_fit_is_ordered_and_recovers_weights():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 2))
    score = 2 * x[:, 0] - x[:, 1]
    grades = np.searchsorted([-1.0, 1.0, 2.0], score + r.logistic(size=3000))
    rows, columns = np.repeat(np.arange(3000), 2), np.tile([0, 1], 3000)
    model = toxicity.fit_ordinal(rows, columns, x.ravel(), grades, 2, l2=0.0)
    assert np.allclose(model.weights, [2, -1], atol=0.2) and np.allclose(model.thresholds, [-1, 1, 2], atol=0.25)


def test_odd_rows_and_no_labels(spark, odd, odd_rows, empty):
    docs, labels = corpus(spark, 200, 2)
    features, model = toxicity.fit(docs, labels.union(labels).withColumn("extra", F.lit(1)))
    found = toxicity.score(odd.withColumn("toxic", F.lit("clash")), features, model).collect()
    assert len(found) == len(odd_rows) and not any(r.toxic for r in found)
    assert toxicity.score(empty, features, model).collect() == []
    for none in (labels.limit(0), labels.where("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        features, model = toxicity.fit(docs, none)
        assert not any(r.toxic for r in toxicity.score(docs, features, model).collect())


def test_sample_is_bounded_and_repeats(spark):
    docs, labels = corpus(spark, 100, 3)
    once = toxicity.sample_labelled(docs, labels, 20).collect()
    assert len(once) == 20 and sorted(map(str, once)) == sorted(map(str, toxicity.sample_labelled(docs, labels, 20).collect()))


def test_repeats_are_one_document(spark):
    docs, labels = corpus(spark, 60, 4)
    once = sorted(map(str, toxicity.sample_labelled(docs, labels).collect()))
    assert sorted(map(str, toxicity.sample_labelled(docs.union(docs).union(docs), labels.union(labels)).collect())) == once and len(once) == 60


def test_fit_converges():
    """At the fit the likelihood is flat: a small move in any direction does not raise it."""
    r = np.random.default_rng(1)
    rows, columns, values = np.repeat(np.arange(400), 3), r.integers(0, 20, 1200), r.random(1200)
    grades = r.integers(0, 4, 400)
    model = toxicity.fit_ordinal(rows, columns, values, grades, 20)

    def loss(weights, thresholds):
        score = np.bincount(rows, weights[columns] * values, minlength=400)
        at_least = np.column_stack([np.ones(400), 1 / (1 + np.exp(thresholds[None, :] - score[:, None])), np.zeros(400)])
        p = at_least[np.arange(400), grades] - at_least[np.arange(400), grades + 1]
        return -np.log(p).mean() + toxicity.L2 / 2 * weights @ weights

    best = loss(model.weights, model.thresholds)
    for k in range(20):
        for step in (-1e-3, 1e-3):
            moved = model.weights.copy()
            moved[k] += step
            assert loss(moved, model.thresholds) > best - 1e-9


def test_held_out_labels_and_order_of_severity(spark):
    """Fitted on the labels of even ids, on the others: recall, precision and that severity grows with the share of marked words."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    features, model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    truth = {r.doc_id: r.toxic for r in labels.where("doc_id % 2 = 1 and toxic is not null").collect()}
    found = {r.doc_id: r for r in toxicity.score(docs.join(labels.select("doc_id").where("doc_id % 2 = 1"), "doc_id", "left_semi"), features, model).collect()}
    caught = [i for i, t in truth.items() if t and found[i].toxic]
    flagged = [i for i in truth if found[i].toxic]
    assert len(caught) >= 0.9 * sum(truth.values()) and len(caught) >= 0.9 * len(flagged)
    assert np.mean([found[i].severity for i in truth if truth[i]]) > 10 * np.mean([found[i].severity for i in truth if not truth[i]])
    assert all(0 <= r.severity <= toxicity.GRADES - 1 and r.p_toxic <= r.severity + 1e-9 for r in found.values())
    # More toxic words in a text never lower its severity.
    marks = sorted(features.numbers, key=lambda f: -model.weights[features.numbers[f]])
    word = next(f[:-1] for f in marks if f.endswith("$"))
    mixed = spark.createDataFrame([(k, " ".join([word] * k + ["zz"] * (60 - k))) for k in range(0, 61, 5)], "doc_id long, text string")
    severity = [r.severity for r in toxicity.score(mixed, features, model).orderBy("doc_id").collect()]
    assert severity == sorted(severity) and severity[-1] > severity[0]


def test_the_query_on_labelled_documents(spark):
    from gridloom.llm import queries

    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic is not null")
    found = queries.op2_toxicity(spark, "/root/testdata/sf0.1")
    assert found.count() == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    n = {(r[0], r[1]): r["count"] for r in found.join(labels.select("doc_id", F.col("toxic").alias("truth")), "doc_id").groupBy("truth", "toxic").count().collect()}
    assert n.get((1, True), 0) >= 0.9 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.01 * n[0, False]
