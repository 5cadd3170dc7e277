"""Vocabulary, sparse vectors and the logistic regression of classifier_scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from failscope.operators import logistic as G
from failscope.operators import ml

TEXTS = ["Fix the tool, fix the TOOL", "the plan_b was ÜBER 42", "straße ΟΔΟΣ x² ५६ a", "", None, "the the the", "fix the tool"]


def test_terms_and_vocabulary_as_counted_relationally(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string").repartition(3)
    low = df.select(G.lowered("t").alias("l"), ml.terms(F.col("t")).alias("w")).collect()
    assert all(G.split_terms(r.l) == r.w for r in low)
    monkeypatch.setattr(G, "HELD_TERMS", 1)  # counts are handed on in parts
    want = [(r.term, r.idf) for r in ml.vocabulary(ml.term_counts(df, "k", "t"), df.count()).orderBy("idx").collect()]
    assert ml.fit_vocabulary(df, "t") == want and [t for t, _ in want] == ["fix", "fix the", "the", "the tool", "tool"]


def test_sparse_vectors(spark):
    df = spark.createDataFrame([(1, "tool tool plan none", 2.0), (2, "nothing", 0.5), (3, None, 1.0)], "k int, t string, a double")
    got = {r.k: r for r in G.with_sparse_vectors(df, "t", [("plan", 3.0), ("tool", 2.0)], ["a"], ["k"], 2).collect()}
    w = {0: 3.0, 1: 2.0 * (1 + math.log(2))}
    length = math.hypot(*w.values())
    assert dict(zip(got[1].idx, got[1].val, strict=True)) == pytest.approx({k: v / length for k, v in w.items()})
    assert [(got[k].idx, got[k].z) for k in (2, 3)] == [([], [0.5]), ([], [1.0])]


def test_fit_reaches_the_minimum_in_few_passes(spark):
    """Spark's own fit took some 390 passes over the traces' vectors, one job each."""
    rng, rows, n_terms = random.Random(1), [], 40
    for i in range(900):
        y = rng.choice("AAAAABBC")
        idx = sorted({min(n_terms - 1, int(rng.expovariate(0.15))) for _ in range(rng.randrange(9))} | ({"A": {1}, "B": {2}, "C": {3}}[y] if rng.random() < 0.7 else set()))
        steps, tools = rng.gauss(0, 1) + (y == "B"), rng.gauss(0, 1)
        rows.append((i, y, idx, [len(idx) ** -0.5 for _ in idx], [steps, tools, steps + tools + rng.gauss(0, 1e-3), 0.0]))
    x = spark.createDataFrame(rows, "k int, label string, idx array<int>, val array<double>, z array<double>").repartition(5)
    spark.sparkContext.setJobGroup("fit", "fit")
    labels, w, values = G.fitted(x, n_terms, 4)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert labels == ["A", "B", "C"] and jobs < 60

    n, f = len(rows), np.zeros((len(rows), n_terms + 5))
    for r in rows:
        f[r[0], r[2]], f[r[0], n_terms:] = r[3], [*r[4], 1.0]
    y = np.array([labels.index(r[1]) for r in rows])
    each = np.array([n / (3 * np.sum(y == c)) for c in range(3)])[y]

    def full(v):
        v = v.reshape(3, -1)
        s = f @ v.T
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = ((p - np.eye(3)[y]) * each[:, None]).T @ f / n
        pen = v.copy()
        pen[:, -1] = 0
        return -(each @ np.log(p[np.arange(n), y])) / n + (pen**2).sum() / (2 * n), (g + pen / n).ravel()

    best, _ = G.minimised(full, np.zeros(w.size), 1e-9, 20000)
    assert full(w)[0] == pytest.approx(values[-1]) and full(w)[0] - full(best)[0] < 2e-4
    got = {r.k: r.predicted for r in G.predicted(x, labels, w, n_terms, ["k"]).collect()}
    assert [got[i] for i in range(n)] == [labels[i] for i in (f @ w.T).argmax(1)]


def test_traces_dataset_has_the_rows_of_the_general_one(spark):
    d = "/root/testdata/sf0.001"
    data, names = ml.traces_dataset(spark, d)
    general, same = ml.dataset(spark, d)
    cols = ["trace_id", "domain", "label", "split", "full_trace", *names]
    assert names == same and sorted(data.select(cols).collect()) == sorted(general.select(cols).collect())
    assert data.count() == general.count() > 0
