"""k-means of several k at once against plain numpy and Spark's evaluator."""

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tavola.operators import kmeans as K
from tavola.operators import ml as M


def rows(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, _z array<double>").repartition(3)


def points(n=300):
    rng = np.random.default_rng(3)
    middle = np.array([[0, 0, 0], [6, 0, 0], [0, 6, 1], [5, 5, 5]])
    return middle[rng.integers(0, 4, n)] + rng.normal(scale=0.7, size=(n, 3))


def test_equal_to_plain_rounds_and_evaluator(spark):
    x = points()
    df = rows(spark, x)
    centres, scores = K.fit_all(df, range(2, 6), rounds=15)
    order = np.array([r[0] for r in df.orderBy(F.xxhash64("_z"), "_z").select("_z").collect()])
    evaluator = ClusteringEvaluator(featuresCol="v", predictionCol="cluster")
    for k, silhouette, inertia, ch, db in scores:
        c = K.spread_first(order, k, 42)
        for _ in range(15):
            near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
        assert centres[k] == pytest.approx(c, abs=1e-3)
        gap = ((x[:, None] - centres[k][None]) ** 2).sum(axis=2)
        near = gap.argmin(axis=1)
        assert inertia == pytest.approx(gap.min(axis=1).sum())
        labelled = df.withColumn("cluster", K.nearest(centres[k].tolist())).withColumn("v", array_to_vector("_z"))
        got = {r.id: r.cluster for r in labelled.collect()}
        assert [got[i] for i in range(len(x))] == near.tolist()
        assert silhouette == pytest.approx(evaluator.evaluate(labelled), abs=1e-9)
        spread = np.array([np.sqrt(gap[near == j, j]).mean() for j in range(k)])
        away = np.sqrt(((centres[k][:, None] - centres[k][None]) ** 2).sum(axis=2))
        want = np.mean([max((spread[i] + spread[j]) / away[i, j] for j in range(k) if j != i) for i in range(k)])
        assert db == pytest.approx(want)
        n = np.bincount(near, minlength=k)
        between = (n * ((centres[k] - (centres[k] * n[:, None]).sum(axis=0) / n.sum()) ** 2).sum(axis=1)).sum()
        assert ch == pytest.approx(between / (k - 1) / (inertia / (len(x) - k)))
    assert max(scores, key=lambda r: r[1])[0] == 4


def test_choice_and_segments(spark):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(points())], "customer_id long, a double, b double, c double")
    scores = M.choose_k(df, ["a", "b", "c"], 2, 6)
    assert [r.k for r in scores.where("chosen").collect()] == [4]
    clustered, centres = M.fit_segments(df, ["a", "b", "c"], M.best_centres(scores))
    means = {r.cluster: r for r in clustered.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in "abc"]).collect()}
    for r in centres.collect():
        assert [means[r.cluster][c] for c in "abc"] == pytest.approx([r[c] for c in "abc"], abs=1e-2)


def test_few_and_equal_rows(spark):
    assert K.fit_all(rows(spark, np.zeros((0, 2))), [2]) == ({}, [])
    centres, scores = K.fit_all(rows(spark, np.ones((40, 2))), [2, 3])
    assert (centres[3] == 1).all() and [r[1:] for r in scores] == [(0.0, 0.0, None, None)] * 2
    _, scores = K.fit_all(rows(spark, np.array([[0.0, 0.0], [1.0, 0.0]])), [2, 4])
    assert scores[0][2] == 0.0
