"""Partitions of forests, and K-Means steps of several starts in one job."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from plumbrow.operators import classifiers
from plumbrow.operators.classifiers import Classifier, best_kmeans, lloyd


def points(spark, n=400, tasks=3):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (n // 2, 4)), rng.normal(1.5, 1, (n - n // 2, 4))])
    rows = [(i, int(i >= n // 2), r.tolist()) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "i long, label int, z array<double>").repartition(tasks), x


def test_a_forest_reads_parts_of_bounded_size(spark, monkeypatch):
    rows, _ = points(spark)
    assert classifiers.forest_parts(rows, "z", 20) is rows
    seen = []
    real = classifiers.as_vector
    monkeypatch.setattr(classifiers, "as_vector", lambda df, *a: seen.append(df) or real(df, *a))
    monkeypatch.setattr(classifiers, "TASK_BYTES", 25 * (4 * 4 + 8 * 3 + 330))
    Classifier("forest", {"trees": 3, "depth": 2}, "balanced").fit(rows, "z")
    sizes = seen[0].rdd.glom().map(len).collect()
    assert len(sizes) == 16 and sum(sizes) == 400 and max(sizes) <= 35
    assert classifiers.forest_parts(rows.limit(0), "z", 3).count() == 0


def test_starts_end_as_those_of_spark(spark):
    rows, _ = points(spark)
    vectors = classifiers.as_vector(rows, "z", "v")
    want = [KMeans(k=2, featuresCol="v", seed=42 + i, maxIter=300).fit(vectors) for i in range(4)]
    best = min(want, key=lambda m: m.summary.trainingCost)
    got = best_kmeans(rows, "z", starts=4)  # several starts end at the least cost
    order = lambda m: sorted(c.tolist() for c in m.clusterCenters())
    assert np.allclose(order(got), order(best))
    assert got.summary.trainingCost == pytest.approx(best.summary.trainingCost)


def test_one_job_a_step_serves_all_starts(spark):
    rows, x = points(spark)
    # The middles of the third start hold all rows and none: the empty cluster keeps its centre.
    starts = [x[[0, 399]], x[[3, 5]], np.stack([np.zeros(4), np.full(4, 1e6)])]
    sc = spark.sparkContext
    sc.setJobGroup("steps", "steps")
    try:
        found = lloyd(rows.select("z"), starts)
        jobs = len(sc.statusTracker().getJobIdsForGroup("steps"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    steps = [f.summary.numIter for f in found]
    assert sum(steps) > max(steps) + 2
    # A step is one query: its shuffles are jobs of their own with adaptive execution.
    assert jobs <= 3 * max(steps)
    for first, f in zip(starts, found):
        centers = first
        for _ in range(f.summary.numIter):
            own = np.square(x[:, None] - centers[None]).sum(axis=2).argmin(axis=1)
            centers = np.stack([x[own == c].mean(axis=0) if (own == c).any() else centers[c] for c in range(2)])
        assert np.allclose(np.stack(f.clusterCenters()), centers)


def test_deep_trees_are_grown_in_groups_over_few_partitions(spark, monkeypatch, tmp_path):
    rows, x = points(spark, tasks=6)
    seen = []
    real = classifiers.as_vector
    monkeypatch.setattr(classifiers, "as_vector", lambda df, *a: seen.append(df) or real(df, *a))
    monkeypatch.setattr(classifiers, "GROUP_ROWS", 400)
    fitted = Classifier("forest", {"trees": 30, "depth": 20}, "balanced").fit(rows, "z")
    assert len(seen) == 12 and {df.rdd.getNumPartitions() for df in seen} == {1}  # one partition and six before
    forest = fitted.model
    assert [f.getNumTrees for f in forest.forests] == [3] * 6 + [2] * 6 and forest.getNumTrees == 30
    assert len({t.toDebugString for f in forest.forests for t in f.trees}) == 30  # no two groups draw the same rows

    # The score is the mean over all trees of the class shares of their leaves.
    scored = sorted(fitted.score(rows).collect(), key=lambda r: r["i"])
    trees = [t for f in forest.forests for t in f.trees]
    vector = lambda r: Vectors.dense(r["z"])
    for r in scored[:5] + scored[-5:]:
        votes = np.sum([t.predictRaw(vector(r)).toArray() / t.predictRaw(vector(r)).toArray().sum() for t in trees], axis=0)
        assert r["score"] == pytest.approx(votes[1] / votes.sum()) and r["pred"] == int(votes.argmax())
    assert set(scored[0].asDict()) == {"i", "label", "z", "score", "pred"}
    assert np.mean([r["pred"] == r["label"] for r in scored]) > 0.95
    assert forest.featureImportances.toArray().sum() == pytest.approx(1) and forest.numFeatures == 4
    assert forest.totalNumNodes == sum(t.numNodes for t in trees)
    forest.save(str(tmp_path / "forest"))

    # Shallow trees, small tables and tables that fill the cores by themselves are Spark's alone.
    assert not hasattr(Classifier("forest", {"trees": 3, "depth": 12}).fit(rows, "z").model, "forests")
    monkeypatch.setattr(classifiers, "GROUP_ROWS", 401)
    assert not hasattr(Classifier("forest", {"trees": 3, "depth": 20}).fit(rows, "z").model, "forests")
    monkeypatch.setattr(classifiers, "GROUP_ROWS", 400)
    monkeypatch.setattr(classifiers, "TASK_BYTES", 25 * (4 * 4 + 8 * 3 + 330))
    seen.clear()
    assert not hasattr(Classifier("forest", {"trees": 30, "depth": 20}).fit(rows, "z").model, "forests") and len(seen) == 1


def test_groups_score_in_queries_of_their_own(spark, monkeypatch):
    rows, _ = points(spark, tasks=6)
    monkeypatch.setattr(classifiers, "GROUP_ROWS", 400)
    fitted = Classifier("forest", {"trees": 24, "depth": 20}, "balanced").fit(rows, "z")
    stored = []
    real = classifiers.settle
    monkeypatch.setattr(classifiers, "settle", lambda df: stored.append(df) or real(df))
    scored = fitted.score(rows.withColumn("_other", F.lit("a")))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UDF") == 2  # to a vector and back; the trees of all twelve groups stood beside them
    assert len(stored) == 13 and {df.rdd.getNumPartitions() for df in stored[1:]} == {1}
    once = sorted(map(tuple, scored.collect()))
    assert len(once) == 400 and once == sorted(map(tuple, fitted.score(rows.repartition(2).withColumn("_other", F.lit("a"))).collect()))
    twice = fitted.score(rows.union(rows)).select("i", "score").collect()
    assert len(twice) == 800 and len(set(twice)) == 400
    assert fitted.score(rows.limit(0)).count() == 0
    monkeypatch.setattr(classifiers, "SCORE_ROWS", 100)
    stored.clear()
    assert len(fitted.score(rows).collect()) == 400 and {df.rdd.getNumPartitions() for df in stored[1:]} == {4}


def test_a_margin_fit_reads_few_partitions(spark, monkeypatch):
    rows, _ = points(spark, tasks=6)
    seen = []
    real = classifiers.as_vector
    monkeypatch.setattr(classifiers, "as_vector", lambda df, *a: seen.append(df) or real(df, *a))
    svm = Classifier("fourier_svm", {"dims": 16, "rounds": 5}, "balanced")
    wide = svm.fit(rows, "z")
    monkeypatch.setattr(classifiers, "MARGIN_BYTES", 100 * 8 * 16)
    narrow = svm.fit(rows, "z")
    assert [df.rdd.getNumPartitions() for df in seen] == [1, 4]
    assert np.allclose(wide.model.coefficients.toArray(), narrow.model.coefficients.toArray(), atol=0.05)
