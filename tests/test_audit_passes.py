"""Passes of the evaluated audit: digests found once, parts of a fit that share tasks, forests dealt once."""

import numpy as np
import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from plumbrow.operators import autoencoder, classifiers, transforms
from plumbrow.operators.autoencoder import AutoencoderFit
from plumbrow.operators.classifiers import Classifier
from plumbrow.plans import study
from plumbrow.plans.leakage import leakage_audit


def rows_of(spark, n=300, width=3):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, width))
    return spark.createDataFrame([(i, int(r[0] > 0), r.tolist(), *r.tolist()) for i, r in enumerate(x)], "k long, label int, f array<double>, a double, b double, c double")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_evaluations_read_stored_splits(spark):
    seen = []

    def evaluate(df):
        seen.append(df)
        return df.agg(F.count(F.when(F.col("split") == "test", 1)).cast("double").alias("n_test"))

    report = leakage_audit(rows_of(spark), "label", ["a", "b", "c"], ["k"], evaluate=evaluate)
    got = {(r["item"], r["metric"]): r["value"] for r in report.filter("section = 'metrics'").collect()}
    assert got == {("random", "n_test"): 60.0, ("group", "n_test"): 60.0, ("delta", "n_test"): 0.0}
    assert len(seen) == 2 and not any("md5" in plan(df) for df in seen)


def test_parts_that_share_a_task_give_the_same_fit(spark, monkeypatch):
    df = rows_of(spark)
    fit = lambda **more: AutoencoderFit("f", "z", key=["k"], hidden=(8,), latent=2, epochs=3, batch=16, rowsPerTask=40, **more)
    tasks = []
    real = autoencoder._pack
    monkeypatch.setattr(autoencoder, "_pack", lambda chunk: tasks.append(1) or real(chunk))
    alone = fit().fit(df)
    monkeypatch.setattr(autoencoder, "MANY_TASKS", 2)  # eight parts in two tasks and not eight
    stored = df.withColumn("d", fit().order().digest(df))
    together = fit(digest="d").fit(stored)
    weights = lambda m: np.array(m.getOrDefault("weights"))
    assert len(tasks) == 2 and np.allclose(weights(alone), weights(together), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("width", [3, transforms.NARROW + 1])
def test_moments_beside_each_other_are_those_of_rows_a_position(spark, width):
    rows = [(i, [float(i * p % 7) for p in range(width)]) for i in range(20)] + [(20, None), (21, [None] * width)]
    df = spark.createDataFrame(rows, "k long, x array<double>").coalesce(1)
    want = transforms.array_moments(df, "x").orderBy("pos").collect()
    got = transforms._state(df, "x")
    assert [[r[c] for c in ("mean", "std", "low", "high")] for r in got] == [[r[c] for c in ("mean", "std", "low", "high")] for r in want]
    ragged = df.unionByName(spark.createDataFrame([(22, [1.0] * (width + 2))], df.schema))
    assert len(transforms._state(ragged, "x")) == width + 2 and transforms._state(df.limit(0), "x") == []
    shifted = transforms.StandardizeModel(mean=[1.0] * width, scale=[2.0] * width, inputCol="x", outputCol="y").transform(df)
    short = shifted.unionByName(transforms.StandardizeModel(mean=[1.0] * width, scale=[2.0] * width, inputCol="x", outputCol="y").transform(
        spark.createDataFrame([(23, [5.0])], df.schema)))
    by = {r["k"]: (r["x"], r["y"]) for r in short.collect()}
    assert by[20] == (None, None) and by[21][1] == [None] * width and by[23][1] == [2.0]
    assert all(y == [(v - 1.0) / 2.0 for v in x] for k, (x, y) in by.items() if k < 20)


def test_a_forest_that_is_dealt_again_is_dealt_once(spark, monkeypatch):
    levels = []
    from pyspark.sql.classic.dataframe import DataFrame

    real = DataFrame.persist
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a: levels.append(a) or real(self, *a))
    monkeypatch.setattr(classifiers, "TASK_BYTES", 25 * (4 * 3 + 8 * 3 + 330))
    fitted = Classifier("forest", {"trees": 3, "depth": 4}, "balanced").fit(rows_of(spark), "f")
    assert levels == [(StorageLevel.DISK_ONLY,)] and fitted.model.getNumTrees == 3
    assert not fitted.model._java_obj.getCacheNodeIds()


def test_the_evaluator_stores_what_it_reads(spark, monkeypatch):
    stored = []
    real = study.settle
    monkeypatch.setattr(study, "settle", lambda df: stored.append(df.columns) or real(df))
    latent = study.Latent(width=2, activation="tanh", epochs=1)
    evaluate = study.audit_evaluator("f", ["k"], latent, Classifier("forest", {"trees": 3, "depth": 3}, "balanced"))
    out = evaluate(rows_of(spark).withColumn("split", F.when(F.col("k") % 5 == 0, "test").otherwise("train"))).first()
    assert 0 <= out["accuracy"] <= 1 and ["label", "split", "e"] in stored and ["k", "x", "_digest"] in stored
