import math

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from plumbrow.operators import clean, metrics, ranking, significance


def scored(spark, rows):
    df = spark.createDataFrame(rows, "label int, score double").withColumn("config", F.lit("c"))
    return metrics.score_counts(clean.with_prediction(df))


def test_tied_scores(spark):
    counts = scored(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.3), (1, 0.3)])
    row = metrics.ranking_metrics(counts, bucket_scores=1).first()
    assert row["auc_roc"] == pytest.approx(7 / 12) and row["pr_auc"] == pytest.approx(0.7555555555)


def test_one_class_only(spark):
    counts = scored(spark, [(0, 0.9), (0, 0.1)])
    ranks = metrics.ranking_metrics(counts).first()
    assert ranks["auc_roc"] is None and ranks["pr_auc"] is None
    row = metrics.attack_metrics(counts).first()
    assert (row["attack_recall"], row["attack_f1"], row["accuracy"]) == (0.0, 0.0, 0.5)


def test_no_positive_prediction_keeps_zero_cells(spark):
    counts = scored(spark, [(0, 0.1), (1, 0.2)])
    cells = metrics.confusion(counts).first()
    assert (cells["tn"], cells["fp"], cells["fn"], cells["tp"]) == (1, 0, 1, 0)
    assert metrics.attack_metrics(counts).first()["attack_precision"] == 0.0


@pytest.mark.parametrize("bucket_scores", [1, 3, 150, 500, 100_000])
def test_buckets_do_not_change_the_area(spark, bucket_scores):
    rows = spark.range(4000).select(
        (F.rand(1) < 0.3).cast("int").alias("label"),
        F.when(F.rand(2) < 0.34, F.lit(0.5)).otherwise(F.round(F.rand(3), 3)).alias("score"), F.lit("c").alias("config"),
    ).persist()
    got = metrics.ranking_metrics(metrics.score_counts(clean.with_prediction(rows)), bucket_scores=bucket_scores).first()
    exact = BinaryClassificationEvaluator(
        rawPredictionCol="score", labelCol="label", numBins=0
    ).evaluate(rows.withColumn("label", F.col("label").cast("double")))
    assert got["auc_roc"] == pytest.approx(exact, abs=1e-12)
    pairs = sorted(((r["score"], r["label"]) for r in rows.collect()), reverse=True)
    positives, seen, hits, area = sum(l for _, l in pairs), 0, 0, 0.0
    for s in sorted({s for s, _ in pairs}, reverse=True):
        tied = [l for x, l in pairs if x == s]
        seen, hits = seen + len(tied), hits + sum(tied)
        area += sum(tied) * hits / seen / positives
    assert got["pr_auc"] == pytest.approx(area, abs=1e-12)
    rows.unpersist()


def test_sweep_at_the_default_threshold(spark):
    counts = scored(spark, [(1, 0.9), (0, 0.8), (1, 0.2), (0, 0.1)])
    row = metrics.threshold_sweep(counts).filter("threshold = 0.5").first()
    assert (row["precision"], row["recall"], row["fpr"], row["alerts_per_1000"]) == (0.5, 0.5, 0.5, 500.0)


def test_best_trial_first_wins(spark):
    df = spark.createDataFrame([(3, 0.5), (1, 0.7), (2, 0.7), (4, None)], "trial int, f1 double")
    assert ranking.best_trial(df, "f1", "trial").first()["trial"] == 1


def folds(spark, a, b):
    rows = [("a", i, "m", x) for i, x in enumerate(a)] + [("b", i, "m", x) for i, x in enumerate(b)]
    return spark.createDataFrame(rows, "config string, fold int, metric string, value double")


def test_equal_folds_have_no_test(spark):
    row = significance.paired_tests(folds(spark, [0.5] * 5, [0.5] * 5), "a", "b").first()
    assert row["t"] is None and math.isnan(row["t_p"]) and math.isnan(row["wilcoxon_p"])


def test_smallest_signed_rank_p(spark):
    row = significance.paired_tests(folds(spark, [0.1] * 5, [0.2, 0.31, 0.42, 0.53, 0.64]), "a", "b").first()
    assert row["wilcoxon_p"] == 0.0625 and row["w_minus"] == 0.0


# Two-sided critical values of Student's t at 5 %, from published tables.
@pytest.mark.parametrize("df,t", [(1, 12.7062), (2, 4.3027), (4, 2.7764), (5, 2.5706), (9, 2.2622), (30, 2.0423)])
def test_t_distribution(df, t):
    assert significance.two_sided_t(t, df) == pytest.approx(0.05, abs=2e-5)
    assert significance.t_quantile(0.95, df) == pytest.approx(t, abs=1e-4)


def test_signed_rank_enumeration():
    from itertools import product

    ranks = [1.0, 2.5, 2.5, 4.0, 5.0, 6.0]
    sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in product((0, 1), repeat=6)]
    expect = min(1.0, 2 * sum(x <= 5.0 for x in sums) / 64)
    assert significance.two_sided_signed_rank(5.0, ranks) == expect


def test_interval_covers_mean(spark):
    row = significance.confidence_intervals(folds(spark, [0.1, 0.2, 0.3, 0.4, 0.5], [])).first()
    assert row["ci_low"] == pytest.approx(0.3 - 2.7764451 * 0.1581139 / 5 ** 0.5, abs=1e-5)
    assert row["std"] == pytest.approx(0.1414214, abs=1e-6)
