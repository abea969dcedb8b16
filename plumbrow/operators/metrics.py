"""Exact evaluation metrics.

Scored rows are first reduced to score counts: one record per configuration, score and
prediction with its positive and negative rows. Every metric is a grouped query over these
counts, so one shuffle of the rows serves all metrics and all configurations, and a score
shared by a third of the rows is a single record.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbrow.functions.columns import ratio
from plumbrow.session import settle

BUCKET_SCORES = 100_000  # distinct scores that one window is to hold
THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def score_counts(
    scored: DataFrame, by: Sequence[str] = ("config",), label: str = "label", score: str = "score", pred: str = "pred",
) -> DataFrame:
    """Reduce ``(by…, label, score, pred)`` rows to counts."""
    return scored.groupBy(*by, F.col(score).alias("score"), F.col(pred).alias("pred")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("pos"), F.count(F.when(F.col(label) != 1, 1)).alias("neg")
    )


def confusion(counts: DataFrame, by: Sequence[str] = ("config",)) -> DataFrame:
    """True/false negatives and positives; empty cells are 0."""
    cell = lambda p, c: F.coalesce(F.sum(F.when(F.col("pred") == p, F.col(c))), F.lit(0)).cast("long")
    return counts.groupBy(*by).agg(
        cell(0, "neg").alias("tn"), cell(1, "neg").alias("fp"), cell(0, "pos").alias("fn"), cell(1, "pos").alias("tp")
    )


def _prf(hit: Column, predicted: Column, actual: Column) -> tuple[Column, Column, Column]:
    return ratio(hit, predicted), ratio(hit, actual), ratio(2 * hit, predicted + actual)


def _classes() -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return _prf(tn, tn + fn, tn + fp), _prf(tp, tp + fp, tp + fn)


def attack_metrics(counts: DataFrame, by: Sequence[str] = ("config",)) -> DataFrame:
    """Accuracy and the positive-class metrics, with the false-positive rate."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall, f1 = _classes()[1]
    return confusion(counts, by).select(
        *by,
        ratio(tn + tp, tn + fp + fn + tp).alias("accuracy"),
        recall.alias("attack_recall"), precision.alias("attack_precision"), f1.alias("attack_f1"),
        ratio(fp, tn + fp).alias("false_positive_rate"),
    )


def per_class(counts: DataFrame, by: Sequence[str] = ("config",)) -> DataFrame:
    """Precision, recall, F1 and support of both classes."""
    rows = []
    for value, (p, r, f), support in zip((0, 1), _classes(), (F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp"))):
        rows.append(
            F.struct(
                F.lit(value).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                support.alias("support"),
            )
        )
    return confusion(counts, by).select(*by, F.inline(F.array(*rows)))


def averaged(counts: DataFrame, by: Sequence[str] = ("config",)) -> DataFrame:
    """Macro precision, recall and F1 and support-weighted F1."""
    weight = F.col("support").cast("double")
    return per_class(counts, by).groupBy(*by).agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"), ratio(F.sum(F.col("f1") * weight), F.sum(weight)).alias("weighted_f1"),
    )


def threshold_sweep(
    counts: DataFrame, by: Sequence[str] = ("config",), thresholds: Sequence[float] = THRESHOLDS,
) -> DataFrame:
    """Precision, recall, false-positive rate and alerts per 1,000 rows at every threshold.

    All thresholds are conditional sums of one aggregate, so the rows are read once.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    aggs = [total("pos").alias("p"), total("neg").alias("n")]
    for i, t in enumerate(thresholds):
        hit = F.col("score") >= F.lit(float(t))
        aggs += [total(F.when(hit, F.col("pos"))).alias(f"tp{i}"), total(F.when(hit, F.col("neg"))).alias(f"fp{i}")]
    rows = []
    for i, t in enumerate(thresholds):
        tp, fp = F.col(f"tp{i}"), F.col(f"fp{i}")
        rows.append(
            F.struct(
                F.lit(float(t)).alias("threshold"), ratio(tp, tp + fp).alias("precision"),
                ratio(tp, F.col("p")).alias("recall"), ratio(fp, F.greatest(F.col("n"), F.lit(1.0))).alias("fpr"),
                ratio(1000 * (tp + fp), F.col("p") + F.col("n")).alias("alerts_per_1000"),
            )
        )
    return counts.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*rows)))


def calibration(counts: DataFrame, by: Sequence[str] = ("config",)) -> DataFrame:
    """Brier score and share of positives."""
    pos, neg, s = F.col("pos").cast("double"), F.col("neg").cast("double"), F.col("score")
    n = F.sum(pos + neg)
    return counts.groupBy(*by).agg(
        ratio(F.sum(pos * (s - 1) * (s - 1) + neg * s * s), n).alias("brier_score"),
        ratio(F.sum(pos), n).alias("positive_rate"),
    )


def ranking_metrics(
    counts: DataFrame, by: Sequence[str] = ("config",), bucket_scores: int = BUCKET_SCORES,
) -> DataFrame:
    """ROC-AUC (ties half counted) and average precision (step sum).

    The distinct scores are dealt by range of configuration and score, about ``bucket_scores`` to a
    bucket, and stored with their bucket, so the scoring behind them runs once and a task that runs again
    sees the same buckets. A window over the bucket totals gives the counts above a bucket and windows inside the
    buckets do the rest, so no task sorts all scores, and a row is compared with few bounds whatever the number of buckets.
    """
    scores = counts.groupBy(*by, "score").agg(
        F.sum("pos").cast("double").alias("pos"), F.sum("neg").cast("double").alias("neg")
    )
    running = _running_in_buckets(scores, by, bucket_scores)
    pos, neg, ctp, cfp = (F.col(c) for c in ("pos", "neg", "ctp", "cfp"))
    return running.groupBy(*by).agg(
        ratio(F.sum(neg * (ctp - pos / 2)), F.sum(pos) * F.sum(neg), None).alias("auc_roc"),
        ratio(F.sum(pos * ctp / (ctp + cfp)), F.sum(pos), None).alias("pr_auc"),
    )


def _running(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Positives ``ctp`` and negatives ``cfp`` at or above each score."""
    down = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return scores.withColumn("ctp", F.sum("pos").over(down)).withColumn("cfp", F.sum("neg").over(down))


def _running_in_buckets(scores: DataFrame, by: Sequence[str], bucket_scores: int) -> DataFrame:
    scores = settle(scores)
    buckets = max(1, math.ceil(scores.count() / bucket_scores))
    dealt = scores.repartitionByRange(buckets, *by, F.desc("score"))
    scores = settle(dealt.withColumn("bucket", -F.spark_partition_id()))  # higher scores of a configuration in higher buckets
    higher = Window.partitionBy(*by).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    above = (
        scores.groupBy(*by, "bucket").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
        .withColumn("above_pos", F.coalesce(F.sum("bp").over(higher), F.lit(0.0)))
        .withColumn("above_neg", F.coalesce(F.sum("bn").over(higher), F.lit(0.0)))
        .drop("bp", "bn")
    )
    inside = _running(scores, [*by, "bucket"])
    return (
        inside.join(above, on=[*by, "bucket"])
        .withColumn("ctp", F.col("above_pos") + F.col("ctp"))
        .withColumn("cfp", F.col("above_neg") + F.col("cfp"))
    )


def full_metrics(counts: DataFrame, by: Sequence[str] = ("config",)) -> DataFrame:
    """Attack metrics and ranking metrics side by side, from one evaluation of the counts."""
    counts = settle(counts)
    return attack_metrics(counts, by).join(ranking_metrics(counts, by), on=list(by))
