"""Fold summaries and paired comparison of two configurations over shared folds."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def fold_summary(metrics: DataFrame, by: Sequence[str] = ("config", "metric"), value: str = "value") -> DataFrame:
    """Folds, mean and population deviation."""
    return metrics.groupBy(*by).agg(
        F.count(value).alias("folds"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )


def long_metrics(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metric columns to ``(keys…, metric, value)`` rows."""
    return wide.unpivot(list(keys), list(metrics), "metric", "value")


def paired_statistics(
    metrics: DataFrame, a: str, b: str, config: str = "config", fold: str = "fold", value: str = "value",
    by: Sequence[str] = ("metric",),
) -> DataFrame:
    """Paired t and signed-rank statistics of ``b - a`` over folds.

    Tied absolute differences share their mean rank; zero differences leave the ranking.
    ``t`` is NULL when all differences are equal.
    """
    pick = lambda name: F.max(F.when(F.col(config) == name, F.col(value)))
    pairs = (
        metrics.filter(F.col(config).isin(a, b)).groupBy(*by, fold)
        .agg(pick(a).alias("a"), pick(b).alias("b"))
        .withColumn("d", F.col("b") - F.col("a"))
        .filter("d is not null")
    )
    size = F.when(F.col("d") != 0, F.abs("d"))
    ranked = Window.partitionBy(*by, F.col("d") != 0).orderBy(F.abs("d"))
    ties = Window.partitionBy(*by, F.abs("d"))
    pairs = pairs.withColumn(
        "rank", F.when(size.isNotNull(), F.rank().over(ranked) + (F.count("*").over(ties) - 1) / F.lit(2.0))
    )
    n, spread = F.count("d"), F.stddev_samp("d")
    none = F.lit(0.0)
    return pairs.groupBy(*by).agg(
        n.alias("folds"),
        F.avg("d").alias("mean_difference"),
        F.when(spread > 0, F.avg("d") / (spread / F.sqrt(n.cast("double")))).alias("t"),
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("rank"))), none).alias("w_plus"),
        F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("rank"))), none).alias("w_minus"),
        F.sort_array(F.collect_list("rank")).alias("ranks"),
    )


def paired_tests(metrics: DataFrame, a: str, b: str, method: str = "exact", **columns) -> DataFrame:
    """Paired statistics with two-sided p-values; a p-value is NaN where undefined.

    ``method`` is that of the signed rank test, ``exact`` or ``normal``.

    The ranks of one record are as many as there are folds.
    """
    stats = paired_statistics(metrics, a, b, **columns)

    @F.pandas_udf("double")
    def t_p(t: pd.Series, folds: pd.Series) -> pd.Series:
        return pd.Series([two_sided_t(x, int(n) - 1) for x, n in zip(t, folds)], dtype="float64")

    @F.pandas_udf("double")
    def w_p(w: pd.Series, ranks: pd.Series) -> pd.Series:
        return pd.Series([two_sided_signed_rank(x, list(r), method) for x, r in zip(w, ranks)], dtype="float64")

    undefined = F.lit(math.nan)  # Arrow returns NaN as NULL
    return (
        stats.withColumn("t_p", F.coalesce(t_p("t", "folds"), undefined))
        .withColumn("wilcoxon_p", F.coalesce(w_p(F.least("w_plus", "w_minus"), "ranks"), undefined))
        .drop("ranks")
    )


def confidence_intervals(metrics: DataFrame, by: Sequence[str] = ("config", "metric"), level: float = 0.95) -> DataFrame:
    """Mean with a Student interval; the standard error uses the sample deviation."""
    stats = metrics.groupBy(*by).agg(
        F.count("value").alias("folds"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        (F.stddev_samp("value") / F.sqrt(F.count("value").cast("double"))).alias("sem"),
    )

    @F.pandas_udf("double")
    def half(folds: pd.Series, sem: pd.Series) -> pd.Series:
        return pd.Series([t_quantile(level, int(n) - 1) * s for n, s in zip(folds, sem)], dtype="float64")

    return (
        stats.withColumn("half", half("folds", "sem"))
        .withColumn("ci_low", F.col("mean") - F.col("half"))
        .withColumn("ci_high", F.col("mean") + F.col("half"))
        .drop("half", "sem")
    )


# ---------------------------------------------------------------- distributions


def t_inside(t: float, df: int) -> float:
    """P(|T| <= t) for an integer number of degrees of freedom (finite trigonometric sums)."""
    angle = math.atan(abs(t) / math.sqrt(df))
    cos2 = math.cos(angle) ** 2
    term = total = 1.0 if df % 2 == 0 else math.cos(angle)
    first = 1 if df % 2 == 0 else 2
    for i in range(first, df - 2, 2):
        term *= cos2 * i / (i + 1)
        total += term
    if df % 2 == 0:
        return math.sin(angle) * total
    if df == 1:
        total = 0.0
    return 2 / math.pi * (angle + math.sin(angle) * total)


def two_sided_t(t: float | None, df: int) -> float:
    if t is None or math.isnan(t) or df < 1:
        return math.nan
    return 1.0 - t_inside(t, df)


def t_quantile(level: float, df: int) -> float:
    """t with P(|T| <= t) = level, by bisection."""
    if df < 1:
        return math.nan
    low, high = 0.0, 1.0
    while t_inside(high, df) < level:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_inside(mid, df) < level else (low, mid)
    return (low + high) / 2


def two_sided_signed_rank(statistic: float, ranks: list[float], method: str = "exact") -> float:
    """``exact`` counts sign patterns over doubled ranks, ``normal`` uses the normal curve."""
    if method not in ("exact", "normal"):
        raise ValueError(f"unknown method {method}")
    if not ranks:
        return math.nan
    if method == "exact":
        ways = {0: 1}
        for r in ranks:
            step = round(2 * r)
            grown = dict(ways)
            for total, n in ways.items():
                grown[total + step] = grown.get(total + step, 0) + n
            ways = grown
        tail = sum(n for total, n in ways.items() if total <= round(2 * statistic))
        return min(1.0, 2 * tail / 2 ** len(ranks))
    mean = sum(ranks) / 2
    sd = math.sqrt(sum(r * r for r in ranks) / 4)
    return min(1.0, math.erfc(abs(statistic - mean) / sd / math.sqrt(2)))
