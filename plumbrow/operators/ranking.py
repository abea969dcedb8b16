"""Leaderboards and best trials. Inputs hold one row per configuration or trial."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def top_k(df: DataFrame, value: str, k: int = 10) -> DataFrame:
    """The k largest values; Spark keeps k rows per partition, it does not sort the table."""
    return df.orderBy(F.desc(value)).limit(k)


def leaderboard(df: DataFrame, metric: str = "attack_f1") -> DataFrame:
    place = F.rank().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(metric)))
    return df.withColumn("place", place).orderBy("place")


def best_trial(df: DataFrame, metric: str, trial: str) -> DataFrame:
    """Largest metric; the earliest trial wins a tie."""
    return df.filter(F.col(metric).isNotNull()).orderBy(F.desc(metric), F.asc(trial)).limit(1)


def trial_listing(trials: DataFrame) -> DataFrame:
    """Trials by number with the width the classifier sees and the elapsed seconds."""
    seconds = (F.unix_micros("datetime_complete") - F.unix_micros("datetime_start")) / F.lit(1e6)
    return (
        trials.withColumn("encoded_dim", 2 * F.col("params_ldim"))
        .withColumn("seconds", seconds)
        .orderBy("number")
    )
