"""Dataset manifest: what a prepared table holds and how it is split."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plumbrow.functions.columns import numeric_features
from plumbrow.operators.sampling import largest_remainder

LABEL_NAMES = {0: "benign", 1: "attack"}


def dataset_manifest(
    df: DataFrame, label: str, drop: Sequence[str] = (), test: float = 0.2, folds: int = 5, seed: int = 42,
) -> DataFrame:
    """One row: counts from one aggregate, column lists from the schema, split sizes by rule."""
    retained = numeric_features(df, label, drop)
    excluded = [c for c in df.columns if c != label and c not in retained]
    names = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    n = F.col("rows")
    n_test = F.ceil(n * F.lit(test)).cast("long")
    counts = df.agg(
        F.count("*").alias("rows"),
        *[F.count(F.when(F.col(label) == v, 1)).alias(name) for v, name in LABEL_NAMES.items()],
    )
    return counts.select(
        n,
        F.lit(len(df.columns)).alias("columns_total"),
        F.lit(label).alias("label_column"),
        F.create_map(*[F.lit(x) for v, name in LABEL_NAMES.items() for x in (str(v), name)]).alias("label_mapping"),
        F.struct(*LABEL_NAMES.values()).alias("class_counts"),
        names(retained).alias("retained_features"),
        F.lit(len(retained)).alias("n_retained_features"),
        names(excluded).alias("excluded_columns"),
        F.lit(len(excluded)).alias("n_excluded_columns"),
        F.struct(
            (n - n_test).alias("n_train"), n_test.alias("n_test"), F.lit(True).alias("stratified"),
            F.lit(seed).alias("seed"),
        ).alias("split"),
        F.struct(F.lit(folds).alias("n_splits"), F.lit(True).alias("shuffle"), F.lit(seed).alias("seed")).alias("cv"),
    )


def split_sizes(counts: dict, test: float = 0.2) -> dict[str, int]:
    """Train and test rows of a stratified split."""
    quota = largest_remainder(counts, math.ceil(test * sum(counts.values())))
    n_test = sum(quota.values())
    return {"n_train": sum(counts.values()) - n_test, "n_test": n_test}
