"""How the angular encoding behaves at and beyond the training bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from plumbrow.functions.columns import clip, ratio, round_even


def _count(values: Column, test) -> Column:
    return F.size(F.filter(values, test)).cast("long")


def boundary_report(df: DataFrame, scaled: str) -> DataFrame:
    """One report row over an unclipped, scaled array column.

    Everything is counted inside the row first, so the aggregate moves one record per task.
    """
    z = F.col(scaled)
    bounded = F.transform(z, lambda x: clip(x, -1.0, 1.0))
    error = lambda x: F.abs(
        F.atan2(F.sin(x * F.lit(math.pi)), F.cos(x * F.lit(math.pi))) / F.lit(math.pi) - x
    )
    inner = F.filter(F.col("c"), lambda x: F.abs(x) < 1)
    rows = df.select(z.alias("z"), bounded.alias("c")).select(
        F.size("z").cast("long").alias("n"),
        _count(F.col("z"), lambda x: x < -1).alias("below"),
        _count(F.col("z"), lambda x: x > 1).alias("above"),
        F.exists("z", lambda x: F.abs(x) > 1).cast("long").alias("out"),
        F.array_max(F.transform("z", lambda x: F.abs(x))).alias("largest"),
        _count(F.col("c"), lambda x: x == -1).alias("at_low"),
        _count(F.col("c"), lambda x: x == 1).alias("at_high"),
        F.aggregate("c", F.lit(0.0), lambda s, x: s + error(x)).alias("err_sum"),
        F.array_max(F.transform("c", error)).alias("err_max"),
        F.array_max(F.transform(inner, error)).alias("err_inner"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = total("below") + total("above")
    # The field names of the published report.
    return rows.agg(
        total("n").alias("test_values_total"),
        total("below").alias("values_below_minus1_before_clipping"),
        total("above").alias("values_above_plus1_before_clipping"),
        round_even(ratio(out * 100, total("n")), 4).alias("out_of_range_rate_pct"),
        total("out").alias("test_rows_with_at_least_one_out_of_range_value"),
        round_even(ratio(total("out") * 100, F.count("*")), 3).alias("test_rows_with_out_of_range_pct"),
        out.alias("values_that_would_alias_without_clipping"),
        round_even(F.max("largest"), 4).alias("max_absolute_normalized_value_before_clipping"),
        total("at_low").alias("values_clipped_to_minus1"),
        total("at_high").alias("values_clipped_to_plus1"),
        F.least(total("at_low"), total("at_high")).alias("endpoint_collision_pairs"),
        ratio(F.sum("err_sum"), total("n")).alias("inversion_error_mean_all"),
        F.max("err_max").alias("inversion_error_max_all"),
        F.max("err_inner").alias("inversion_error_max_interior_only"),
    )
