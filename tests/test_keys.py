"""Keys with separators, missing parts and repeats; labels and features that are not 0, 1 or finite."""

import math

import pytest
from pyspark.sql import functions as F

from plumbrow.functions import columns as C
from plumbrow.operators import audit, clean, sampling
from plumbrow.plans.leakage import leakage_audit


def test_digests_do_not_run_together(spark):
    df = spark.createDataFrame([("a:b", "c"), ("a", "b:c"), (None, "c"), ("null", "c"), ("-", "c"), ("", "c")], "x string, y string")
    assert df.select(C.digest([F.col("x"), F.col("y")], 1)).distinct().count() == 6


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_samples_are_exact_for_odd_keys(spark, n):
    df = spark.createDataFrame([("a:b", "c"), ("a", "b:c"), (None, "c"), ("null", "c"), ("", None)], "x string, y string")
    assert sampling.sample_uniform(df, ["x", "y"], n).count() == n


def test_a_cut_between_equal_keys_is_refused(spark):
    df = spark.createDataFrame([("k",)] * 4, "x string")
    with pytest.raises(ValueError, match="identify"):
        sampling.sample_uniform(df, ["x"], 2).count()


def test_splits_keep_rows_with_missing_keys(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None), (None, None)], "x int, y string")
    split = df.withColumn("split", F.lit("train"))
    assert sampling.attach_split(df, split, ["x", "y"]).count() == 4
    with pytest.raises(Exception, match="no split is stored"):
        sampling.attach_split(df, split.filter("x = 1"), ["x", "y"]).collect()


@pytest.mark.parametrize("key", [["x"], ["x", "y"]])
def test_a_single_row_is_no_duplicate(spark, key):
    df = spark.createDataFrame([(None, "a", 1.0), (2, "b", 2.0), (3, "c", 2.0)], "x int, y string, v double")
    got = {r.y: r.is_duplicate for r in audit.flag_duplicates(df, ["v"], key).collect()}
    assert got == {"a": 0, "b": 0, "c": 1}


def test_ceiling_counts_the_positive_label(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 2), (1.0, 2)], "v double, label int")
    assert audit.label_ceiling(df, ["v"], "label").first()["deterministic_upper_bound"] == 1.0
    with pytest.raises(Exception, match="missing values"):
        audit.label_ceiling(df.withColumn("label", F.lit(None).cast("int")), ["v"], "label").collect()


def test_rounding_does_not_move_the_split(spark):
    df = spark.range(1000).select((F.col("id") / 1000).alias("t"), (F.col("id") % 2).cast("int").alias("label"))
    report = leakage_audit(df, "label", ["t"], ["t"], rounding=1)
    rows = {(r.section, r.metric): r.value for r in report.collect()}
    assert rows["random_split_overlap", "n_test"] == 200
    assert any(s == "rounded" for s, _ in rows)


def test_entities_that_are_no_numbers_are_unknown(spark):
    df = spark.createDataFrame([(float("nan"), "train"), (float("nan"), "test"), (1.0, "test")], "e double, split string")
    assert audit.entity_overlap(df, "e").first()["shared_entities"] == 0


@pytest.mark.parametrize("cells", [1, 2, 1_000_000])
def test_medians_do_not_depend_on_size_limits(spark, cells):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, 1.0, -inf), (inf, 2.0, -inf), (inf, 3.0, inf), (inf, 10.0, inf)], "a double, b double, c double")
    got = clean.medians(df, ["a", "b", "c"], cells=cells)
    assert got["a"] == inf and got["b"] == 2.5 and math.isnan(got["c"])
