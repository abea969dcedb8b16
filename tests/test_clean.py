import statistics

import pytest
from pyspark.sql import functions as F

from plumbrow.operators import clean

INF, NAN = float("inf"), float("nan")


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, a double")


def test_inf_and_nan_become_null(spark):
    got = [r["a"] for r in clean.inf_to_null(column(spark, [NAN, INF, -INF, None, -0.0, 1.5]), ["a"]).orderBy("k").collect()]
    assert got == [None, None, None, None, -0.0, 1.5]


def test_even_median_interpolates(spark):
    assert clean.medians(column(spark, [1.0, 2.0, 3.0, 10.0]), ["a"])["a"] == 2.5


def test_two_median_rules(spark):
    df = column(spark, [1.0, 2.0, INF, INF, None])
    fill = lambda legacy: clean.impute_median(df, ["a"], legacy_inf=legacy).filter("k = 4").first()["a"]
    assert fill(False) == 1.5 and fill(True) == INF


def test_training_medians_only(spark):
    df = column(spark, [1.0, 3.0, 100.0, None])
    filled = clean.impute_median(df, ["a"], fit_on=df.filter("k < 2"))
    assert filled.filter("k = 3").first()["a"] == 2.0


@pytest.mark.parametrize("n", [4001, 4000])
def test_bracketed_medians_are_exact(spark, n):
    df = spark.range(n).select(
        F.rand(1).alias("smooth"), F.floor(F.rand(2) * 3).cast("double").alias("few"),
        F.exp(F.randn(3) * 5).alias("heavy"), F.lit(7.0).alias("constant"),
        F.when(F.col("id") % 3 == 0, F.rand(4)).alias("gaps"), F.lit(None).cast("double").alias("nothing"),
        F.when(F.col("id") * 2 < n, F.lit(0.0)).otherwise(F.lit(1.0)).alias("edge"),
    ).persist()
    names = df.columns
    got = clean.medians(df, names, cells=70, sketch=20)
    for c in names:
        values = [r[c] for r in df.select(c).collect() if r[c] is not None]
        assert got[c] == (statistics.median(values) if values else None), c
    df.unpersist()


def test_class_weights_and_map(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    weights = clean.fit_balance(df, "label")
    assert weights[0] == pytest.approx(4 / 6) and weights[1] == pytest.approx(2.0)
    assert clean.positive_weight(df, "label") == 3.0
    assert clean.positive_weight(df.filter("label = 0"), "label") == 3.0


def test_missing_label_is_refused(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "label double")
    with pytest.raises(Exception, match="missing label"):
        clean.cast_label(df, "label").collect()


def test_required_columns(spark):
    with pytest.raises(ValueError):
        clean.require_columns(column(spark, [1.0]), ["a", "b"])


def test_profile_roles(spark):
    df = spark.createDataFrame([(1, "x", True, 2.0)], "label int, s string, b boolean, v double")
    roles = {r["column"]: r["role"] for r in clean.column_profile(df, "label").collect()}
    assert roles == {"label": "label", "s": "excluded", "b": "excluded", "v": "retained"}


def test_drop_leaky_ignores_absent_columns(spark):
    df = spark.createDataFrame([(1, 2.0)], ["src_ip", "v"])
    assert clean.drop_leaky(df).columns == ["v"]
