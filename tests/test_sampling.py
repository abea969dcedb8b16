import math

import pytest
from pyspark.sql import functions as F

from plumbrow.operators import sampling
from plumbrow.operators.sampling import HashOrder, fit_blocks, fold_sizes, largest_remainder
from plumbrow.plans.explain import hash_rank
from plumbrow.sources.manifest import split_sizes


def numbers(spark, n, positive=0.3):
    return spark.range(n).select(
        F.col("id").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(100)) < positive * 100).cast("int").alias("label")
    )


def test_published_split_sizes():
    assert split_sizes({0: 69_016, 1: 72_028}) == {"n_train": 112_835, "n_test": 28_209}
    assert split_sizes({0: 344_050, 1: 155_417}) == {"n_train": 399_573, "n_test": 99_894}


def test_largest_remainder_total():
    quota = largest_remainder({0: 7, 1: 5, 2: 3}, 4)
    assert sum(quota.values()) == 4 and all(0 <= q <= 3 for q in quota.values())


def test_fold_sizes_deal_classes_in_turn():
    sizes = fold_sizes({0: 7, 1: 6}, 5)
    assert [a + b for a, b in zip(sizes[0], sizes[1])] == [3, 3, 3, 2, 2]


def test_cut_equals_full_sort(spark):
    df = numbers(spark, 3000)
    order = HashOrder(("k",))
    model = fit_blocks(df, order, lambda n: {c: [m // 7, m // 2, m] for c, m in n.items()}, "label")
    got = model.transform(df, "b").withColumn("h", order.digest(df)).collect()
    for c, n in model.counts.items():
        ranked = sorted((r for r in got if r["label"] == c), key=lambda r: r["h"])
        expect = [0] * (n // 7) + [1] * (n // 2 - n // 7) + [2] * (n - n // 2)
        assert [r["b"] for r in ranked] == expect


def test_refined_buckets_give_the_same_cut(spark):
    df = numbers(spark, 20_000)
    ranks = lambda n: {c: [m // 3] for c, m in n.items()}
    coarse = fit_blocks(df, HashOrder(("k",)), ranks, "label")
    fine = fit_blocks(df, HashOrder(("k",)), ranks, "label", bucket_rows=1)
    assert coarse.cuts == fine.cuts


def test_split_and_folds_cover_every_row_once(spark):
    df = numbers(spark, 1003)
    rows = sampling.stratified_folds(sampling.stratified_split(df, "label", ["k"]), "label", ["k"]).collect()
    assert len(rows) == 1003 and {r["split"] for r in rows} == {"train", "test"}
    assert sum(r["split"] == "test" for r in rows) == math.ceil(0.2 * 1003)
    for c in (0, 1):
        sizes = [sum(r["fold"] == f and r["label"] == c for r in rows) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_order_of_rows_does_not_matter(spark):
    df = numbers(spark, 500)
    a = sampling.stratified_split(df, "label", ["k"]).collect()
    b = sampling.stratified_split(df.orderBy(F.desc("k")).repartition(7), "label", ["k"]).collect()
    assert sorted(a) == sorted(b)


def test_tiny_class_is_kept_whole_or_refused(spark):
    df = spark.createDataFrame([(i, int(i < 2)) for i in range(20)], "k long, label int")
    assert sampling.sample_per_class(df, "label", ["k"], {0: 5, 1: 10}).count() == 7
    with pytest.raises(ValueError):
        sampling.sample_per_class(df, "label", ["k"], {0: 5, 1: 10}, strict=True)
    folds = sampling.stratified_folds(df, "label", ["k"]).filter("label = 1").collect()
    assert len({r["fold"] for r in folds}) == 2


def test_uniform_sample_larger_than_table(spark):
    assert sampling.sample_uniform(numbers(spark, 10), ["k"], 50).count() == 10
    assert sampling.sample_uniform(numbers(spark, 0), ["k"], 50).count() == 0


def test_group_split_never_divides_a_vector(spark):
    df = spark.range(2000).select("id", (F.col("id") % 37).cast("double").alias("a"), F.lit(1).alias("b"))
    rows = sampling.group_split(df, ["a", "b"])
    per = rows.groupBy("a").agg(F.countDistinct("split").alias("n"), F.first("split").alias("s")).collect()
    assert all(r["n"] == 1 for r in per) and sum(r["s"] == "test" for r in per) == math.ceil(0.2 * 37)


def test_group_split_treats_both_zeros_alike(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,), (2.0,)], "a double")
    sides = {r["split"] for r in sampling.group_split(df, ["a"], test=0.4).filter("a = 0").collect()}
    assert len(sides) == 1


def test_single_vector_goes_to_one_side(spark):
    df = spark.range(50).select(F.lit(1.0).alias("a"))
    assert sampling.group_split(df, ["a"]).select("split").distinct().count() == 1


def test_hash_rank_is_a_rank(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    got = hash_rank(df, ["g"], "h", "i").collect()
    for g in (0, 1):
        part = sorted((r for r in got if r["g"] == g), key=lambda r: r["h"])
        assert [r["i"] for r in part] == list(range(1, 2501))
