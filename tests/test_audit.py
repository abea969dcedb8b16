from pyspark.sql import functions as F

from plumbrow.operators import audit
from plumbrow.operators.skew import join_groups
from plumbrow.plans.leakage import leakage_audit


def value(df, name):
    return df.first()[name]


def skewed(spark, n=3000):
    """One vector owns a third of the rows."""
    return spark.range(n).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(0.0)).otherwise((F.col("id") % 500).cast("double")).alias("a"),
        (F.col("id") % 5 == 0).cast("int").alias("label"),
    )


def test_single_vector_ceiling_is_majority_share(spark):
    df = spark.range(10).select(F.lit(1.0).alias("a"), (F.col("id") < 3).cast("int").alias("label"))
    report = audit.label_ceiling(df, ["a"], "label").first()
    assert report["deterministic_upper_bound"] == 0.7 and report["n_groups"] == 1
    assert report["rows_in_conflicting_groups_pct"] == 100.0


def test_zero_and_nan_vectors_are_equal(spark):
    df = spark.createDataFrame([(0.0, 1), (-0.0, 0), (float("nan"), 1), (float("nan"), 1)], "a double, label int")
    report = audit.label_ceiling(df, ["a"], "label").first()
    assert report["n_groups"] == 2 and report["conflicting_groups"] == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, label int, split string")
    assert audit.label_ceiling(df, ["a"], "label").first()["n_rows"] == 0
    assert audit.overlap(df, ["a"]).first()["test_rows_leaked_pct"] == 0.0


def test_published_arithmetic(spark):
    df = spark.createDataFrame([(48_336, 141_044, 19_961, 28_209)], "g long, n long, leaked long, test long")
    from plumbrow.functions.columns import ratio, round_even

    row = df.select(
        round_even(ratio(F.col("n") - F.col("g"), F.col("n")), 4).alias("dup"),
        round_even(ratio(F.col("leaked") * 100, F.col("test")), 2).alias("pct"),
    ).first()
    assert (row["dup"], row["pct"]) == (0.6573, 70.76)


def test_ceiling_bounds_any_lookup(spark):
    df = skewed(spark)
    best = value(audit.label_ceiling(df, ["a"], "label"), "deterministic_upper_bound")
    constant = df.agg(F.avg((F.col("label") == 0).cast("double"))).first()[0]
    assert best >= constant - 5e-5


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (0.545,), (-1.5,)], "a double")
    zero = [r["a"] for r in audit.round_features(df, ["a"], 0).collect()]
    assert zero == [2.0, 4.0, 1.0, -2.0]


def test_conflict_rows_with_a_hot_vector(spark):
    df = skewed(spark)
    got = {r["id"] for r in audit.conflict_rows(df, ["a"], "label").collect()}
    labels = {}
    rows = df.collect()
    for r in rows:
        labels.setdefault(r["a"], set()).add(r["label"])
    assert got == {r["id"] for r in rows if len(labels[r["a"]]) > 1}


def test_join_groups_matches_plain_join(spark):
    df = skewed(spark)
    groups = df.groupBy("a").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    got = join_groups(df, groups, ["a"], "n", df.count()).select("id", "n", "pos").collect()
    plain = df.join(groups, "a").select("id", "n", "pos").collect()
    assert sorted(got) == sorted(plain) and len(got) == df.count()


def test_flag_duplicates(spark):
    df = spark.createDataFrame([(1, 5, "x"), (2, 5, "x"), (3, 6, "x"), (4, None, "x"), (5, None, "x")], "k int, a int, s string")
    flags = {r["k"]: r["is_duplicate"] for r in audit.flag_duplicates(df, ["a", "s"], ["k"]).collect()}
    assert flags == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1}


def test_dense_ids_follow_sort_order(spark):
    df = skewed(spark)
    rows = audit.with_group_id(df, ["a"], mode="dense").collect()
    order = {a: i for i, a in enumerate(sorted({r["a"] for r in rows}))}
    assert all(r["group_id"] == order[r["a"]] for r in rows) and len(rows) == 3000


def test_entity_rows_without_value_stay_in_the_denominator(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "test"), (None, "train"), (None, "test")], "e string, split string")
    r = audit.entity_overlap(df, "e").first()
    assert (r["distinct_entities_test"], r["shared_entities"], r["test_rows_with_entity_seen_in_train_pct"]) == (2, 1, 33.33)


def test_missing_entity_is_skipped_and_missing_label_refused(spark):
    df = skewed(spark, 60)
    report = leakage_audit(df, "label", ["a"], ["id"], entity="nowhere")
    assert not report.filter("section like 'entity%'").count()
    try:
        leakage_audit(df.drop("label"), "label", ["a"], ["id"])
    except ValueError as error:
        assert "label" in str(error)
    else:
        raise AssertionError("a missing label must be refused")


def test_group_split_of_the_report_has_no_leak(spark):
    report = leakage_audit(skewed(spark, 600), "label", ["a"], ["id"], rounding=0)
    leaks = report.filter("section = 'group_split_overlap' and metric = 'shared_groups'").first()
    assert leaks["value"] == 0.0


def test_salted_groups_match_a_plain_join(spark):
    """At thresholds that salt one, some or all groups; with missing, NaN and signed zero keys."""
    df = skewed(spark, 2000).withColumn("b", F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 7 == 1, float("nan")).otherwise(-0.0 * F.col("a")))
    groups = df.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("label").alias("pos")).filter("a <> 3")
    same = df["a"].eqNullSafe(F.col("ga")) & df["b"].eqNullSafe(F.col("gb"))
    named = groups.withColumnsRenamed({"a": "ga", "b": "gb"})
    plain = sorted(tuple(r) for r in df.join(named, same).select("id", "n", "pos").collect())
    for hot_rows in (1, 3, 50, 400, 100_000):
        got = join_groups(df, groups, ["a", "b"], "n", 2000, hot_rows=hot_rows)
        assert sorted(tuple(r) for r in got.select("id", "n", "pos").collect()) == plain
        semi = join_groups(df, groups, ["a", "b"], "n", 2000, "left_semi", hot_rows=hot_rows)
        assert semi.columns == df.columns and sorted(r["id"] for r in semi.collect()) == [r[0] for r in plain]


def test_no_task_holds_a_hot_group(spark):
    df = skewed(spark, 30_000)
    groups = df.groupBy("a").agg(F.count("*").alias("n"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        parts = lambda hot: sorted(r["c"] for r in join_groups(df, groups, ["a"], "n", 30_000, hot_rows=hot).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("c")).collect())
        whole, salted = parts(100_000), parts(200)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(whole) == sum(salted) == 30_000
    assert whole[-1] >= 10_000 and salted[-1] < 2_000
