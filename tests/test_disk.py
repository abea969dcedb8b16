"""What stored tables and shuffles leave on disk, and stored tables read in pieces."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from plumbrow import session
from plumbrow.operators import classifiers
from plumbrow.operators.classifiers import Classifier
from plumbrow.plans import catalog_models, study
from plumbrow.session import cut, discard, settle, shared_dir


def stored(spark):
    """Names of the tables in the shared folder."""
    top = shared_dir(spark).removeprefix("file://")
    return {f for f in os.listdir(top) if f.startswith("table-") and os.path.exists(os.path.join(top, f, "_SUCCESS"))}


def columns_since(spark, before):
    return [set(spark.read.parquet(os.path.join(shared_dir(spark), f)).columns) for f in stored(spark) - before]


def rows_of(spark, n=300):
    x = F.array(F.col("k") % 7 / 7, F.col("k") % 11 / 11, F.col("k") % 5 / 5)
    split = F.when(F.col("k") % 5 == 0, "test").otherwise("train")
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("label"), split.alias("split")).withColumn("f", x)


def test_a_released_write_leaves_no_shuffle_files(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().size()
    rows = spark.range(1000).withColumn("h", F.md5(F.col("id").cast("string")))
    before, kept = files(), spark.conf.get(session.RELEASE)
    table = settle(rows.repartition(4, "h"), release=True)
    assert files() <= before and spark.conf.get(session.RELEASE) == kept
    assert table.count() == 1000 and table.agg(F.sum("id")).first()[0] == 499500
    with pytest.raises(Exception, match="no row"):
        settle(rows.withColumn("e", F.raise_error(F.lit("no row"))), release=True)
    assert spark.conf.get(session.RELEASE) == kept


def test_an_encoding_lets_go_of_its_rows_and_shuffles(spark, monkeypatch):
    before, calls = stored(spark), []
    real = study.release_shuffles
    monkeypatch.setattr(study, "release_shuffles", lambda s: calls.append(stored(s) - before) or real(s))
    study.fit_encoding(rows_of(spark), "f", ["k"], study.Latent(width=2, epochs=1))
    assert calls == [set()]  # once, when the stored rows have gone


def test_a_stored_table_is_read_in_pieces_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(session, "ROW_GROUP_BYTES", 4096)
    rows = settle(spark.range(0, 50_000, 1, 2).withColumn("h", F.md5(F.col("id").cast("string"))))
    pieces = cut(rows, 20)
    assert pieces.rdd.getNumPartitions() >= 20 > rows.rdd.getNumPartitions() and cut(rows, 2) is rows
    sizes = pieces.rdd.glom().map(len).collect()
    assert sum(sizes) == 50_000 and sum(n > 0 for n in sizes) >= 10
    assert "Exchange" not in pieces._jdf.queryExecution().executedPlan().toString()
    assert pieces.schema == rows.schema and sorted(map(tuple, pieces.collect())) == sorted(map(tuple, rows.collect()))
    assert rows.rdd.getNumPartitions() < 20  # other reads keep their limit
    discard(rows)
    assert not os.path.exists(os.path.dirname(rows.inputFiles()[0].removeprefix("file://")))


def test_only_tables_of_settle_are_discarded(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "mine"))
    with pytest.raises(ValueError):
        discard(spark.read.parquet(str(tmp_path / "mine")))
    assert spark.read.parquet(str(tmp_path / "mine")).count() == 3


def test_the_evaluator_removes_its_tables_and_deals_no_rows_again(spark, monkeypatch):
    before, levels = stored(spark), []
    real = DataFrame.persist
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a: levels.append(a) or real(self, *a))
    monkeypatch.setattr(classifiers, "TASK_BYTES", 25 * (4 * 4 + 8 * 3 + 330))
    evaluate = study.audit_evaluator("f", ["k"], study.Latent(width=2, activation="tanh", epochs=1), Classifier("forest", {"trees": 3, "depth": 3}, "balanced"))
    out = evaluate(rows_of(spark)).first()
    assert 0 <= out["accuracy"] <= 1 and 0 <= out["auc_roc"] <= 1
    left = columns_since(spark, before)
    assert left and not any(columns & {"e", "_digest"} for columns in left)  # both stayed before
    assert levels == [()]  # the network's rows; the forest's were dealt and stored on disk before


def test_the_audited_rows_are_stored_once(spark, sf, monkeypatch):
    before = stored(spark)
    monkeypatch.setattr(study, "audit_evaluator", lambda *a, **b: lambda df: df.agg(F.count("*").cast("double").alias("n")))
    report = catalog_models.evaluated_audit(spark, sf)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert {r["value"] for r in report.filter("section = 'metrics' and item <> 'delta'").collect()} == {float(lines)}
    wide = [columns for columns in columns_since(spark, before) if "l_orderkey" in columns]
    assert len(wide) == 1 and {"_by_row", "_by_group"} <= wide[0]
