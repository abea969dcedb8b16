"""Labelled views of the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LI_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
LI_TIES = ("l_quantity",)
LI_FEATURES = ("l_quantity", "l_discount", "l_tax")
LI4_FEATURES = (*LI_FEATURES, "l_linenumber")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines are the positive class."""
    keep = dict.fromkeys([*LI_KEY, *LI4_FEATURES, "l_extendedprice"])
    return table(spark, sf_dir, "lineitem").select(*keep, (F.col("l_returnflag") == "R").cast("int").alias("label"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events are the positive class; the user is the entity."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "value", (F.col("event_type") == "error").cast("int").alias("label")
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings stand in for a latent; the upper five labels are the positive class."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("z"), (F.col("label") >= 5).cast("int").alias("label")
    )


def documents(spark: SparkSession, sf_dir: str, label: str = "quality") -> DataFrame:
    """Labelled documents: the whole text is the vector, the source is the entity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label"))
    return docs.join(marks, on="doc_id")
