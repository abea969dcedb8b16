"""A corpus pipeline: from raw documents to a mixed, sharded training set.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the docs of the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbrow.llm import decontaminate, jaccard, mixing, sharding, toxicity
from plumbrow.llm.queries import MIX_WEIGHTS, NEW_SHARDS, OLD_SHARDS, TOXIC_AT, id_remainder, text_shard
from plumbrow.session import scratch_path
from plumbrow.sources.views import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the limit; the classifier learns from labelled documents."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, train=id_remainder("doc_id", 4) != 2)
    return toxicity.without_toxic(docs, model, TOXIC_AT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similar shingles, the one with the smallest id."""
    return jaccard.one_of_each_group(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    return mixing.mixed_documents(docs, lambda n: MIX_WEIGHTS[n % len(MIX_WEIGHTS)])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix, read from the written shards."""
    placed = sharding.reshard_files(docs, text_shard(F.col("text"), OLD_SHARDS), NEW_SHARDS, scratch_path(spark, "shards"))
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark_leaks),
    ("mixing", mix), ("sharding", shard),
]

#: SQL cannot state the fitted classifier or the drawn mix; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
