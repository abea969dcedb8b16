"""Importances and model profiles."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbrow.functions.columns import digest
from plumbrow.functions.permutation import permuted
from plumbrow.operators.autoencoder import EncoderModel
from plumbrow.operators.classifiers import FittedClassifier
from plumbrow.operators.sampling import PREFIX, sample_uniform
from plumbrow.parallel import all_results
from plumbrow.session import scratch_path, settle


def impurity_importance(fitted: FittedClassifier, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """One row per feature; the values sum to 1."""
    values = fitted.model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values)), "feature string, importance double")


def hash_rank(df: DataFrame, by: Sequence[str], order: str, out: str) -> DataFrame:
    """1-based rank of a hexadecimal digest inside ``by``, without sorting a group in one task.

    Counts of digest prefixes give every prefix its offset; windows rank inside a prefix.
    """
    rows = df.withColumn("b", F.substring(order, 1, PREFIX))
    before = Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*by, "b").agg(F.count("*").alias("c")).withColumn("o", F.coalesce(F.sum("c").over(before), F.lit(0)))
    inside = Window.partitionBy(*by, "b").orderBy(order)
    return (
        rows.join(offsets.drop("c"), on=[*by, "b"])
        .withColumn(out, F.col("o") + F.row_number().over(inside))
        .drop("b", "o")
    )


def _moved(n: int, pos: int, repeats: int, seed: int):
    """Row number, shuffle and value of the row that gets it, for every shuffle of one feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("i").to_numpy()
            for s in range(repeats):
                to = permuted(number, n, f"{seed}:{pos}:{s}")
                yield pa.record_batch([pa.array(to), pa.array(np.full(len(to), s, np.int32)), batch.column("value")], ["i", "s", "value"])

    return run


def permutation_importance(
    fitted: FittedClassifier, df: DataFrame, features: Sequence[str], key: Sequence[str], label: str = "label",
    rows: int | None = None, repeats: int = 5, seed: int = 42, parallelism: int = 4,
) -> DataFrame:
    """Mean accuracy drop when one feature is shuffled, over ``repeats`` shuffles, on all rows or a sample of ``rows``.

    Rows are numbered once. A shuffle is a one-to-one map of these numbers, so only the values of one feature travel, to
    rows that are already placed by number. One feature at a time makes ``repeats`` scored copies of the rows.
    """
    column = fitted.column
    chosen = df.select(*key, label, column)
    sample = chosen if rows is None else sample_uniform(chosen, key, rows, seed=f"{seed}:permute")
    place = sample.withColumn("h", digest([F.col(k) for k in key], f"{seed}:place")).withColumn("g", F.lit(0))
    numbered = settle(hash_rank(place, ["g"], "h", "i").select((F.col("i") - 1).alias("i"), F.col(label).alias("label"), F.col(column).alias(column)))
    n = numbered.count()
    hit = F.avg((F.col("pred") == F.col("label")).cast("double"))
    truth = fitted.score(numbered).agg(hit).first()[0]
    placed = numbered.repartition("i").persist()

    def one(pos: int) -> list[tuple[str, float]]:
        values = numbered.select("i", F.element_at(column, pos + 1).cast("double").alias("value"))
        donors = values.mapInArrow(_moved(n, pos, repeats, seed), "i long, s int, value double")
        replaced = F.transform(F.col(column), lambda x, p: F.when(p == pos, F.col("value")).otherwise(x))
        mixed = donors.join(placed, "i").withColumn(column, replaced).select("s", "label", column)
        return [(features[pos], r["a"]) for r in fitted.score(mixed).groupBy("s").agg(hit.alias("a")).collect()]  # as many as repeats

    try:
        found = [r for part in all_results([lambda p=p: one(p) for p in range(len(features))], parallelism) for r in part]
    finally:
        placed.unpersist()
    per = df.sparkSession.createDataFrame(found, "feature string, a double")
    return per.groupBy("feature").agg((F.lit(truth) - F.avg("a")).alias("importance"), F.stddev_pop("a").alias("std"))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def _score_ms(scored: DataFrame, rows: int) -> float:
    begun = time.time()
    scored.write.format("noop").mode("overwrite").save()
    return (time.time() - begun) * 1000 / max(rows, 1)


PROFILE = (
    "model string, n_features int, train_seconds double, score_ms_per_row double, parameters long, "
    "encoder_parameters long, trees int, nodes long, stored_mb double, accuracy double"
)


def profile_forest(
    name: str, fitted: FittedClassifier, test: DataFrame, train_seconds: float, label: str = "label",
) -> DataFrame:
    """Size, speed and accuracy of a fitted forest."""
    spark = test.sparkSession
    rows = test.count()
    scored = fitted.score(test)
    path = scratch_path(spark, "model")
    fitted.model.save(path)
    accuracy = scored.agg(F.avg((F.col("pred") == F.col(label)).cast("double"))).first()[0]
    row = (
        name, fitted.model.numFeatures, train_seconds, _score_ms(scored, rows), None, None,
        fitted.model.getNumTrees, fitted.model.totalNumNodes, stored_bytes(spark, path) / 1e6, accuracy,
    )
    return spark.createDataFrame([row], PROFILE)


def profile_encoder(name: str, encoder: EncoderModel, rows: DataFrame, train_seconds: float) -> DataFrame:
    """Size and speed of a fitted encoder."""
    spark = rows.sparkSession
    path = scratch_path(spark, "model")
    encoder.write().overwrite().save(path)
    widths = encoder.getOrDefault("widths")
    row = (
        name, widths[0], train_seconds, _score_ms(encoder.transform(rows), rows.count()),
        encoder.getOrDefault("parameters"), len(encoder.getOrDefault("weights")), None, None,
        stored_bytes(spark, path) / 1e6, None,
    )
    return spark.createDataFrame([row], PROFILE)
