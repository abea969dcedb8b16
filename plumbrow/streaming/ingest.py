"""Chunked ingest: files arrive in bounded chunks, every chunk is labelled, sampled and stored."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from plumbrow.functions.columns import digest
from plumbrow.session import scratch_path
from plumbrow.sources.files import NUMBER_TEXT


def stream_files(
    spark: SparkSession, root: str, schema: T.StructType, kind: str = "csv", pattern: str = "*.csv", files_per_chunk: int = 64,
) -> DataFrame:
    """New files below ``root``, a bounded number at a time, with their ``path``."""
    reader = spark.readStream.schema(schema).options(
        recursiveFileLookup="true", pathGlobFilter=pattern, maxFilesPerTrigger=str(files_per_chunk)
    )
    if kind == "csv":
        reader = reader.options(**NUMBER_TEXT)
    return reader.format(kind).load(root).withColumn("path", F.col("_metadata.file_path"))


def kept_share(place: Column, share: float) -> Column:
    """Whether a hexadecimal digest lies in the first ``share`` of all digests."""
    if share >= 1:
        return F.lit(True)
    return F.substring(place, 1, 8) < F.lit(f"{math.ceil(share * 2**32):08x}")


def ingest_chunks(
    stream: DataFrame, keep: Column, label: Column, out: str, fractions: dict[Any, float],
    key: Sequence[str] = (), seed: int = 42, progress: str | None = None,
) -> None:
    """Store a labelled sample of every chunk under ``out/chunk=<number>``.

    Every row is decided by the digest of its key, so the cut of the files into chunks cannot
    matter. Rows without a ``key`` are told by their file, their values, and their number among
    equal rows of the file. Labels that ``fractions`` does not name are kept whole. A chunk that runs
    again after a failure overwrites its own folder, so no row is stored twice.
    """
    progress = progress or scratch_path(stream.sparkSession, "progress")

    def store(chunk: DataFrame, number: int) -> None:
        names, rows = list(key), chunk
        if not names:
            values = digest([F.col(c) for c in chunk.columns], seed)
            equal = Window.partitionBy("path", "_values").orderBy("_values")
            rows = chunk.withColumn("_values", values).withColumn("_number", F.row_number().over(equal))
            names = ["path", "_values", "_number"]
        place, test = digest([F.col(n) for n in names], f"{seed}:chunk"), F.lit(True)
        for value, share in fractions.items():
            test = F.when(F.col("label").eqNullSafe(F.lit(value)), kept_share(place, share)).otherwise(test)
        stored = [c for c in chunk.columns if c != "path"]
        rows.filter(test).select(*stored).write.mode("overwrite").parquet(f"{out}/chunk={number}")

    labelled = stream.filter(keep).withColumn("label", label)
    query = (
        labelled.writeStream.foreachBatch(store)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_chunks(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out)
