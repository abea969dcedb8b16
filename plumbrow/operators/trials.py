"""A trial table that outlives its driver.

Every trial is written once, when it ends, to a folder of its own under the table's path. A
write is committed by one rename, so a trial is in the table or it is not; folders of attempts that were
killed hold no row. A search that starts again reads the table first and runs what is missing.
"""

from __future__ import annotations

import math
import os
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbrow.parallel import all_results

CORES_PER_TRIAL = 4
OUTCOME = "value double, state string, error string, datetime_start timestamp, datetime_complete timestamp"


class TrialTable:
    """Trials by number with their parameters (columns ``params_…``) and outcome.

    ``types`` gives the SQL type of every parameter. A number that was written by two drivers at the same time counts with
    the attempt that ended first.
    """

    def __init__(self, spark: SparkSession, path: str, types: Mapping[str, str]):
        self.spark, self.path, self.types = spark, path, dict(types)
        parameters = "".join(f"params_{n} {t}, " for n, t in types.items())
        self.schema = f"number int, {parameters}{OUTCOME}"
        spark.createDataFrame([], self.schema).write.mode("ignore").parquet(os.path.join(path, "empty"))

    def rows(self) -> DataFrame:
        """One row a stored trial."""
        stored = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
        first = Window.partitionBy("number").orderBy("datetime_complete", "datetime_start", "value")
        return stored.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")

    def attempts(self) -> DataFrame:
        """Number and stored rows of every trial."""
        stored = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
        return stored.groupBy("number").agg(F.count("*").alias("attempts"))

    def write(self, number: int, params: Mapping[str, Any], value: float | None, state: str, error: str | None, start: float) -> None:
        at = lambda t: datetime.fromtimestamp(t, timezone.utc)
        row = (number, *(params[n] for n in self.types), value, state, error, at(start), at(time.time()))
        folder = os.path.join(self.path, f"{number:06d}-{uuid.uuid4().hex}")
        self.spark.createDataFrame([row], self.schema).coalesce(1).write.parquet(folder)

    def missing(self, drawn: Sequence[Mapping[str, Any]], retry_failed: bool = False) -> list[int]:
        """Numbers of ``drawn`` that are not stored yet. Stored parameters must be those of the draw."""
        done = set()
        for r in self.rows().collect():  # as many rows as trials
            number = r["number"]
            if number < len(drawn):
                kept, asked = ({n: r[f"params_{n}"] for n in self.types}, {n: drawn[number][n] for n in self.types})
                if any(not _same(kept[n], asked[n]) for n in self.types):
                    raise ValueError(f"trial {number} of {self.path} was drawn as {kept}, not as {asked}")
            if r["state"] == "COMPLETE" or not retry_failed:
                done.add(number)
        return [n for n in range(len(drawn)) if n not in done]

    def run(
        self, drawn: Sequence[Mapping[str, Any]], objective: Callable[[int, Mapping[str, Any]], float],
        parallelism: int | None = None, retry_failed: bool = False,
    ) -> DataFrame:
        """Run the missing trials, each as soon as cores are free, and return the table.

        An objective that raises gives a failed trial with its message; the others go on. Whatever ends the
        driver leaves the trials that were finished.
        """
        if parallelism is None:
            parallelism = max(1, self.spark.sparkContext.defaultParallelism // CORES_PER_TRIAL)

        def one(number: int) -> None:
            start, params = time.time(), drawn[number]
            try:
                value, state, error = float(objective(number, params)), "COMPLETE", None
            except Exception as e:
                value, state, error = None, "FAIL", f"{type(e).__name__}: {e}"
            self.write(number, params, value, state, error, start)

        all_results([lambda n=n: one(n) for n in self.missing(drawn, retry_failed)], parallelism)
        return self.rows().filter(F.col("number") < len(drawn))


def _same(a: Any, b: Any) -> bool:
    return math.isclose(a, b, rel_tol=1e-12) if isinstance(a, float) else a == b
