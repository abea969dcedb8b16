"""Several Spark jobs at a time from one driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def run_parallel(tasks: Sequence[Callable[[], Any]], parallelism: int) -> list:
    """Results in order; a failed task yields its exception."""

    def guarded(task: Callable[[], Any]):
        try:
            return task()
        except Exception as error:  # one task must not end the others
            return error

    run = inheritable_thread_target(SparkSession.active())(guarded)
    with ThreadPoolExecutor(max_workers=max(parallelism, 1)) as pool:
        return [f.result() for f in [pool.submit(run, t) for t in tasks]]


def all_results(tasks: Sequence[Callable[[], Any]], parallelism: int) -> list:
    """Results in order; the first failure is raised."""
    results = run_parallel(tasks, parallelism)
    for r in results:
        if isinstance(r, Exception):
            raise r
    return results
