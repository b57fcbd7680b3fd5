"""Several independent Spark jobs at once from one driver."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

PARALLELISM = 4


def run_together(spark: SparkSession, tasks: list[Callable], parallelism: int = PARALLELISM) -> list:
    """Results of the tasks, in order; their jobs share the executors as a cross-validator's do."""
    if len(tasks) < 2 or parallelism < 2:
        return [task() for task in tasks]
    with ThreadPoolExecutor(min(parallelism, len(tasks))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]]
