"""Registered queries and the plain SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from cubespark.session import settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register a query under a key, with its SQL if there is one."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # folders are listed here, with some tasks per core and not with one task per folder
            tasks = 4 * spark.sparkContext.defaultParallelism
            with settings(spark, spark_sql_sources_parallelPartitionDiscovery_parallelism=tasks):
                return fn(spark, sf_dir.rstrip("/"))

        if key in QUERIES:
            raise KeyError(f"registered twice: {key}")
        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = oracle
        return run

    return add
