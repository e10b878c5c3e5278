"""Tables of a relational database."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def read_db(
    spark: SparkSession,
    url: str,
    table: str,
    partition_col: str | None = None,
    partitions: int = 16,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A database table; with a numeric ``partition_col`` it is read by many tasks.

    The bounds come from the table itself, so the ranges hold all rows evenly.
    """
    options = {"fetchsize": "10000", **(properties or {})}
    if partition_col is None:
        return spark.read.jdbc(url, table, properties=options)
    edges = f"(select min({partition_col}) lo, max({partition_col}) hi from {table}) edges"
    lower, upper = spark.read.jdbc(url, edges, properties=options).first()
    if lower is None:
        return spark.read.jdbc(url, table, properties=options)
    return spark.read.jdbc(
        url,
        table,
        column=partition_col,
        lowerBound=int(lower),
        upperBound=int(upper) + 1,
        numPartitions=partitions,
        properties=options,
    )
