"""Numbering rows in a global order without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubespark.session import new_dir


def row_index(df: DataFrame, name: str = "row") -> DataFrame:
    """Rows of a sorted frame with their position, from 0.

    The rows are written once with the number of their task, so that positions
    do not change if a task runs again. Only one count per task is accumulated.
    """
    return counted_index(df, name)[0]


def counted_index(df: DataFrame, name: str = "row") -> tuple[DataFrame, int]:
    """``row_index`` with the number of rows, which comes from the footers of what was written."""
    spark = df.sparkSession
    path = new_dir(spark, "row-index")
    df.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    total = spark.read.parquet(path).count()
    staged = spark.read.parquet(path).withColumn("_task", F.shiftright("_at", 33))
    counts = staged.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row per task of the write: bounded by the number of its partitions
    placed = (
        staged.join(F.broadcast(offsets), "_task")
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_at", "_task", "_before")
    )
    return placed, total


def number_within(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str
) -> DataFrame:
    """``row_number`` per key, from 1, where a key may hold most of the rows.

    ``bucket`` must not decrease in the order. Rows are numbered inside
    (key, bucket) and shifted by the counts of the key's earlier buckets, so a
    task holds one bucket of a key and not the whole key.
    """
    # one struct as key: null keys match, and the join keeps the window's partitioning
    df = df.withColumn("_at", F.struct(*keys, bucket.alias("_bucket")))
    counts = df.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"))
    before = (
        Window.partitionBy(*[F.col("_at")[k] for k in keys])
        .orderBy("_at._bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_at").orderBy(*order)
    numbered = df.withColumn("_rn", F.row_number().over(inside))
    return (
        numbered.join(offsets, "_at")
        .withColumn(name, F.col("_rn") + F.col("_before"))
        .drop("_at", "_rn", "_before")
    )


def previous_within(
    df: DataFrame,
    key: str,
    bucket: Column,
    order: list[str],
    value: str,
    name: str,
) -> DataFrame:
    """``lag`` of a value per key, where a key may hold most of the rows.

    Looks back inside (key, bucket); the first row of a bucket takes the last
    value of the key's previous bucket, of which there is one row per bucket.
    """
    df = df.withColumn("_at", F.struct(F.col(key).alias("_key"), bucket.alias("_bucket")))
    last = df.groupBy("_at").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    earlier = Window.partitionBy("_at._key").orderBy("_at._bucket")
    carried = last.select("_at", F.lag("_last").over(earlier).alias("_carry"))
    inside = Window.partitionBy("_at").orderBy(*order)
    found = df.withColumn("_prev", F.lag(F.struct(value)).over(inside))
    return (
        found.join(carried, "_at")
        .withColumn(name, F.coalesce("_prev", "_carry")[value])
        .drop("_at", "_prev", "_carry")
    )
