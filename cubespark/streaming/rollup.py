"""Rollups kept fresh from a stream of rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cubespark.model import Cube, CubeError
from cubespark.operators.rollup import merging_measures, rollup, rollup_schema, source_period, state_of, write_partitions
from cubespark.plans.partitions import MANIFEST_SCHEMA, manifest_rows
from cubespark.plans.periods import UpdatePeriod, instant, period_start

# Windows of fixed length; weeks begin on a Monday, four days after 1970-01-01.
WINDOWS = {
    UpdatePeriod.SECONDLY: ("1 second", None),
    UpdatePeriod.MINUTELY: ("1 minute", None),
    UpdatePeriod.HOURLY: ("1 hour", None),
    UpdatePeriod.DAILY: ("1 day", None),
    UpdatePeriod.WEEKLY: ("7 days", "4 days"),
}


def windowed(
    rows: DataFrame,
    cube: Cube,
    period: UpdatePeriod,
    dims: list[str],
    time: str,
    late: str,
    exprs: Mapping[str, str] | None = None,
) -> DataFrame:
    """States of the measures per window and combination of ``dims``, in append mode.

    A window is given once, when the latest time seen is ``late`` past its end; rows that come
    later than that are left out. What is kept between batches are the open windows' states.
    """
    if period not in WINDOWS:
        raise CubeError(f"windows have a fixed length, {period.name} has none: roll it up from a finer period")
    length, offset = WINDOWS[period]
    # a watermark needs an instant: the wall-clock time as if it were UTC, where clocks never change
    at = F.expr(f"timestamp_micros(timestampdiff(microsecond, timestamp_ntz'1970-01-01', cast(`{time}` as timestamp_ntz)))")
    window = F.window("_at", length, startTime=offset) if offset else F.window("_at", length)
    aggs = [state_of(m, (exprs or {}).get(m.name, m.name), False) for m in merging_measures(cube)]
    counted = rows.withColumn("_at", at).withWatermark("_at", late).groupBy(window.alias("_window"), *dims).agg(*aggs)
    start = F.expr("timestampadd(microsecond, unix_micros(_window.start), timestamp_ntz'1970-01-01')")
    return counted.withColumn("update_period", F.lit(period.name)).withColumn("dt", period.label(start)).drop("_window")


def stream_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Partitions that a stream has closed so far."""
    return spark.read.schema(MANIFEST_SCHEMA).option("recursiveFileLookup", True).parquet(f"{path}_manifest")


def stream_rollup(
    rows: DataFrame,
    cube: Cube,
    periods: list[UpdatePeriod],
    dims: list[str],
    time: str,
    late: str,
    path: str,
    checkpoint: str,
    exprs: Mapping[str, str] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a stream that writes closed partitions below ``path`` and lists them in its manifest.

    The finest period comes from windows of the stream. A coarser one is rolled up from its finer
    partitions in the batch that closes a window at or after its end, so only whole periods are
    there to choose. Windows close in order of time; a partition is written by one batch, whole,
    and so is a batch's list, so a batch that runs again after a failure replaces what it wrote.
    """
    spark, table = rows.sparkSession, path.rstrip("/").rpartition("/")[2]
    ordered = sorted(periods, key=lambda p: p.rank)
    finest, schema = ordered[0], rollup_schema(cube, dims)
    sources = {p: source_period(p, ordered[:i]) for i, p in enumerate(ordered) if i}
    if None in sources.values():
        raise CubeError("longer periods do not consist of weeks: add a shorter one")

    def note(parts: DataFrame, number: int, period: UpdatePeriod) -> None:
        named = parts.select(F.lit(table).alias("table"), F.lit("stream").alias("storage"), F.lit(period.name).alias("period"), "dt")
        folder = F.concat(F.lit(f"{path}/update_period={period.name}/dt="), "dt")
        rows = manifest_rows(named.withColumn("location", folder).withColumn("format", F.lit("parquet")))
        # a short row per partition that the batch closes
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}_manifest/batch={number}/period={period.name}")

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            closed = batch.select("dt").distinct()
            reached = closed.agg(F.max(finest.shift(period_start(F.lit(finest.name), F.col("dt"))))).first()[0]
            if reached is None:
                return
            write_partitions(batch, path)
            note(closed, number, finest)
        finally:
            batch.unpersist()
        for period, source in sources.items():
            known = stream_manifest(spark, path)
            done = known.filter(F.col("period") == period.name).select(F.col("dt").alias("coarse"))
            begin = period.truncate(F.col("start"))
            below = known.filter(F.col("period") == source.name).filter(period.shift(begin) <= instant(reached))
            fresh = below.select("dt", "location", period.label(begin).alias("coarse")).distinct().join(done, "coarse", "left_anti")
            parts = fresh.collect()  # what this batch completes
            if parts:
                fine = spark.read.schema(schema).option("basePath", path).parquet(*[r["location"] for r in parts])
                at = period_start(F.lit(source.name), F.col("dt"))
                write_partitions(rollup(fine, cube, period, dims, at, merged=True), path)
                note(spark.createDataFrame([(dt,) for dt in sorted({r["coarse"] for r in parts})], "dt string"), number, period)

    counted = windowed(rows, cube, finest, dims, time, late, exprs)
    writer = counted.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
