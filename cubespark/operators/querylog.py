"""Analytics over logs of queries and of their states."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubespark.operators.ordering import number_within, previous_within
from cubespark.plans.periods import time_range

_TEXT = T.StringType()
# The fields of a row of statistics.
STATS_SCHEMA = T.StructType(
    [T.StructField(n, _TEXT) for n in ("handle", "userQuery", "submitter", "clusterUser", "sessionId")]
    + [T.StructField(n, T.LongType()) for n in ("submissionTime", "startTime", "endTime")]
    + [T.StructField(n, _TEXT) for n in ("result", "cause")]
    + [T.StructField(n, T.MapType(_TEXT, _TEXT)) for n in ("status", "driverStats")]
)

# States a query may pass to from each state.
TRANSITIONS = {
    "NEW": ("QUEUED",),
    "QUEUED": ("LAUNCHED", "FAILED", "CANCELED"),
    "LAUNCHED": ("LAUNCHED", "RUNNING", "CANCELED", "FAILED", "EXECUTED"),
    "RUNNING": ("RUNNING", "CANCELED", "FAILED", "EXECUTED"),
    "EXECUTED": ("SUCCESSFUL", "FAILED", "CANCELED"),
    "FAILED": ("CLOSED",),
    "CANCELED": ("CLOSED",),
    "SUCCESSFUL": ("CLOSED",),
}

# Priorities, most urgent first.
PRIORITIES = ("VERY_HIGH", "HIGH", "NORMAL", "LOW", "VERY_LOW")

TASKS_TYPE = "array<struct<taskId:string,type:string,externalHandle:string,taskState:string>>"


def stats_table(spark: SparkSession, path: str) -> DataFrame:
    """The statistics table below a path, partitioned by ``dt``."""
    schema = T.StructType(STATS_SCHEMA.fields + [T.StructField("dt", T.StringType())])
    return spark.read.schema(schema).json(path)


def status_counters(df: DataFrame, status: str = "status", by: list[str] = ()) -> DataFrame:
    """Counts of accepted, successful, failed, cancelled and finished queries.

    Works on a stream as well.
    """
    s = F.col(status)
    final = s.isin("SUCCESSFUL", "FAILED", "CANCELED")
    return df.groupBy(*by).agg(
        F.count_if(s == "QUEUED").alias("accepted"),
        F.count_if(s == "SUCCESSFUL").alias("successful"),
        F.count_if(s == "FAILED").alias("failed"),
        F.count_if(s == "CANCELED").alias("cancelled"),
        F.count_if(final).alias("finished"),
    )


def illegal_transitions(
    df: DataFrame,
    handle: str = "handle",
    status: str = "status",
    order: list[str] = ("ts",),
    bucket: Column | None = None,
) -> DataFrame:
    """Changes of state that the table of transitions does not allow.

    ``bucket`` cuts the history of one handle into spans (days by default), so
    that no task has to hold all of it.
    """
    bucket = F.date_trunc("day", order[0]) if bucket is None else bucket
    changes = previous_within(df, handle, bucket, list(order), status, "from_status")
    allowed = [f"{a}>{b}" for a, bs in TRANSITIONS.items() for b in bs]
    change = F.concat_ws(">", "from_status", status)
    return changes.filter(F.col("from_status").isNotNull() & ~change.isin(allowed))


def search(
    df: DataFrame,
    state: str | None = None,
    user: str | None = None,
    name: str | None = None,
    frm: str | datetime | None = None,
    to: str | datetime | None = None,
    submitted: str = "submitted",
) -> DataFrame:
    """Queries that satisfy every filter given; a user's mail domain does not count."""
    if (frm is None) != (to is None):
        raise ValueError("a time span needs both ends")
    if state is not None:
        df = df.filter(F.upper("status") == state.upper())
    if user is not None:
        df = df.filter(F.split_part("user", F.lit("@"), F.lit(1)) == user.split("@")[0])
    if name is not None:
        df = df.filter(F.contains(F.lower("name"), F.lit(name.lower())))
    if frm is not None:
        df = df.filter(time_range(submitted, frm, to))
    return df


def priority_rank(priority: Column | str) -> Column:
    col = F.col(priority) if isinstance(priority, str) else priority
    return F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.upper(col))


def queue_order(
    df: DataFrame,
    priority: str = "priority",
    submitted: str = "submitted",
    tie: str = "handle",
    bucket: Column | None = None,
) -> DataFrame:
    """Place of each waiting query within its priority: earlier submissions first."""
    # minutes: a day of one priority may be a fifth of all rows
    bucket = F.date_trunc("minute", submitted) if bucket is None else bucket
    ranked = df.withColumn("priority_rank", priority_rank(priority))
    return number_within(
        ranked, ["priority_rank"], bucket, [F.col(submitted), F.col(tie)], "place"
    )


def timings(df: DataFrame) -> DataFrame:
    """Total time and driver time of each query in milliseconds."""
    return df.withColumn("total_ms", F.col("end_ms") - F.col("submitted_ms")).withColumn(
        "driver_ms", F.col("driver_end_ms") - F.col("driver_start_ms")
    )


def retain(
    df: DataFrame, n: int = 100, end: str = "ended", key: str = "handle"
) -> tuple[DataFrame, DataFrame]:
    """The ``n`` latest finished queries, and the older ones to move out."""
    kept = df.orderBy(F.col(end).desc(), F.col(key).desc()).limit(n)
    return kept, df.join(kept.select(key), key, "left_anti")


def task_progress(df: DataFrame, tasks: str = "tasks") -> DataFrame:
    """Share of finished tasks, and the failed ones as structs, from a JSON array of states.

    Rows without tasks have progress 0 and no failed task.
    """
    parsed = F.coalesce(F.from_json(F.col(tasks), TASKS_TYPE), F.array().cast(TASKS_TYPE))
    in_state = lambda name: F.filter("_tasks", lambda t: F.upper(t["taskState"]) == name)
    share = F.try_divide(F.size(in_state("FINISHED_STATE")), F.size("_tasks"))
    return (
        df.withColumn("_tasks", parsed)
        .withColumn("progress", F.coalesce(share, F.lit(0.0)))
        .withColumn("failed_tasks", in_state("FAILED_STATE"))
        .drop("_tasks")
    )
