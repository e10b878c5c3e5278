"""Query-log analytics and functions, over logs that Spark derives from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.functions.scalar import format_number
from cubespark.operators import querylog as QL
from cubespark.registry.base import query
from cubespark.registry.warehouse import table
from cubespark.session import new_dir
from cubespark.streaming.stats import ingest_stats

# An event stands for a change of state of the query of its user.
STATES = {
    "view": "QUEUED",
    "click": "LAUNCHED",
    "signup": "RUNNING",
    "purchase": "SUCCESSFUL",
    "error": "FAILED",
}
URGENCY = {
    "error": "VERY_HIGH",
    "purchase": "HIGH",
    "signup": "NORMAL",
    "click": "LOW",
    "view": "VERY_LOW",
}


def _case(column: str, values: dict[str, str]) -> str:
    return "case " + column + "".join(f" when '{k}' then '{v}'" for k, v in values.items()) + " end"


STATE_SQL, URGENCY_SQL = _case("event_type", STATES), _case("event_type", URGENCY)


def states(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("handle"),
        F.expr(STATE_SQL).alias("status"),
        F.expr(URGENCY_SQL).alias("priority"),
        "ts",
        "event_id",
        "value",
        "props",
    )


def millis(ts: str) -> str:
    return f"unix_millis(cast({ts} as timestamp))"


def stats_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One finished query per event, in the form of the statistics record."""
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("handle"),
        F.concat(F.lit("select "), "props").alias("userQuery"),
        F.concat(F.lit("user"), "user_id", F.lit("@example.org")).alias("submitter"),
        F.lit("cluster").alias("clusterUser"),
        F.lit("s1").alias("sessionId"),
        F.expr(millis("ts")).alias("submissionTime"),
        F.expr(f"{millis('ts')} + 10").alias("startTime"),
        F.expr(f"{millis('ts')} + 10 + cast(value as bigint)").alias("endTime"),
        F.lit(None).cast("string").alias("result"),
        F.when(F.col("event_type") == "error", F.lit("failure")).alias("cause"),
        F.create_map(F.lit("status"), F.expr(STATE_SQL)).alias("status"),
        F.create_map(F.lit("progress"), F.col("value").cast("string")).alias("driverStats"),
        F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("-00")).alias("day"),
    )


STATS_SQL = f"""
select event_id::varchar as handle, strftime(ts, '%Y-%m-%d') || '-00' as dt,
       'user' || user_id || '@example.org' as submitter,
       10 + trunc(value)::bigint as total_ms, {STATE_SQL} as state, value::varchar as progress,
       case when event_type = 'error' then 'failure' end as cause
from events
"""


def stats_answer(df: DataFrame) -> DataFrame:
    return df.select(
        "handle",
        "dt",
        "submitter",
        (F.col("endTime") - F.col("submissionTime")).alias("total_ms"),
        F.col("status")["status"].alias("state"),
        F.col("driverStats")["progress"].alias("progress"),
        "cause",
    )


@query("stats_table", STATS_SQL)
def _(spark, sf):
    path = new_dir(spark, "stats")
    stats_rows(spark, sf).withColumnRenamed("day", "dt").write.partitionBy("dt").json(path)
    return stats_answer(QL.stats_table(spark, path))


@query("stats_stream", STATS_SQL)
def _(spark, sf):
    """Rolled logs of each day taken in by a stream; a second run finds nothing new."""
    logs, out, checkpoint = (new_dir(spark, n) for n in ("logs", "ingested", "checkpoint"))
    rows = stats_rows(spark, sf).withColumn("log", F.concat(F.lit("queries.log."), "day")).drop("day")
    rows.write.partitionBy("log").json(logs)
    for _ in range(2):
        ingest_stats(spark, logs, out, checkpoint)
    return stats_answer(QL.stats_table(spark, out))


@query(
    "status_counters",
    f"""with s as (select {STATE_SQL} as status from events)
        select count(*) filter (status = 'QUEUED') as accepted,
               count(*) filter (status = 'SUCCESSFUL') as successful,
               count(*) filter (status = 'FAILED') as failed,
               count(*) filter (status = 'CANCELED') as cancelled,
               count(*) filter (status in ('SUCCESSFUL', 'FAILED', 'CANCELED')) as finished from s""",
)
def _(spark, sf):
    return QL.status_counters(states(spark, sf))


_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, bs in QL.TRANSITIONS.items() for b in bs)


@query(
    "status_transitions",
    f"""with s as (select user_id::varchar as handle, {STATE_SQL} as status, ts, event_id from events),
             c as (select *, lag(status) over (partition by handle order by ts, event_id) as from_status from s)
        select handle, event_id, ts, from_status, status from c
        where from_status is not null and (from_status, status) not in (values {_ALLOWED})""",
)
def _(spark, sf):
    log = states(spark, sf).select("handle", "status", "ts", "event_id")
    return QL.illegal_transitions(log, order=["ts", "event_id"])


@query(
    "query_search",
    f"""select event_id, ts as submitted from events
        where {STATE_SQL} = 'FAILED' and 'user' || user_id = 'user7' and lower(props) like '%k%'
          and ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-28'""",
)
def _(spark, sf):
    log = table(spark, sf, "events").select(
        "event_id",
        F.col("ts").alias("submitted"),
        F.expr(STATE_SQL).alias("status"),
        F.concat(F.lit("user"), "user_id", F.lit("@example.org")).alias("user"),
        F.col("props").alias("name"),
    )
    found = QL.search(log, "failed", "user7@example.com", "K", "2024-01-03", "2024-01-28")
    return found.select("event_id", "submitted")


@query(
    "queue_order",
    f"""select event_id as handle, {URGENCY_SQL} as priority,
               row_number() over (partition by event_type order by ts, event_id)::bigint as place
        from events""",
)
def _(spark, sf):
    waiting = states(spark, sf).select(
        F.col("event_id").alias("handle"), "priority", F.col("ts").alias("submitted")
    )
    return QL.queue_order(waiting).select("handle", "priority", "place")


@query(
    "query_timings",
    """select event_id::varchar as handle, 10 + trunc(value)::bigint as total_ms,
              trunc(value)::bigint as driver_ms from events""",
)
def _(spark, sf):
    log = stats_rows(spark, sf).select(
        "handle",
        F.col("submissionTime").alias("submitted_ms"),
        F.col("endTime").alias("end_ms"),
        F.col("startTime").alias("driver_start_ms"),
        F.col("endTime").alias("driver_end_ms"),
    )
    return QL.timings(log).select("handle", "total_ms", "driver_ms")


@query(
    "retention",
    """select event_id as handle, ts as ended,
              row_number() over (order by ts desc, event_id desc) <= 100 as kept from events""",
)
def _(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_id").alias("handle"), F.col("ts").alias("ended"))
    kept, moved = QL.retain(log, 100)
    return kept.withColumn("kept", F.lit(True)).unionByName(moved.withColumn("kept", F.lit(False)))


@query(
    "task_progress",
    """with t as (
         select event_id, unnest(range(0, 1 + user_id % 5)) as i, 1 + user_id % 5 as n from events),
       s as (select *, case (event_id + i) % 3 when 0 then 'FINISHED_STATE' when 1 then 'FAILED_STATE'
                       else 'RUNNING_STATE' end as state from t)
       select event_id, round(sum((state = 'FINISHED_STATE')::int) / max(n), 6) as progress,
              count(*) filter (state = 'FAILED_STATE') as n_failed,
              string_agg('task' || i, ',' order by i) filter (state = 'FAILED_STATE') as failed
       from s group by 1""",
)
def _(spark, sf):
    """The states of one to five tasks per event, as the JSON text an engine reports."""
    tasks = F.expr(
        """transform(sequence(0, user_id % 5), i -> named_struct(
             'taskId', concat('task', i), 'type', 'MAP',
             'taskState', case (event_id + i) % 3 when 0 then 'finished_state'
                          when 1 then 'FAILED_STATE' else 'RUNNING_STATE' end))"""
    )
    log = table(spark, sf, "events").select("event_id", F.to_json(tasks).alias("tasks"))
    return QL.task_progress(log).select(
        "event_id",
        F.round("progress", 6).alias("progress"),
        F.size("failed_tasks").cast("long").alias("n_failed"),
        F.nullif(F.array_join("failed_tasks.taskId", ","), F.lit("")).alias("failed"),
    )


# ------------------------------------------------------------------------ functions


@query("fn_to_date", "select o_orderkey, o_orderdate::date as day from orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query(
    "fn_format_number",
    """select o_orderkey, format('{:,.2f}', o_totalprice) as grouped,
              regexp_replace(regexp_replace(printf('%.3f', o_totalprice), '0+$', ''), '\\.$', '') as patterned
       from orders""",
)
def _(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        format_number("o_totalprice", 2).alias("grouped"),
        format_number("o_totalprice", "##################.###").alias("patterned"),
    )


@query(
    "fn_date_shift",
    """select o_orderkey, (o_orderdate::date + 5)::date as later, (o_orderdate::date - 3)::date as earlier
       from orders""",
)
def _(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.date_add(F.to_date("o_orderdate"), 5).alias("later"),
        F.date_sub(F.to_date("o_orderdate"), 3).alias("earlier"),
    )


@query(
    "fn_arithmetic",
    """select l_orderkey, l_linenumber, l_partkey, round(l_linenumber / 3, 6) as third,
              l_linenumber + l_orderkey as added, round(l_quantity * 2 - l_tax, 6) as mixed
       from lineitem""",
)
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.expr("round(l_linenumber / 3, 6)").alias("third"),
        F.expr("l_linenumber + l_orderkey").alias("added"),
        F.expr("round(l_quantity * 2 - l_tax, 6)").alias("mixed"),
    )


@query(
    "fn_families",
    """select event_id, upper(event_type) as s_upper, substr(event_type, 2, 3) as s_sub,
              length(props) as s_len, year(ts)::int as d_year, dayofmonth(ts)::int as d_day,
              round(sqrt(value), 6) as m_sqrt, floor(value)::bigint as m_floor,
              json_extract_string(props, '$.k') as j_k, 3 as a_size, greatest(user_id, event_id) as c_max,
              coalesce(nullif(event_type, 'view'), 'none') as c_null
       from events""",
)
def _(spark, sf):
    """One or two functions of each family, by expression text."""
    return table(spark, sf, "events").selectExpr(
        "event_id",
        "upper(event_type) as s_upper",
        "substr(event_type, 2, 3) as s_sub",
        "length(props) as s_len",
        "year(ts) as d_year",
        "day(ts) as d_day",
        "round(sqrt(value), 6) as m_sqrt",
        "floor(value) as m_floor",
        "get_json_object(props, '$.k') as j_k",
        "size(array(1, 2, event_id)) as a_size",
        "greatest(user_id, event_id) as c_max",
        "coalesce(nullif(event_type, 'view'), 'none') as c_null",
    )
