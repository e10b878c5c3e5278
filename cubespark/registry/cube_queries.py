"""Cube queries: time ranges, fact choice, selections, joins, aggregates."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.functions.scalar import register
from cubespark.model import Cube, Fact, FactStorage, Model
from cubespark.operators import rollup as RU
from cubespark.operators import star
from cubespark.operators.joins import unique_join
from cubespark.operators.query import Query, union_all
from cubespark.plans import partitions as P
from cubespark.plans.periods import period_start, time_range
from cubespark.registry.base import query
from cubespark.registry.warehouse import (
    ACTIVITY,
    ACTIVITY_EXPRS,
    DAILY,
    HOURLY,
    MONTHLY,
    SALES,
    table,
    warehouse,
)

# A span that starts and ends inside a day, for queries about the edges of a range.
FROM, TO = "2024-01-01-05", "2024-01-29-07"
EDGES = (FROM, TO)
IN_EDGES = "ts >= timestamp '2024-01-01 05:00:00' and ts < timestamp '2024-01-29 07:00:00'"
# All events, and all of lineitem.
WHOLE = ("2024-01-01", "2024-01-31")
IN_RANGE = "ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-31'"
SOLD = ("1995-01-01", "2001-11-05")
IN_SOLD = "l_shipdate >= timestamp '1995-01-01' and l_shipdate < timestamp '2001-11-05'"

BY_TYPE = f"""
select event_type, round(sum(value), 2) as value, max(value) as max_value,
       min(value) as min_value, count(*) as n
from events where {IN_RANGE} group by event_type
"""
BY_TYPE_EDGES = BY_TYPE.replace(IN_RANGE, IN_EDGES)


def activity(
    spark: SparkSession, sf: str, cube: Cube = ACTIVITY, span: tuple[str, str] = WHOLE
) -> Query:
    return Query.of(warehouse(spark, sf).activity(spark), cube).time_range("ts", *span)


def sales(spark: SparkSession, sf: str, span: tuple[str, str] = SOLD) -> Query:
    return Query.of(warehouse(spark, sf).sales(spark), SALES).time_range("l_shipdate", *span)


def dim(spark: SparkSession, sf: str, name: str) -> Query:
    return Query.of(warehouse(spark, sf).sales(spark), name)


def rounded(df: DataFrame, *columns: str, places: int = 2) -> DataFrame:
    """Doubles compared with another engine: sums differ in the last digits."""
    return df.withColumns({c: F.round(c, places) for c in columns})


def by_type(q: Query, spark: SparkSession) -> DataFrame:
    return rounded(q.select("event_type", "value", "max_value", "min_value", "n").to_df(spark), "value")


# ------------------------------------------------------------- time and table choice


@query(
    "time_range",
    f"select event_type, round(sum(value), 2) as value from events where {IN_EDGES} group by 1",
)
def _(spark, sf):
    events = table(spark, sf, "events").filter(time_range("ts", FROM + ":00:00", TO + ":00:00,000"))
    return events.groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("value"))


@query("partition_cover", BY_TYPE_EDGES)
def _(spark, sf):
    return by_type(activity(spark, sf, span=EDGES), spark)


@query("cover_fallback", BY_TYPE_EDGES)
def _(spark, sf):
    """Two days and a week are missing as such: hours and days step in."""
    model = warehouse(spark, sf).activity(spark)
    manifest = P.drop_by_filter(
        model.manifest(spark),
        "table = 'activity_user' and (period = 'DAILY' and dt in ('2024-01-03', '2024-01-17')"
        " or period = 'WEEKLY' and dt = '2024-01-15')",
    )
    model = replace(model, manifest=lambda s: manifest)
    q = Query.of(model, ACTIVITY).time_range("ts", FROM, TO).conf(valid_facts=("activity_user",))
    return by_type(q, spark)


@query("max_interval", BY_TYPE)
def _(spark, sf):
    """Days, although weeks are there."""
    return by_type(activity(spark, sf).conf(max_interval=DAILY), spark)


@query("valid_periods", BY_TYPE_EDGES)
def _(spark, sf):
    only = {("activity_user", "lake"): ["HOURLY"]}
    return by_type(activity(spark, sf, span=EDGES).conf(valid_update_periods=only), spark)


@query("valid_facts", BY_TYPE)
def _(spark, sf):
    q = activity(spark, sf)
    return by_type(q.conf(valid_facts=("activity_user",), valid_storages=("lake",)), spark)


@query(
    "fact_candidates",
    f"""select user_id, event_type, round(sum(value), 2) as value from events
        where {IN_RANGE} group by 1, 2""",
)
def _(spark, sf):
    """Only the facts with a user column can answer."""
    q = activity(spark, sf).select("user_id", "event_type", "value")
    return rounded(q.to_df(spark), "value")


@query("lightest_fact", BY_TYPE)
def _(spark, sf):
    """Weeks and a day of the lightest fact fill the range."""
    return by_type(activity(spark, sf).conf(fail_if_partial=True), spark)


@query("lightest_first", BY_TYPE)
def _(spark, sf):
    q = activity(spark, sf).conf(lightest_first=True, fail_if_partial=True)
    return by_type(q, spark)


@query(
    "raw_fact_only",
    f"""select event_type, round(avg(value), 6) as avg_value, min(value) as least,
               round(sum(value), 2) as total, count(value) as rows
        from events where {IN_RANGE} group by 1""",
)
def _(spark, sf):
    """Other aggregates than the defaults need rows, not rollups."""
    q = activity(spark, sf).select(
        "event_type",
        "avg(value) as avg_value",
        "min(value) as least",
        "sum(amount) as total",
        "count(value) as rows",
    )
    return rounded(rounded(q.to_df(spark), "avg_value", places=6), "total")


@query(
    "missing_partitions",
    """
    with span as (select date_trunc('hour', max(ts)) as last from events),
    wanted as (select unnest(generate_series(timestamp '2024-01-01 05:00:00',
                                             timestamp '2024-02-02 02:00:00', interval 1 hour)) as start)
    select 'HOURLY' as period, strftime(start, '%Y-%m-%d-%H') as dt, start
    from wanted, span where start > last
    """,
)
def _(spark, sf):
    """Hours past the end of the data, found from the open spans of the cover."""
    q = activity(spark, sf).time_range("ts", FROM, "2024-02-02-03").select("event_type", "value")
    return q.missing_partitions(spark)


@query(
    "lookahead",
    f"""
    with late as (select *, ts + interval 1 hour * (event_id % 4) as pt from events)
    select event_type, round(sum(value), 2) as value, count(*) as n from late
    where {IN_EDGES} and date_trunc('hour', pt) < timestamp '2024-01-29 07:00:00' + interval 2 hour
    group by 1
    """,
)
def _(spark, sf):
    """Rows arrive up to three hours late; partitions two hours ahead are read too."""
    def late(s):
        delay = F.make_interval(hours=(F.col("event_id") % 4).cast("int"))
        pt = HOURLY.truncate(F.col("ts") + delay)
        return table(s, sf, "events").select(
            "*", F.lit(HOURLY.name).alias("update_period"), HOURLY.label(pt).alias("dt")
        )

    def arrived(s):
        first_last = table(s, sf, "events").agg(
            F.min("ts").alias("first"), F.max(F.col("ts") + F.expr("interval 3 hours")).alias("last")
        )
        return P.manifest_of_span(first_last, "activity_late", "lake", HOURLY)

    fact = Fact(
        "activity_late",
        "activity",
        ("event_type", "user_id", "value", "n"),
        (FactStorage("lake", late, (HOURLY,)),),
        aggregated=False,
        time_column="ts",
        exprs=ACTIVITY_EXPRS,
    )
    model = Model((ACTIVITY,), (fact,), (), arrived)
    q = Query.of(model, ACTIVITY).time_range("ts", FROM, TO).select("event_type", "value", "n")
    return rounded(q.conf(process_time_col="pt", lookahead=2).to_df(spark), "value")


@query(
    "time_range_two_dims",
    """select l_returnflag, round(sum(l_quantity), 2) as quantity
       from lineitem join orders on l_orderkey = o_orderkey
       where l_shipdate >= timestamp '1995-01-01' and l_shipdate < timestamp '2001-11-05'
         and o_orderdate >= timestamp '1996-03-01' and o_orderdate < timestamp '2000-02-15' group by 1""",
)
def _(spark, sf):
    """A range of the ship date and one of the order date; the latter filters rows."""
    q = sales(spark, sf).time_range("orders.o_orderdate", "1996-03", "2000-02-15")
    return rounded(q.select("l_returnflag", "quantity").to_df(spark), "quantity")


@query(
    "agg_stddev",
    f"""select event_type, round(stddev_samp(value), 4) as spread, round(var_pop(value), 2) as variance,
               round(corr(value, user_id), 6) as correlation
        from events where {IN_RANGE} group by 1""",
)
def _(spark, sf):
    q = activity(spark, sf).select(
        "event_type", "stddev(amount) as spread", "var_pop(amount) as variance", "corr(amount, user_id) as correlation"
    )
    return rounded(rounded(rounded(q.to_df(spark), "spread", places=4), "variance"), "correlation", places=6)


@query(
    "agg_collect",
    f"""select user_id, count(distinct event_type)::int as kinds, max(value) as best from events where {IN_RANGE} group by 1""",
)
def _(spark, sf):
    q = activity(spark, sf).select(
        "user_id", "size(collect_set(event_type)) as kinds", "max_by(amount, amount) as best"
    )
    return q.to_df(spark)


@query(
    "agg_filter",
    f"""select event_type, count(*) filter (where user_id < 8) as low, round(sum(value) filter (where value > 10), 2) as large
        from events where {IN_RANGE} group by 1 having count(*) filter (where user_id >= 8) > 0""",
)
def _(spark, sf):
    q = activity(spark, sf).select(
        "event_type", "count(1) filter (where user_id < 8) as low", "sum(amount) filter (where amount > 10) as large"
    )
    return rounded(q.having("count(1) filter (where user_id >= 8) > 0").to_df(spark), "large")


@query("timedim_replace", BY_TYPE)
def _(spark, sf):
    """Filtered on the event time itself instead of a partition column."""
    q = activity(spark, sf).conf(replace_timedim=False, valid_facts=("activity_raw",))
    return by_type(q, spark)


@query("range_as_or", BY_TYPE)
def _(spark, sf):
    return by_type(activity(spark, sf).conf(writer="or"), spark)


@query("range_as_between", BY_TYPE)
def _(spark, sf):
    return by_type(activity(spark, sf).conf(writer="between"), spark)


@query(
    "dim_latest",
    """select l_suppkey, l_returnflag, round(sum(l_quantity), 2) as quantity from lineitem
       where date_trunc('month', l_shipdate) =
             (select max(date_trunc('month', l_shipdate)) from lineitem where l_shipdate < timestamp '2000-08-01')
       group by 1, 2""",
)
def _(spark, sf):
    """The monthly table as dumps: the latest one up to a month."""
    house = warehouse(spark, sf)
    fact = house.sales(spark).facts[1].storages[0].read(spark)
    dumps = fact.filter(F.col("update_period") == MONTHLY.name)
    latest = P.dim_snapshot(dumps, as_of="2000-07").select("l_suppkey", "l_returnflag", "quantity")
    return rounded(latest, "quantity")


@query(
    "field_validity",
    f"""select l_returnflag, round(sum(case when l_shipdate >= timestamp '1996-01-01' then l_tax end), 2) as tax,
               round(sum(l_quantity), 2) as quantity
        from lineitem where {IN_SOLD} group by 1""",
)
def _(spark, sf):
    """A measure that starts later than the range: its values before that are null."""
    q = sales(spark, sf).select("l_returnflag", "tax", "quantity").conf(validity="null")
    return rounded(q.to_df(spark), "tax", "quantity")


@query(
    "derived_cube",
    f"""select event_type, round(sum(value), 2) as value, count(*) as n
        from events where {IN_RANGE} group by 1""",
)
def _(spark, sf):
    derived = ACTIVITY.derive("traffic", ["value", "n"], ["event_type"])
    return rounded(
        activity(spark, sf, derived).select("event_type", "value", "n").to_df(spark), "value"
    )


@query(
    "single_table",
    f"""select l_returnflag, round(sum(l_quantity), 2) as quantity
        from lineitem where {IN_SOLD} group by 1""",
)
def _(spark, sf):
    q = sales(spark, sf).select("l_returnflag", "quantity").conf(multi_table=False)
    return rounded(q.to_df(spark), "quantity")


# ----------------------------------------------------------- projections and filters


@query(
    "cube_select",
    f"""select event_type as kind_of_event, round(sum(value), 2) as total, count(*) as n
        from events where {IN_RANGE} group by 1""",
)
def _(spark, sf):
    q = activity(spark, sf).select("event_type as kind_of_event", ("value", "total"), "activity.n")
    return rounded(q.to_df(spark), "total")


@query(
    "select_distinct",
    f"select distinct user_id, event_type from events where {IN_RANGE}",
)
def _(spark, sf):
    return activity(spark, sf).select("user_id", "event_type").distinct().to_df(spark)


@query(
    "expr_column",
    f"""select case when event_type in ('purchase', 'signup') then 'gain' else 'other' end as kind,
               round(sum(value) / count(*), 6) as mean_value
        from events where {IN_RANGE} group by 1""",
)
def _(spark, sf):
    q = activity(spark, sf).select("kind", "mean_value")
    return rounded(q.to_df(spark), "mean_value", places=6)


@query(
    "where_predicates",
    f"""select c_mktsegment, event_type, round(sum(value), 2) as value
        from events join customer on user_id = c_custkey
        where {IN_RANGE} and (event_type != 'error' or user_id between 10 and 90)
          and c_mktsegment != 'MACHINERY' and c_acctbal > 0 group by 1, 2""",
)
def _(spark, sf):
    q = (
        activity(spark, sf)
        .select("customer.c_mktsegment", "event_type", "value")
        .where("event_type != 'error' or user_id between 10 and 90")
        .where("customer.c_mktsegment != 'MACHINERY' and customer.c_acctbal > 0")
    )
    return rounded(q.to_df(spark), "value")


@query(
    "case_when",
    f"""select case when user_id < 50 then 'low' else 'high' end as band,
               case when sum(value) = 0 then 0.0 else round(sum(value), 2) end as value
        from events where {IN_RANGE} group by 1""",
)
def _(spark, sf):
    q = activity(spark, sf).select(
        "case when user_id < 50 then 'low' else 'high' end as band",
        "case when sum(value) = 0 then 0.0 else round(sum(value), 2) end as value",
    )
    return q.to_df(spark)


@query("dim_select", "select c_custkey as id, c_name as name, c_acctbal < 0 as in_debt from customer")
def _(spark, sf):
    q = dim(spark, sf, "customer").select("c_custkey as id", "c_name as name", "in_debt")
    return q.to_df(spark)


@query(
    "cube_subquery",
    f"""select count(*) as busy, round(max(value), 2) as top from (
          select user_id, sum(value) as value, count(*) as n from events where {IN_RANGE} group by 1)
        where n >= 3""",
)
def _(spark, sf):
    inner = activity(spark, sf).select("user_id", "value", "n").to_df(spark)
    inner.createOrReplaceTempView("cube_subquery_inner")
    return spark.sql(
        "select count(*) as busy, round(max(value), 2) as top from cube_subquery_inner where n >= 3"
    )


@query(
    "cube_join_cube",
    f"""with a as (select user_id, sum(value) as value from events where {IN_RANGE} group by 1),
             s as (select o_custkey, sum(l_quantity) as quantity from lineitem
                   join orders on l_orderkey = o_orderkey where {IN_SOLD} group by 1)
        select user_id, round(value, 2) as value, round(quantity, 2) as quantity
        from a join s on user_id = o_custkey""",
)
def _(spark, sf):
    a = activity(spark, sf).select("user_id", "value").to_df(spark)
    s = sales(spark, sf).select("orders.o_custkey", "quantity").to_df(spark)
    joined = a.join(s, a.user_id == s.o_custkey).select("user_id", "value", "quantity")
    return rounded(joined, "value", "quantity")


# --------------------------------------------------------------------------- joins


@query(
    "auto_join",
    f"""select s_name, round(sum(l_quantity), 2) as quantity, count(*) as lines
        from lineitem join supplier on l_suppkey = s_suppkey where {IN_SOLD} group by 1""",
)
def _(spark, sf):
    q = sales(spark, sf).select("supplier.s_name", "quantity", "lines")
    return rounded(q.to_df(spark), "quantity")


@query(
    "chain_join",
    f"""select r_name, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue
        from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
        join region on n_regionkey = r_regionkey where {IN_SOLD} group by 1""",
)
def _(spark, sf):
    q = sales(spark, sf).select("region.r_name", "revenue")
    return rounded(q.to_df(spark), "revenue", places=4)


@query(
    "chain_join_via",
    f"""select n_name, round(sum(l_quantity), 2) as quantity
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
        join nation on c_nationkey = n_nationkey where {IN_SOLD} group by 1""",
)
def _(spark, sf):
    """The nation of the customer instead of the nearer one of the supplier."""
    q = sales(spark, sf).select("nation.n_name", "quantity").conf(via={"nation": "customer"})
    return rounded(q.to_df(spark), "quantity")


@query(
    "join_infer_on",
    f"""select p_brand, round(sum(l_quantity), 2) as quantity
        from lineitem join part on l_partkey = p_partkey where {IN_SOLD} group by 1""",
)
def _(spark, sf):
    q = sales(spark, sf).join("part").select("p_brand", "quantity")
    return rounded(q.to_df(spark), "quantity")


def _outer(how: str) -> str:
    return f"""select c_name, round(sum(value), 2) as value, count(value) as rows
               from (select * from events where {IN_RANGE}) e
               {how} join customer on user_id = c_custkey group by 1"""


def _customer_join(spark, sf, how: str) -> DataFrame:
    q = activity(spark, sf).join("customer", how).select("c_name", "value", "count(amount) as rows")
    return rounded(q.to_df(spark), "value")


@query("join_inner", _outer("inner"))
def _(spark, sf):
    return _customer_join(spark, sf, "inner")


@query("join_left", _outer("left"))
def _(spark, sf):
    return _customer_join(spark, sf, "left outer")


@query("join_right", _outer("right"))
def _(spark, sf):
    return _customer_join(spark, sf, "right outer")


@query("join_full", _outer("full"))
def _(spark, sf):
    return _customer_join(spark, sf, "full outer")


@query(
    "join_semi",
    f"""select event_type, round(sum(value), 2) as value from events
        where {IN_RANGE} and user_id in (select c_custkey from customer where c_acctbal > 5000)
        group by 1""",
)
def _(spark, sf):
    q = (
        activity(spark, sf)
        .join("customer", "semi", on_filter="customer.c_acctbal > 5000")
        .select("event_type", "value")
    )
    return rounded(q.to_df(spark), "value")


@query(
    "join_unique",
    """with o as (select o_custkey as k, count(*) as orders from orders group by 1),
            e as (select user_id as k, count(*) as events from events group by 1),
            c as (select c_custkey as k, c_mktsegment from customer)
       select coalesce(coalesce(o.k, e.k), c.k) as k, orders, events, c_mktsegment
       from o full join e on o.k = e.k full join c on coalesce(o.k, e.k) = c.k""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"))
    events = table(spark, sf, "events").groupBy(F.col("user_id").alias("k"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    return unique_join(
        [
            orders.agg(F.count(F.lit(1)).alias("orders")),
            events.agg(F.count(F.lit(1)).alias("events")),
            customers,
        ],
        "k",
    )


@query(
    "join_multi_key",
    f"""select o_orderstatus, round(sum(l_quantity), 2) as quantity, count(*) as lines from lineitem
        join orders on l_orderkey = o_orderkey and l_shipdate = o_orderdate + interval 30 day
        where {IN_SOLD} group by 1""",
)
def _(spark, sf):
    q = (
        sales(spark, sf)
        .join(
            "orders",
            on=[("l_orderkey", "o_orderkey"), ("l_shipdate - interval 30 days", "o_orderdate")],
        )
        .select("o_orderstatus", "quantity", "lines")
    )
    return rounded(q.to_df(spark), "quantity")


@query(
    "join_on_filter",
    f"""select s_name, round(sum(l_quantity), 2) as quantity from
        (select * from lineitem where {IN_SOLD}) l
        left join supplier on l_suppkey = s_suppkey and s_acctbal > 2000 and l_returnflag != 'N'
        group by 1""",
)
def _(spark, sf):
    q = (
        sales(spark, sf)
        .join("supplier", "left", on_filter="supplier.s_acctbal > 2000 and sales.l_returnflag != 'N'")
        .select("s_name", "quantity")
    )
    return rounded(q.to_df(spark), "quantity")


@query(
    "star_semijoin",
    """select l_returnflag, round(sum(l_quantity), 2) as quantity from lineitem
       where l_suppkey in (select s_suppkey from supplier where s_acctbal > 3000)
         and l_partkey in (select p_partkey from part where p_size between 10 and 30)
       group by 1""",
)
def _(spark, sf):
    reduced = star.reduce_fact(
        table(spark, sf, "lineitem"),
        [
            (table(spark, sf, "supplier"), "l_suppkey", "s_suppkey", "s_acctbal > 3000"),
            (table(spark, sf, "part"), "l_partkey", "p_partkey", "p_size between 10 and 30"),
        ],
    )
    return reduced.groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))


# --------------------------------------------------------------------- aggregation


@query(
    "default_aggregate",
    f"""select round(sum(value), 2) as value, max(value) as max_value, min(value) as min_value,
               count(*) as n from events where {IN_RANGE}""",
)
def _(spark, sf):
    q = activity(spark, sf).select("value", "max_value", "min_value", "n")
    return rounded(q.to_df(spark), "value")


def _one_aggregate(key: str, text: str, sql: str, places: int = 2) -> None:
    @query(key, f"select event_type, {sql} as result from events where {IN_RANGE} group by 1")
    def _(spark, sf):
        q = activity(spark, sf).select("event_type", f"{text} as result")
        df = q.to_df(spark)
        return rounded(df, "result", places=places) if "round" in sql else df


_one_aggregate("agg_sum", "sum(value)", "round(sum(value), 2)")
_one_aggregate("agg_min", "min(min_value)", "min(value)")
_one_aggregate("agg_max", "max(max_value)", "max(value)")
_one_aggregate("agg_avg", "avg(value)", "round(avg(value), 6)", 6)
_one_aggregate("agg_count", "count(user_id)", "count(user_id)")
_one_aggregate("agg_count_distinct", "count(distinct user_id)", "count(distinct user_id)")


@query(
    "group_by",
    f"""select round(sum(value), 2) as value from events where {IN_RANGE} group by event_type, user_id""",
)
def _(spark, sf):
    """Group columns that are not selected."""
    q = activity(spark, sf).select("value").group_by("event_type", "user_id")
    return rounded(q.to_df(spark), "value")


@query(
    "promote_select",
    f"""select user_id, event_type, count(*) as n from events where {IN_RANGE} group by 1, 2""",
)
def _(spark, sf):
    return activity(spark, sf).select("user_id", "event_type", "n").group_by("user_id").to_df(spark)


@query(
    "promote_groupby",
    f"""select count(*) as n, event_type, user_id from events where {IN_RANGE} group by 2, 3""",
)
def _(spark, sf):
    q = activity(spark, sf).select("n").group_by("event_type", "user_id")
    return q.conf(promote_groupby=True).to_df(spark)


@query(
    "having",
    f"""select user_id, round(sum(value), 2) as value from events where {IN_RANGE}
        group by 1 having sum(value) > 500 and count(*) >= 5""",
)
def _(spark, sf):
    q = activity(spark, sf).select("user_id", "value").having("value > 500 and n >= 5")
    return rounded(q.to_df(spark), "value")


@query(
    "eager_agg",
    """select n_name, l_returnflag, round(sum(l_quantity), 2) as total, round(avg(l_quantity), 6) as mean,
              count(l_quantity) as rows, max(l_extendedprice) as top
       from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
       group by 1, 2""",
)
def _(spark, sf):
    """The joins see one row per supplier and flag instead of every line."""
    suppliers = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    df = star.eager_agg(
        table(spark, sf, "lineitem"),
        [(suppliers.select("s_suppkey", "n_name"), [("l_suppkey", "s_suppkey")])],
        ["n_name", "l_returnflag"],
        [
            ("sum", "l_quantity", "total"),
            ("avg", "l_quantity", "mean"),
            ("count", "l_quantity", "rows"),
            ("max", "l_extendedprice", "top"),
        ],
        ["l_returnflag"],
    )
    return rounded(rounded(df, "total"), "mean", places=6)


@query(
    "eager_agg_two_dims",
    """select n_name, p_brand, round(sum(l_quantity), 2) as total, round(avg(l_quantity), 6) as mean,
              count(l_quantity) as rows, max(l_extendedprice) as top
       from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
       join part on l_partkey = p_partkey group by 1, 2""",
)
def _(spark, sf):
    suppliers = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    df = star.eager_agg(
        table(spark, sf, "lineitem"),
        [
            (suppliers.select("s_suppkey", "n_name"), [("l_suppkey", "s_suppkey")]),
            (table(spark, sf, "part").select("p_partkey", "p_brand"), [("l_partkey", "p_partkey")]),
        ],
        ["n_name", "p_brand"],
        [
            ("sum", "l_quantity", "total"),
            ("avg", "l_quantity", "mean"),
            ("count", "l_quantity", "rows"),
            ("max", "l_extendedprice", "top"),
        ],
    )
    return rounded(rounded(df, "total"), "mean", places=6)


@query(
    "rollup_hourly",
    """select 'HOURLY' as update_period, strftime(date_trunc('hour', ts), '%Y-%m-%d-%H') as dt, event_type,
              round(sum(value), 2) as value, max(value) as max_value, min(value) as min_value, count(*) as n
       from events group by 1, 2, 3""",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    hours = RU.rollup(events, ACTIVITY, HOURLY, ["event_type"], "ts", ACTIVITY_EXPRS)
    return rounded(hours.drop("mean", "users"), "value")


@query(
    "rollup_daily",
    """select 'DAILY' as update_period, strftime(date_trunc('day', ts), '%Y-%m-%d') as dt, event_type,
              round(sum(value), 2) as value, max(value) as max_value, min(value) as min_value, count(*) as n
       from events group by 1, 2, 3""",
)
def _(spark, sf):
    """Days from the hours of a finer fact, not from events."""
    fine = warehouse(spark, sf).activity(spark).facts[1].storages[0].read(spark)
    hours = fine.filter(F.col("update_period") == HOURLY.name)
    at = period_start(F.lit(HOURLY.name), F.col("dt"))
    days = RU.rollup(hours, ACTIVITY, DAILY, ["event_type"], at, merged=True)
    return rounded(days.drop("mean", "users"), "value")


@query(
    "rollup_monthly",
    """select update_period, dt, l_suppkey, l_returnflag, round(sum(l_quantity), 2) as quantity,
              count(*) as lines from (
         select *, 'MONTHLY' as update_period, strftime(date_trunc('month', l_shipdate), '%Y-%m') as dt from lineitem
         union all
         select *, 'QUARTERLY', strftime(date_trunc('quarter', l_shipdate), '%Y-%m') from lineitem
         union all
         select *, 'YEARLY', strftime(l_shipdate, '%Y') from lineitem)
       group by 1, 2, 3, 4""",
)
def _(spark, sf):
    """The written months, quarters and years of the supplier fact."""
    fact = warehouse(spark, sf).sales(spark).facts[1].storages[0].read(spark)
    df = fact.select("update_period", "dt", "l_suppkey", "l_returnflag", "quantity", "lines")
    return rounded(df, "quantity")


@query(
    "rollup_consistency",
    f"""select user_id, 2::bigint as rows, round(sum(value), 2) as value_left,
               round(sum(value), 2) as value_right, 0.0::double as value_difference
        from events where {IN_RANGE} group by 1""",
)
def _(spark, sf):
    q = activity(spark, sf).select("user_id", "value")
    rolled = q.conf(valid_facts=("activity_user",)).to_df(spark)
    raw = q.conf(valid_facts=("activity_raw",)).to_df(spark)
    df = RU.consistency(rolled, raw, ["user_id"], ["value"])
    df = rounded(df, "value_left", "value_right")
    return df.withColumn("value_difference", F.abs(F.round("value_difference", 2)))


# --------------------------------------------------------------- order, limit, union


@query(
    "order_by",
    f"""select s_name, l_returnflag, round(sum(l_quantity), 2) as quantity from lineitem
        join supplier on l_suppkey = s_suppkey where {IN_SOLD} group by 1, 2""",
)
def _(spark, sf):
    q = sales(spark, sf).select("supplier.s_name", "l_returnflag", "quantity")
    return rounded(q.order_by("supplier.s_name desc", "l_returnflag").to_df(spark), "quantity")


@query("limit", "select c_custkey as id, c_name as name from customer order by c_name, c_custkey limit 2")
def _(spark, sf):
    q = dim(spark, sf, "customer").select("c_custkey as id", "c_name as name")
    return q.order_by("name", "id").limit(2).to_df(spark)


@query(
    "top_k",
    f"""select user_id, round(sum(value), 2) as value from events where {IN_RANGE} group by 1
        order by sum(value) desc, user_id limit 10""",
)
def _(spark, sf):
    q = activity(spark, sf).select("user_id", "value").order_by("value desc", "user_id").limit(10)
    return rounded(q.to_df(spark), "value")


@query(
    "union_all",
    f"""select label, sum(n)::bigint as n from (
          select event_type as label, count(*) as n from events where {IN_RANGE} group by 1
          union all
          select l_returnflag, count(*) from lineitem where {IN_SOLD} group by 1
          union all
          select r_name, count(*) from region group by 1) group by 1""",
)
def _(spark, sf):
    plain = table(spark, sf, "region").groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))
    union = union_all(
        spark,
        activity(spark, sf).select("event_type as label", "n"),
        sales(spark, sf).select("l_returnflag", "lines"),
        plain,
    )
    return union.groupBy("label").agg(F.sum("n").alias("n"))


@query(
    "udf_scalar",
    f"""select event_type, round(sum(value * 2 + 1), 2) as scaled from events
        where {IN_RANGE} group by 1""",
)
def _(spark, sf):
    register(spark, "twice_plus_one", lambda v: v * 2 + 1, "double")
    q = activity(spark, sf).select("event_type", "sum(twice_plus_one(amount)) as scaled")
    return rounded(q.to_df(spark), "scaled")
