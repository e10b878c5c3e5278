"""Cube queries on further shapes of a model: roles, dumps, two time columns, streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cubespark.model import Attr, Dim, DimStorage, DimTable, Fact, FactStorage, Model, Ref
from cubespark.operators import rollup as RU
from cubespark.operators.query import Query
from cubespark.plans import partitions as P
from cubespark.plans.periods import UpdatePeriod
from cubespark.registry.base import query
from cubespark.registry.cube_queries import IN_EDGES, IN_SOLD, SOLD, activity, rounded, sales
from cubespark.registry.warehouse import (
    ACTIVITY,
    ACTIVITY_EXPRS,
    DAILY,
    HOURLY,
    MONTHLY,
    SALES,
    SALES_EXPRS,
    YEARLY,
    table,
    warehouse,
)
from cubespark.session import new_dir
from cubespark.streaming.rollup import stream_manifest, stream_rollup

_KEPT: dict[tuple[str, str, str], object] = {}


def once(key: str):
    """A model's tables are written on first use by an application and then reused."""

    def wrap(build):
        def kept(spark: SparkSession, sf: str):
            at = (spark.sparkContext.applicationId, sf, key)
            if at not in _KEPT:
                _KEPT[at] = build(spark, sf)
            return _KEPT[at]

        return kept

    return wrap


# ----------------------------------------------------------------- states of measures


@query(
    "rollup_count_avg",
    f"""select event_type, round(avg(value), 6) as mean, count(nullif(user_id, 7)) as users, count(*) as n
        from events where {IN_EDGES} group by 1""",
)
def _(spark, sf):
    """An average and a count from hours, days and weeks: sums and counts of the parts add up."""
    q = activity(spark, sf, span=("2024-01-01-05", "2024-01-29-07")).conf(valid_facts=("activity_user",))
    return rounded(q.select("event_type", "mean", "users", "n").to_df(spark), "mean", places=6)


@query(
    "rollup_count_avg_joined",
    f"""select c_mktsegment, round(avg(value), 6) as mean, count(nullif(user_id, 7)) as users
        from events join customer on user_id = c_custkey where {IN_EDGES} group by 1""",
)
def _(spark, sf):
    """The same states aggregated by user below a join, and again above it."""
    q = activity(spark, sf, span=("2024-01-01-05", "2024-01-29-07")).conf(valid_facts=("activity_user",))
    return rounded(q.select("customer.c_mktsegment", "mean", "users").to_df(spark), "mean", places=6)


@query(
    "rollup_consistency_sales",
    """select l_suppkey, l_returnflag, 2::bigint as rows, round(sum(l_quantity), 2) as quantity_left,
              round(sum(l_quantity), 2) as quantity_right, 0.0::double as quantity_difference,
              count(*) as lines_left, count(*) as lines_right, 0::bigint as lines_difference
       from lineitem where l_shipdate < date_trunc('month', (select max(l_shipdate) from lineitem)) group by 1, 2""",
)
def _(spark, sf):
    """Years, quarters and months of the supplier fact against all lines, up to the last whole month."""
    model = warehouse(spark, sf).sales(spark)
    last = table(spark, sf, "lineitem").agg(F.date_format(F.max("l_shipdate"), "yyyy-MM")).first()[0]
    q = Query.of(model, SALES).time_range("l_shipdate", "1995-01", last).select("l_suppkey", "l_returnflag", "quantity", "lines")
    rolled = q.conf(valid_facts=("sales_supplier",), fail_if_partial=True).to_df(spark)
    raw = q.conf(valid_facts=("sales_raw",)).to_df(spark)
    df = rounded(RU.consistency(rolled, raw, ["l_suppkey", "l_returnflag"], ["quantity", "lines"]), "quantity_left", "quantity_right")
    return df.withColumn("quantity_difference", F.abs(F.round("quantity_difference", 2)))


# ------------------------------------------------------------------------ star queries


@query(
    "star_query_reduced",
    f"""select p_brand, l_returnflag, round(sum(l_quantity), 2) as quantity, count(*) as lines
        from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
        join region on n_regionkey = r_regionkey join part on l_partkey = p_partkey
        where {IN_SOLD} and r_name in ('ASIA', 'EUROPE') and s_acctbal > 0 and p_size between 10 and 30 group by 1, 2""",
)
def _(spark, sf):
    """Keys of the filtered dimensions, and of those behind them, cut the fact before anything else."""
    q = (
        sales(spark, sf)
        .select("part.p_brand", "l_returnflag", "quantity", "lines")
        .where("region.r_name in ('ASIA', 'EUROPE')")
        .where("supplier.s_acctbal > 0 and part.p_size between 10 and 30")
    )
    return rounded(q.conf(via={"region": "supplier"}).to_df(spark), "quantity")


@query(
    "join_two_roles",
    f"""select s.n_name as seller, c.n_name as buyer, round(sum(l_quantity), 2) as quantity
        from lineitem join supplier on l_suppkey = s_suppkey join nation s on s_nationkey = s.n_nationkey
        join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
        join nation c on c_nationkey = c.n_nationkey where {IN_SOLD} group by 1, 2""",
)
def _(spark, sf):
    """One dimension twice, by the names that the references give it."""
    q = sales(spark, sf).select("supplier_nation.n_name as seller", "customer_nation.n_name as buyer", "quantity")
    return rounded(q.to_df(spark), "quantity")


@query(
    "join_roles_behind_roles",
    f"""select r1.r_name as from_region, count(*) as lines
        from lineitem join supplier on l_suppkey = s_suppkey join nation s on s_nationkey = s.n_nationkey
        join region r1 on s.n_regionkey = r1.r_regionkey
        join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
        join nation c on c_nationkey = c.n_nationkey join region r2 on c.n_regionkey = r2.r_regionkey
        where {IN_SOLD} and r1.r_name <> r2.r_name group by 1""",
)
def _(spark, sf):
    """Regions behind both nations, declared by the query."""
    q = (
        sales(spark, sf)
        .role("seller_region", "region", via="supplier_nation")
        .role("buyer_region", "region", via="customer_nation")
        .select("seller_region.r_name as from_region", "lines")
        .where("seller_region.r_name <> buyer_region.r_name")
    )
    return q.to_df(spark)


# ------------------------------------------------------------------- two time columns


@once("sales_orders")
def two_times(spark: SparkSession, sf: str) -> Model:
    """Sales by supplier, in partitions by month of shipping and year of ordering."""
    model, path = warehouse(spark, sf).sales(spark), new_dir(spark, "sales_orders")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), YEARLY.label(F.col("o_orderdate")).alias("order_year"))
    lines = table(spark, sf, "lineitem").join(orders, "l_orderkey")
    dims = ["l_suppkey", "l_returnflag", "order_year"]
    rolled = RU.rollup(lines, SALES, MONTHLY, dims, "l_shipdate", SALES_EXPRS)
    RU.write_partitions(rolled, path, ("update_period", "dt", "order_year"))
    plain = RU.rollup_schema(SALES, dims[:2])
    schema = StructType([*plain.fields[:-2], *StructType.fromDDL("update_period string, dt string, order_year string").fields])
    fact = Fact(
        "sales_orders",
        "sales",
        ("l_suppkey", "l_returnflag", "quantity", "revenue", "max_price", "min_price", "lines", "tax"),
        (
            FactStorage(
                "lake",
                lambda s: s.read.schema(schema).parquet(path),
                (MONTHLY,),
                base=path,
                schema=schema,
                others={"orders.o_orderdate": ("order_year", YEARLY)},
            ),
        ),
        150,
    )
    months = table(spark, sf, "lineitem").select(MONTHLY.truncate(F.col("l_shipdate")).alias("at")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    folder = F.concat(F.lit(f"{path}/update_period=MONTHLY/dt="), "dt")
    rows = P.manifest_of_span(months, "sales_orders", "lake", MONTHLY).withColumn("location", folder)
    loaded = spark.read.schema(schema).parquet(path).select("dt").distinct()
    kept = f"{path}_manifest"
    rows.join(loaded, "dt").select(P.MANIFEST_SCHEMA.fieldNames()).unionByName(model.manifest(spark)).write.parquet(kept)
    return replace(model, facts=(*model.facts, fact), manifest=lambda s: s.read.schema(P.MANIFEST_SCHEMA).parquet(kept))


TWO_TIMES = """
select l_returnflag, round(sum(l_quantity), 2) as quantity, count(*) as lines
from lineitem join orders on l_orderkey = o_orderkey
where l_shipdate >= timestamp '1996-02-01' and l_shipdate < timestamp '2000-06-01'
  and o_orderdate >= timestamp '{}' and o_orderdate < timestamp '{}' group by 1
"""


def _ordered(spark: SparkSession, sf: str, frm: str, to: str) -> Query:
    q = Query.of(two_times(spark, sf), SALES).time_range("l_shipdate", "1996-02", "2000-06")
    return q.time_range("orders.o_orderdate", frm, to).select("l_returnflag", "quantity", "lines")


@query("time_range_two_partitions", TWO_TIMES.format("1997-01-01", "2000-01-01"))
def _(spark, sf):
    """Both ranges choose partitions of one fact, and no row is looked at for them."""
    return rounded(_ordered(spark, sf, "1997", "2000").to_df(spark), "quantity")


@query("time_range_two_partitions_rows", TWO_TIMES.format("1997-03-01", "1999-11-15"))
def _(spark, sf):
    """The second range ends inside partitions: rows decide."""
    return rounded(_ordered(spark, sf, "1997-03", "1999-11-15").to_df(spark), "quantity")


# -------------------------------------------------------------------------- dimensions


@once("customer_tables")
def dumped(spark: SparkSession, sf: str) -> Model:
    """Customers in two tables of different columns, and yearly dumps of what they ordered before."""
    model, path = warehouse(spark, sf).sales(spark), new_dir(spark, "customers")
    table(spark, sf, "customer").select("c_custkey", "c_mktsegment").write.parquet(f"{path}/segments")
    orders = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    counts = orders.groupBy("o_custkey", "y").agg(F.count(F.lit(1)).alias("n"))
    years = counts.groupBy().agg(F.sequence(F.min("y"), F.max("y") + 1).alias("years"))
    # a customer has a row per year, bounded by the years there are
    every = counts.select("o_custkey").distinct().join(F.broadcast(years)).select("o_custkey", F.explode("years").alias("y"))
    before = Window.partitionBy("o_custkey").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    dumps = every.join(counts, ["o_custkey", "y"], "left").select(
        F.col("o_custkey").alias("h_custkey"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("h_orders"), F.col("y").cast("string").alias("dt")
    )
    dumps.filter("h_orders > 0").write.partitionBy("dt").parquet(f"{path}/history")
    customer = model.dim("customer")
    tables = (
        DimTable("customer_segments", ("c_custkey", "c_mktsegment"), (DimStorage("lake", lambda s: s.read.parquet(f"{path}/segments")),), 1),
        DimTable("customer_all", tuple(a.name for a in customer.attrs), customer.storages, 10),
    )
    customer = replace(customer, storages=(), tables=tables)
    history_schema = "h_custkey bigint, h_orders bigint, dt string"
    history = Dim(
        "history",
        (Attr("h_custkey", "bigint"), Attr("h_orders", "bigint")),
        (DimStorage("lake", lambda s: s.read.schema(history_schema).parquet(f"{path}/history"), YEARLY),),
    )
    orders_dim = model.dim("orders")
    keyed = tuple(replace(a, refs=(*a.refs, Ref("history", "h_custkey"))) if a.name == "o_custkey" else a for a in orders_dim.attrs)
    others = tuple(d for d in model.dims if d.name not in ("customer", "orders"))
    return replace(model, dims=(*others, customer, replace(orders_dim, attrs=keyed), history))


@query(
    "dim_table_choice",
    f"""select c_mktsegment, round(sum(l_quantity), 2) as quantity
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
        where {IN_SOLD} group by 1""",
)
def _(spark, sf):
    """The lightest table of customers that has the columns."""
    q = Query.of(dumped(spark, sf), SALES).time_range("l_shipdate", *SOLD)
    return rounded(q.select("customer.c_mktsegment", "quantity").to_df(spark), "quantity")


@query(
    "valid_dim_tables",
    f"""select c_mktsegment, round(sum(l_quantity), 2) as quantity
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
        where {IN_SOLD} group by 1""",
)
def _(spark, sf):
    """The heavier table of customers, as asked for."""
    q = Query.of(dumped(spark, sf), SALES).time_range("l_shipdate", *SOLD)
    q = q.conf(valid_dim_tables=("lake_orders", "lake_customer_all"))
    return rounded(q.select("customer.c_mktsegment", "quantity").to_df(spark), "quantity")


@query(
    "valid_storage_tables",
    f"""select event_type, round(sum(value), 2) as value, count(*) as n from events where {IN_EDGES} group by 1""",
)
def _(spark, sf):
    """The user fact by the name of its table on a storage, although a lighter one is there."""
    q = activity(spark, sf, span=("2024-01-01-05", "2024-01-29-07")).conf(valid_storage_tables=("lake_activity_user",))
    return rounded(q.select("event_type", "value", "n").to_df(spark), "value")


@query(
    "dim_snapshot_join",
    """with history as (select o_custkey as k, count(*) as n from orders where o_orderdate < timestamp '1999-01-01' group by 1)
       select least(n, 20) as orders_before, round(sum(l_quantity), 2) as quantity
       from lineitem join orders on l_orderkey = o_orderkey join history on o_custkey = k
       where l_shipdate >= timestamp '1998-10-01' and l_shipdate < timestamp '1999-07-01' group by 1""",
)
def _(spark, sf):
    """The dump of customers in force at the end of the range: that of the year it ends in."""
    q = Query.of(dumped(spark, sf), SALES).time_range("l_shipdate", "1998-10", "1999-07").conf(dim_as_of="range")
    q = q.select("least(history.h_orders, 20) as orders_before", "quantity")
    return rounded(q.to_df(spark), "quantity")


# ---------------------------------------------------------------------- late and streamed


@query(
    "lookahead_monthly",
    """
    with late as (select *, l_shipdate + interval 1 day * (l_orderkey % 100) as pt from lineitem)
    select l_returnflag, round(sum(l_quantity), 2) as quantity, count(*) as lines from late
    where l_shipdate >= timestamp '1997-01-15' and l_shipdate < timestamp '1999-05-20'
      and pt >= timestamp '1997-01-01' and pt < timestamp '1999-08-01' group by 1
    """,
)
def _(spark, sf):
    """Lines are booked up to a hundred days after shipping, in months; two months ahead are read too."""

    def booked(s):
        pt = F.col("l_shipdate") + F.make_dt_interval(days=(F.col("l_orderkey") % 100).cast("int"))
        return table(s, sf, "lineitem").select("*", F.lit(MONTHLY.name).alias("update_period"), MONTHLY.label(MONTHLY.truncate(pt)).alias("dt"))

    def months(s):
        span = table(s, sf, "lineitem").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
        return P.manifest_of_span(span, "sales_booked", "lake", MONTHLY)

    fact = Fact(
        "sales_booked",
        "sales",
        ("l_returnflag", "l_suppkey", "l_shipdate", "quantity", "lines"),
        (FactStorage("lake", booked, (MONTHLY,)),),
        aggregated=False,
        time_column="l_shipdate",
        exprs=SALES_EXPRS,
    )
    q = Query.of(Model((SALES,), (fact,), (), months), SALES).time_range("l_shipdate", "1997-01-15", "1999-05-20")
    q = q.conf(process_time_col="pt", lookahead={MONTHLY: 2}, fail_if_partial=True)
    return rounded(q.select("l_returnflag", "quantity", "lines").to_df(spark), "quantity")


STREAMED = """
with hours as (select date_trunc('hour', ts) as h, * from events where ts < (
    -- the first slice ends hours after its last events; the watermark is four hours behind all
    select max(ts) - interval 4 hour from events)),
closed as (select * from hours where h + interval 1 hour <= (select max(ts) - interval 4 hour from events)),
reached as (select max(h) + interval 1 hour as t from closed)
select 'HOURLY' as update_period, strftime(h, '%Y-%m-%d-%H') as dt, event_type, round(sum(value), 2) as value,
       max(value) as max_value, min(value) as min_value, count(*) as n, round(avg(value), 6) as mean, count(nullif(user_id, 7)) as users
from closed group by 1, 2, 3
union all
select 'DAILY', strftime(h, '%Y-%m-%d'), event_type, round(sum(value), 2), max(value), min(value), count(*), round(avg(value), 6),
       count(nullif(user_id, 7))
from closed, reached where date_trunc('day', h) + interval 1 day <= t group by 1, 2, 3
"""


@query("stream_rollup", STREAMED)
def _(spark, sf):
    """Events come in three slices, each up to three hours late; the stream stops and goes on from its
    checkpoint between them. Closed hours and whole days are what a batch rollup gives."""
    base = new_dir(spark, "stream")
    source, path, checkpoint = f"{base}/in", f"{base}/activity_stream", f"{base}/checkpoint"
    events = table(spark, sf, "events")
    arrived = F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 4).cast("int"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    cuts = [first + (last - first) * k / 3 for k in (1, 2)]
    slice_of = sum((arrived >= F.lit(c).cast("timestamp_ntz")).cast("int") for c in cuts)
    events.withColumn("slice", slice_of).write.partitionBy("slice").parquet(f"{base}/slices")
    for k in range(3):
        part = spark.read.schema(events.schema).parquet(f"{base}/slices/slice={k}")
        part.write.mode("append").parquet(source)
        rows = spark.readStream.schema(events.schema).parquet(source)
        stream_rollup(rows, ACTIVITY, [HOURLY, DAILY], ["event_type"], "ts", "4 hours", path, checkpoint, ACTIVITY_EXPRS).awaitTermination()
    fact = FactStorage("stream", lambda s: RU.read_partitions(s, path, RU.rollup_schema(ACTIVITY, ["event_type"])), (HOURLY, DAILY))
    listed = stream_manifest(spark, path).select(F.col("period").alias("update_period"), "dt")
    found = fact.read(spark).join(listed, ["update_period", "dt"], "left_semi")
    mean = next(m for m in ACTIVITY.measures if m.name == "mean")
    return rounded(rounded(found.withColumn("mean", RU.read_state(mean, "mean")), "value"), "mean", places=6)


@query(
    "partition_scan_files",
    """select strftime(ts, '%Y-%m-%d') as dt, event_type, count(*) as n, round(sum(value), 2) as value
       from events group by 1, 2""",
)
def _(spark, sf):
    """Days in folders with odd names, in folders inside them, and as single files."""
    schema = StructType.fromDDL("event_type string, value double")
    day = DAILY.label(DAILY.truncate(F.col("ts")))
    events = table(spark, sf, "events").select("event_type", "value", day.alias("dt"))
    odd = new_dir(spark, "days of 50%+ more")
    for name, rows in (("plain", F.col("dt") < "2024-01-12"), ("inner k=1", F.col("dt") >= "2024-01-12")):
        part = events.filter(rows).withColumn("day", F.concat_ws(" ", F.lit("day"), "dt"))
        inner = ["hour"] if name.startswith("inner") else []
        part = part.withColumn("hour", F.pmod(F.hash("value"), F.lit(2))).repartition("day")
        part.write.partitionBy("day", *inner).parquet(f"{odd}/{name}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(odd).select("path")
    dt = F.regexp_extract("path", r"day(?:=|%3D)day(?: |%20)([0-9-]+)", 1)
    # odd days by file, even ones by folder
    folder = F.regexp_extract("path", r"^(.*day(?:=|%3D)[^/]*)", 1)
    at = F.when(F.substring(dt, 10, 1).cast("int") % 2 == 1, F.col("path")).otherwise(folder)
    listed = files.select(
        F.lit("events").alias("table"), F.lit("lake").alias("storage"), F.lit("DAILY").alias("period"), dt.alias("dt"),
        at.alias("location"), F.lit("parquet").alias("format"),
    )
    df = P.scan_partitions(spark, P.manifest_rows(listed.distinct()), schema)
    return df.groupBy("dt", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))
