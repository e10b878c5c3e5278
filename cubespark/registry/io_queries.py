"""Sources, sinks and partition manifests: written by Spark, read back, compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubespark.operators import results as RS
from cubespark.plans import partitions as P
from cubespark.plans.periods import UpdatePeriod
from cubespark.registry.base import query
from cubespark.registry.warehouse import DAILY, HOURLY, table, warehouse
from cubespark.session import new_dir
from cubespark.sources import tables as TB
from cubespark.sources.json_rows import parse_json_rows
from cubespark.sources.nested_csv import CsvOptions, parse_nested_csv, to_nested_csv
from cubespark.sources.text import parse_tokens, read_delimited, to_hive_text


def ddl(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def fresh(name: str) -> str:
    return f"cubespark_{name}_{uuid.uuid4().hex[:10]}"


# -------------------------------------------------------------------------- sources

ORDERS_DDL = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"
ORDERS_SQL = """select o_orderkey, nullif(o_custkey, 7) as o_custkey,
                       nullif(o_orderstatus, 'P') as o_orderstatus, o_totalprice from orders"""


def orders_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.nullif("o_custkey", F.lit(7)).alias("o_custkey"),
        F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        "o_totalprice",
    )


@query("scan_delimited", ORDERS_SQL)
def _(spark, sf):
    path = new_dir(spark, "delimited")
    TB.write_directory(orders_with_nulls(spark, sf), path, sep="|")
    return read_delimited(spark, path, ddl(ORDERS_DDL), sep="|")


NESTED = (
    "id bigint, note string, code char(10), tags array<bigint>, "
    "pairs array<struct<key: bigint, value: string>>, point struct<a: bigint, b: string>"
)


def nested_events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.nullif("event_type", F.lit("error"))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.concat_ws(", ", "event_type", "props").alias("note"),
        kind.alias("code"),
        F.array("user_id", F.lit(None), "event_id").alias("tags"),
        F.array(
            F.struct(F.lit(5).cast("long").alias("key"), F.col("event_type").alias("value")),
            F.struct(F.lit(None).cast("long").alias("key"), F.lit("six").alias("value")),
            F.struct(F.col("user_id").alias("key"), kind.alias("value")),
        ).alias("pairs"),
        F.struct(F.col("user_id").alias("a"), kind.alias("b")).alias("point"),
    )


@query(
    "csv_nested_read",
    """select event_id as id, event_type || ', ' || props as note,
              rpad(nullif(event_type, 'error'), 10, ' ') as code, 3 as n_tags, user_id as tag0,
              event_id as tag2, 'six' as of_null_key, user_id as last_key,
              nullif(event_type, 'error') as last_value, user_id as a, nullif(event_type, 'error') as b
       from events""",
)
def _(spark, sf):
    lines = to_nested_csv(nested_events(spark, sf))
    path = new_dir(spark, "nested-csv")
    lines.write.text(path)
    df = parse_nested_csv(spark.read.text(path), ddl(NESTED))
    of_null = F.filter("pairs", lambda e: e["key"].isNull())
    last = F.element_at("pairs", -1)
    return df.select(
        "id",
        "note",
        "code",
        F.size("tags").alias("n_tags"),
        F.get("tags", F.lit(0)).alias("tag0"),
        F.get("tags", F.lit(2)).alias("tag2"),
        F.get(of_null, F.lit(0))["value"].alias("of_null_key"),
        last["key"].alias("last_key"),
        last["value"].alias("last_value"),
        "point.a",
        "point.b",
    )


@query(
    "csv_nested_write",
    """select '"' || event_id || '","' || event_type || ', ' || replace(props, '"', '""') || '","'
              || coalesce(nullif(event_type, 'error'), 'NULL') || '","'
              || user_id || ',NULL,' || event_id || '","'
              || '5=' || event_type || ',NULL=six,' || user_id || '='
              || coalesce(nullif(event_type, 'error'), 'NULL') || '","'
              || user_id || ':' || coalesce(nullif(event_type, 'error'), 'NULL') || '"' as line
       from events""",
)
def _(spark, sf):
    return to_nested_csv(nested_events(spark, sf)).withColumnRenamed("value", "line")


@query(
    "json_rows_read",
    """select event_id, event_type, value, user_id as first_tag, event_id as inner_id,
              json_extract(props, '$.k')::int as k, null::string as missing,
              null::int as mistyped, 'a\\nb' as text
       from events""",
)
def _(spark, sf):
    document = F.struct(
        F.col("event_id").alias("Event_ID"),
        F.col("event_type").alias("EVENT_TYPE"),
        "value",
        F.array("user_id").alias("Tags"),
        F.struct(F.col("event_id").alias("id")).alias("inner"),
        F.from_json("props", "k int").alias("props"),
        F.col("event_type").alias("mistyped"),
        F.lit("a\nb").alias("text"),
    )
    path = new_dir(spark, "json-rows")
    table(spark, sf, "events").select(F.to_json(document).alias("value")).write.text(path)
    lines = spark.read.text(path)
    schema = (
        "event_id bigint, event_type string, value double, tags array<bigint>, "
        "inner struct<id: bigint>, props map<string, int>, missing string, mistyped int, text string"
    )
    df = parse_json_rows(lines, ddl(schema))
    return df.select(
        "event_id",
        "event_type",
        "value",
        F.get("tags", F.lit(0)).alias("first_tag"),
        F.col("inner.id").alias("inner_id"),
        F.col("props")["k"].alias("k"),
        "missing",
        "mistyped",
        "text",
    )


@query("native_name_map", "select c_custkey, c_name, c_nationkey from customer")
def _(spark, sf):
    """A logical name whose properties give the physical table."""
    physical = fresh("customer")
    TB.ctas(table(spark, sf, "customer"), physical, path=new_dir(spark, "native"))
    logical = {TB.DB_PROPERTY: "default", TB.TABLE_PROPERTY: physical}
    return TB.scan_native(spark, "crm.customer", logical).select("c_custkey", "c_name", "c_nationkey")


@query(
    "native_scan",
    """select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders
       where o_orderstatus = 'F' group by 1""",
)
def _(spark, sf):
    """Plain SQL over a table outside the cube model."""
    name = fresh("native_orders")
    table(spark, sf, "orders").createOrReplaceTempView(name)
    df = TB.scan_native(spark, name).filter("o_orderstatus = 'F'")
    return df.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "ctas",
    """select o_custkey, count(*) as orders, round(sum(o_totalprice), 2) as total
       from orders group by 1""",
)
def _(spark, sf):
    totals = (
        table(spark, sf, "orders")
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )
    return TB.ctas(totals, fresh("totals"), path=new_dir(spark, "ctas"))


@query("insert_overwrite_table", ORDERS_SQL)
def _(spark, sf):
    """Twice into the same text table: the second insert replaces the first."""
    name = fresh("orders_text")
    TB.create_text_table(spark, name, ORDERS_DDL, new_dir(spark, "insert"), null="-NA-")
    orders = orders_with_nulls(spark, sf)
    TB.insert_overwrite(orders.filter("o_orderstatus = 'F'"), name)
    TB.insert_overwrite(orders, name)
    return spark.table(name)


@query("insert_overwrite_dir", ORDERS_SQL)
def _(spark, sf):
    path = new_dir(spark, "directory")
    TB.write_directory(orders_with_nulls(spark, sf), path, sep=",", null="-NA-")
    return spark.read.schema(ddl(ORDERS_DDL)).csv(path, sep=",", nullValue="-NA-")


@query("load_data", ORDERS_SQL)
def _(spark, sf):
    files, name = new_dir(spark, "load-files"), fresh("loaded")
    schema = ddl(ORDERS_DDL)
    orders = orders_with_nulls(spark, sf)
    TB.write_directory(orders, files, sep="\x01")
    TB.ctas(orders.limit(0), name, path=new_dir(spark, "loaded"))
    TB.load_into(spark, files, name, schema, sep="\x01")
    return spark.table(name)


# -------------------------------------------------------------------------- results


def orders_result(spark: SparkSession, sf: str) -> DataFrame:
    return orders_with_nulls(spark, sf).select("o_orderkey", "o_custkey", "o_orderstatus").orderBy("o_orderkey")


CSV_LINE = """'"' || o_orderkey || '","' || coalesce(nullif(o_custkey, 7)::varchar, 'NULL') || '","'
              || coalesce(nullif(o_orderstatus, 'P'), 'NULL') || '"'"""
HEADER = '"o_orderkey","o_custkey","o_orderstatus"'


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Merged lines with their place in the result."""
    return RS.numbered_lines(spark, path).select(F.col("row").alias("place"), F.col("value").alias("line"))


@query(
    "result_header_footer",
    f"""select 0::bigint as place, '{HEADER}' as line
        union all select row_number() over (order by o_orderkey), {CSV_LINE} from orders
        union all select count(*) + 1, 'Total rows:' || count(*) from orders""",
)
def _(spark, sf):
    path = RS.write_result(
        orders_result(spark, sf),
        new_dir(spark, "result"),
        RS.ResultOptions(header=True, footer=True),
    )
    return numbered_lines(spark, path)


@query(
    "result_encoding",
    f"select '{HEADER}' as line union all select {CSV_LINE} from orders",
)
def _(spark, sf):
    options = RS.ResultOptions(header=True, encoding="UTF-16LE")
    path = RS.write_result(orders_result(spark, sf), new_dir(spark, "utf16"), options)
    return RS.merge_parts(spark, path, "UTF-16LE").select(F.col("value").alias("line"))


@query(
    "result_compression",
    f"select 'gz' as ext, {CSV_LINE} as line from orders",
)
def _(spark, sf):
    options = RS.ResultOptions(compress=True)
    path = RS.write_result(orders_result(spark, sf), new_dir(spark, "gzip"), options)
    return RS.merge_parts(spark, path).select(
        F.regexp_extract("name", r"\.csv\.(\w+)$", 1).alias("ext"), F.col("value").alias("line")
    )


@query(
    "result_split",
    f"""with n as (select (row_number() over (order by o_orderkey) - 1) // 4000 as part, {CSV_LINE} as line
                   from orders),
             parts as (select distinct part from n)
        select part, line from n
        union all select part, '{HEADER}' from parts
        union all select max(part), 'Total rows:' || count(*) from n""",
)
def _(spark, sf):
    options = RS.ResultOptions(header=True, footer=True, split=True, max_rows=4000)
    path = RS.write_result(orders_result(spark, sf), new_dir(spark, "split"), options)
    return RS.merge_parts(spark, path).select(
        "part", F.col("value").alias("line")
    )


@query(
    "result_merge_parts",
    """select row_number() over (order by o_orderkey) - 1 as place,
              o_orderkey || '|' || o_orderpriority as line from orders""",
)
def _(spark, sf):
    path = new_dir(spark, "parts")
    lines = table(spark, sf, "orders").orderBy("o_orderkey")
    lines.select(F.concat_ws("|", "o_orderkey", "o_orderpriority").alias("value")).write.text(path)
    return numbered_lines(spark, path)


@query(
    "result_size_gate",
    f"""select 'formatted' as outcome, count(*) + 1 as lines from orders
        union all select 'as it is', count(*) from orders""",
)
def _(spark, sf):
    """The same persisted rows below and above the size threshold."""
    source = new_dir(spark, "persisted")
    RS.csv_rows(orders_result(spark, sf)).write.text(source)
    names = ["o_orderkey", "o_custkey", "o_orderstatus"]
    result = None
    for threshold in (None, 10):
        options = RS.ResultOptions(footer=True, size_threshold=threshold)
        path = RS.format_persisted(spark, source, names, new_dir(spark, "gated"), options)
        outcome = F.lit("as it is" if path == source else "formatted").alias("outcome")
        lines = RS.merge_parts(spark, path).agg(outcome, F.count(F.lit(1)).alias("lines"))
        result = lines if result is None else result.unionByName(lines)
    return result


@query(
    "result_page",
    """select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey
       limit 100 offset 500""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return RS.page(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 500, 100)


@query(
    "result_page_deep",
    """select l_orderkey, l_linenumber, l_extendedprice from lineitem
       order by l_extendedprice desc, l_orderkey, l_linenumber limit 200 offset 4000""",
)
def _(spark, sf):
    """A page far down: ranges before it are counted and never sorted."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return RS.page(lines, [F.desc("l_extendedprice"), F.asc("l_orderkey")], 4000, 200, deep=1000)


@query(
    "result_format_persisted",
    """with n as (select row_number() over (order by o_orderkey) - 1 as r, o_orderkey || '|' || o_orderstatus as line from orders)
       select r // 1000 as part, line from n union all select max(r) // 1000, 'Total rows:' || count(*) from n""",
)
def _(spark, sf):
    """Persisted part files split anew: positions come from counts per piece of a file."""
    source = new_dir(spark, "persisted")
    lines = table(spark, sf, "orders").orderBy("o_orderkey").select(F.concat_ws("|", "o_orderkey", "o_orderstatus").alias("value"))
    lines.write.text(source)
    options = RS.ResultOptions(footer=True, split=True, max_rows=1000, ext="txt")
    path = RS.format_persisted(spark, source, ["line"], new_dir(spark, "formatted"), options)
    return RS.merge_parts(spark, path).select("part", F.col("value").alias("line"))


@query(
    "result_metadata",
    """select * from (select unnest([0, 1, 2, 3]) as position,
                             unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice']) as name,
                             unnest(['bigint', 'bigint', 'string', 'double']) as type),
                     (select count(*) as rows from orders)""",
)
def _(spark, sf):
    return RS.result_schema(orders_with_nulls(spark, sf))


@query(
    "hive_text_write",
    """select event_id || chr(1) || event_type || ', ' || props || chr(1)
              || coalesce(rpad(nullif(event_type, 'error'), 10, ' '), '\\N') || chr(1)
              || user_id || chr(2) || '\\N' || chr(2) || event_id || chr(1)
              || '5' || chr(3) || event_type || chr(2) || '\\N' || chr(3) || 'six' || chr(2) || user_id || chr(3)
              || coalesce(nullif(event_type, 'error'), '\\N') || chr(1)
              || user_id || chr(2) || coalesce(nullif(event_type, 'error'), '\\N') as line
       from events""",
)
def _(spark, sf):
    df = to_hive_text(nested_events(spark, sf), ddl(NESTED))
    return df.withColumnRenamed("value", "line")


@query(
    "token_rows",
    """select o_orderkey::varchar as key, o_orderstatus as status,
              replace(o_orderpriority, ' ', '_') as priority from orders""",
)
def _(spark, sf):
    line = F.concat(
        F.lit("  "),
        F.col("o_orderkey"),
        F.lit("\t \t"),
        F.col("o_orderstatus"),
        F.lit("   "),
        F.replace("o_orderpriority", F.lit(" "), F.lit("_")),
        F.lit("\t"),
    )
    lines = table(spark, sf, "orders").select(line.alias("value"))
    return parse_tokens(lines, ["key", "status", "priority"])


@query(
    "custom_formatter",
    "select 'order=' || o_orderkey || ';status=' || coalesce(nullif(o_orderstatus, 'P'), '-') as line from orders",
)
def _(spark, sf):
    def pairs(df: DataFrame) -> DataFrame:
        status = F.coalesce("o_orderstatus", F.lit("-"))
        text = F.concat(F.lit("order="), "o_orderkey", F.lit(";status="), status)
        return df.select(text.alias("value"))

    options = RS.ResultOptions(formatter=pairs, ext="txt")
    path = RS.write_result(orders_result(spark, sf), new_dir(spark, "pairs"), options)
    return RS.merge_parts(spark, path).select(F.col("value").alias("line"))


# ----------------------------------------------------------------------- partitions

MANIFEST_SQL = """
with m as (
  select distinct 'HOURLY' as period, strftime(date_trunc('hour', ts), '%Y-%m-%d-%H') as dt from events
  union all
  select distinct 'DAILY', strftime(date_trunc('day', ts), '%Y-%m-%d') from events)
"""


def events_manifest(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    rows = None
    for p in (HOURLY, DAILY):
        labels = events.select(p.label(p.truncate(F.col("ts"))).alias("dt")).distinct()
        labels = labels.select(
            F.lit("events").alias("table"), F.lit("lake").alias("storage"), F.lit(p.name).alias("period"), "dt"
        )
        rows = labels if rows is None else rows.unionByName(labels)
    return P.manifest_rows(rows)


@query(
    "partition_add",
    MANIFEST_SQL
    + """select period, dt from m
         union select 'DAILY', strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') from orders""",
)
def _(spark, sf):
    """Days of orders on top; adding known partitions again changes nothing."""
    manifest = events_manifest(spark, sf)
    days = table(spark, sf, "orders").select(
        F.lit("events").alias("table"),
        F.lit("lake").alias("storage"),
        F.lit("DAILY").alias("period"),
        DAILY.label(DAILY.truncate(F.col("o_orderdate"))).alias("dt"),
    )
    grown = P.add_partitions(P.add_partitions(manifest, P.manifest_rows(days)), manifest)
    return grown.select("period", "dt")


@query(
    "partition_list_filter",
    MANIFEST_SQL + "select period, dt from m where dt > '2024-01-10' and dt < '2024-01-20' or period = 'DAILY'",
)
def _(spark, sf):
    found = P.partitions(
        events_manifest(spark, sf), "dt > '2024-01-10' and dt < '2024-01-20' or period = 'DAILY'"
    )
    return found.select("period", "dt")


@query(
    "partition_drop_values",
    MANIFEST_SQL + "select period, dt from m where not (period = 'DAILY' and dt = '2024-01-15')",
)
def _(spark, sf):
    kept = P.drop_by_values(events_manifest(spark, sf), ["period", "dt"], ["DAILY", "2024-01-15"])
    return kept.select("period", "dt")


@query(
    "partition_drop_filter",
    MANIFEST_SQL + "select period, dt from m where not (period = 'HOURLY' and dt >= '2024-01-15')",
)
def _(spark, sf):
    kept = P.drop_by_filter(events_manifest(spark, sf), "period = 'HOURLY' and dt >= '2024-01-15'")
    return kept.select("period", "dt")


@query(
    "partition_split_spec",
    """select distinct date_trunc('hour', ts) as dt_time, event_type as other, 1 as n_time, 1 as n_other
       from events""",
)
def _(spark, sf):
    label = HOURLY.label(HOURLY.truncate(F.col("ts")))
    specs = table(spark, sf, "events").select(label.alias("h"), "event_type").distinct()
    spec = F.create_map(F.lit("dt"), "h", F.lit("et"), "event_type")
    df = P.split_spec(specs.select(spec.alias("spec")), HOURLY)
    return df.select(
        F.col("time_spec")["dt"].alias("dt_time"),
        F.col("other_spec")["et"].alias("other"),
        F.size("time_spec").alias("n_time"),
        F.size("other_spec").alias("n_other"),
    )


@query(
    "partition_scan",
    """select strftime(ts, '%Y-%m-%d') as dt, event_type, count(*) as n, round(sum(value), 2) as value
       from events group by 1, 2""",
)
def _(spark, sf):
    """Days in two places and two formats, listed by a manifest of locations."""
    day = DAILY.truncate(F.col("ts"))
    events = table(spark, sf, "events").withColumn("dt", DAILY.label(day))
    schema = ddl("event_id bigint, event_type string, value double")
    rows = None
    for fmt, days in (("parquet", F.col("dt") < "2024-01-15"), ("json", F.col("dt") >= "2024-01-15")):
        base = new_dir(spark, fmt)
        part = events.filter(days).select(*schema.fieldNames(), "dt")
        part.write.partitionBy("dt").format(fmt).save(base)
        folders = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
        listed = folders.select(
            F.lit("events").alias("table"),
            F.lit("lake").alias("storage"),
            F.lit("DAILY").alias("period"),
            F.regexp_extract("path", "dt=([^/]+)/[^/]*$", 1).alias("dt"),
            F.lit(fmt).alias("format"),
        ).distinct()
        listed = listed.withColumn("location", F.concat(F.lit(base + "/dt="), "dt"))
        rows = listed if rows is None else rows.unionByName(listed)
    df = P.scan_partitions(spark, P.manifest_rows(rows), schema)
    return df.groupBy("dt", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value")
    )


@query(
    "partitions_used",
    """select 'DAILY' as update_period, strftime(ts, '%Y-%m-%d') as dt,
              count(distinct (event_type, user_id)) as rows
       from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-25' group by 2""",
)
def _(spark, sf):
    fact = warehouse(spark, sf).activity(spark).facts[1].storages[0].read(spark)
    asked = fact.filter("update_period = 'DAILY' and dt >= '2024-01-05' and dt < '2024-01-25'")
    return P.partitions_used(asked, ["update_period", "dt"])
