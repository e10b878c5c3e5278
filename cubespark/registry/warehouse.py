"""Cubes over the given tables, with rollup facts built from them by Spark.

Two cubes: ``activity`` over events and ``sales`` over lineitem. Rollups are
written once per application to the shared folder and then reused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.model import (
    Attr,
    Cube,
    Dim,
    DimStorage,
    Expr,
    Fact,
    FactStorage,
    Measure,
    Model,
    Ref,
)
from cubespark.operators.rollup import (
    build_rollups,
    read_partitions,
    read_period,
    rollup_schema,
)
from cubespark.plans.partitions import manifest_of_span, partition_folders, with_locations, write_manifest
from cubespark.plans.periods import UpdatePeriod, instant, parse_instant, period_start
from cubespark.session import new_dir

HOURLY, DAILY, WEEKLY = UpdatePeriod.HOURLY, UpdatePeriod.DAILY, UpdatePeriod.WEEKLY
MONTHLY, QUARTERLY, YEARLY = UpdatePeriod.MONTHLY, UpdatePeriod.QUARTERLY, UpdatePeriod.YEARLY

ACTIVITY = Cube(
    "activity",
    measures=(
        Measure("value", "double", "sum"),
        Measure("max_value", "double", "max"),
        Measure("min_value", "double", "min"),
        Measure("n", "bigint", "sum"),
        Measure("amount", "double"),
        Measure("mean", "double", "avg"),
        Measure("users", "bigint", "count"),
    ),
    attrs=(
        Attr("event_type"),
        Attr("user_id", "bigint", (Ref("customer", "c_custkey"),)),
        Attr("ts", "timestamp_ntz"),
    ),
    exprs=(
        Expr("mean_value", "double", "value / n"),
        Expr("kind", "string", "case when event_type in ('purchase', 'signup') then 'gain' else 'other' end"),
    ),
    timed=("ts",),
)

SALES = Cube(
    "sales",
    measures=(
        Measure("quantity", "double", "sum"),
        Measure("revenue", "double", "sum"),
        Measure("max_price", "double", "max"),
        Measure("min_price", "double", "min"),
        Measure("lines", "bigint", "sum"),
        Measure("tax", "double", "sum", start=parse_instant("1996-01-01")),
    ),
    attrs=(
        Attr("l_suppkey", "bigint", (Ref("supplier", "s_suppkey"),)),
        Attr("l_partkey", "bigint", (Ref("part", "p_partkey"),)),
        Attr("l_orderkey", "bigint", (Ref("orders", "o_orderkey"),)),
        Attr("l_linenumber", "int"),
        Attr("l_returnflag"),
        Attr("l_linestatus"),
        Attr("l_shipdate", "timestamp_ntz"),
    ),
    exprs=(Expr("unit_revenue", "double", "revenue / quantity"),),
    timed=("l_shipdate", "orders.o_orderdate"),
)

SALES_EXPRS = {
    "quantity": "l_quantity",
    "revenue": "l_extendedprice * (1 - l_discount)",
    "max_price": "l_extendedprice",
    "min_price": "l_extendedprice",
    "lines": "1",
    "tax": "l_tax",
}
ACTIVITY_EXPRS = {
    "max_value": "value",
    "min_value": "value",
    "n": "1",
    "amount": "value",
    "mean": "value",
    "users": "nullif(user_id, 7)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _reader(sf_dir: str, name: str) -> Callable[[SparkSession], DataFrame]:
    return lambda spark: table(spark, sf_dir, name)


def _dims(sf_dir: str) -> tuple[Dim, ...]:
    def dim(name: str, *attrs: Attr, exprs: tuple[Expr, ...] = ()) -> Dim:
        return Dim(name, attrs, (DimStorage("lake", _reader(sf_dir, name)),), exprs)

    return (
        dim(
            "supplier",
            Attr("s_suppkey", "bigint"),
            Attr("s_name"),
            Attr("s_nationkey", "int", (Ref("nation", "n_nationkey", "supplier_nation"),)),
            Attr("s_acctbal", "double"),
        ),
        dim(
            "part",
            Attr("p_partkey", "bigint"),
            Attr("p_name"),
            Attr("p_brand"),
            Attr("p_type"),
            Attr("p_size", "int"),
            Attr("p_retailprice", "double"),
        ),
        dim(
            "orders",
            Attr("o_orderkey", "bigint"),
            Attr("o_custkey", "bigint", (Ref("customer", "c_custkey"),)),
            Attr("o_orderstatus"),
            Attr("o_totalprice", "double"),
            Attr("o_orderdate", "timestamp_ntz"),
            Attr("o_orderpriority"),
        ),
        dim(
            "customer",
            Attr("c_custkey", "bigint"),
            Attr("c_name"),
            Attr("c_nationkey", "int", (Ref("nation", "n_nationkey", "customer_nation"),)),
            Attr("c_acctbal", "double"),
            Attr("c_mktsegment"),
            exprs=(Expr("in_debt", "boolean", "c_acctbal < 0"),),
        ),
        dim(
            "nation",
            Attr("n_nationkey", "int"),
            Attr("n_name"),
            Attr("n_regionkey", "int", (Ref("region", "r_regionkey"),)),
        ),
        dim("region", Attr("r_regionkey", "int"), Attr("r_name")),
    )


def _loaded(folders: DataFrame, finest: UpdatePeriod) -> tuple:
    """First and last loaded period of a table."""
    start = period_start(F.lit(finest.name), F.col("dt"))
    return folders.filter(F.col("period") == finest.name).agg(F.min(start), F.max(start)).first()


def _span(spark: SparkSession, first, last) -> DataFrame:
    return spark.range(1).select(instant(first).alias("first"), instant(last).alias("last"))


class Warehouse:
    """Model and fact tables over one folder of base tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.sf_dir, self.root = sf_dir, new_dir(spark, "facts")
        self._models: dict[str, Model] = {}

    def path(self, fact: str) -> str:
        return f"{self.root}/{fact}"

    def activity(self, spark: SparkSession) -> Model:
        if "activity" not in self._models:
            self._models["activity"] = self._build_activity(spark)
        return self._models["activity"]

    def sales(self, spark: SparkSession) -> Model:
        if "sales" not in self._models:
            self._models["sales"] = self._build_sales(spark)
        return self._models["sales"]

    def _manifest(self, spark, name: str, span: DataFrame, tables: list, until) -> Callable:
        """Write the manifest of whole loaded periods and return its reader."""
        rows = None
        for fact, periods, rolled in tables:
            mine = None
            for p in periods:
                m = manifest_of_span(span, fact, "lake", p).filter(F.col("end") <= until)
                mine = m if mine is None else mine.unionByName(m)
            if rolled is not None:
                mine = with_locations(mine, rolled)
            rows = mine if rows is None else rows.unionByName(mine)
        path = self.path(f"{name}_manifest")
        write_manifest(rows, path)
        schema = rows.schema
        return lambda s: s.read.schema(schema).parquet(path)

    def _rolled(self, fact: str, cube: Cube, dims: list[str], periods: tuple) -> FactStorage:
        path, schema = self.path(fact), rollup_schema(cube, dims)
        return FactStorage(
            "lake", lambda s: read_partitions(s, path, schema), periods, base=path, schema=schema
        )

    def _build_activity(self, spark: SparkSession) -> Model:
        events = table(spark, self.sf_dir, "events")
        user_dims, type_dims = ["event_type", "user_id"], ["event_type"]
        build_rollups(
            events,
            ACTIVITY,
            [HOURLY, DAILY, WEEKLY],
            user_dims,
            "ts",
            self.path("activity_user"),
            ACTIVITY_EXPRS,
        )
        # the coarser fact comes from the finer one, events are not read again
        days = read_period(
            spark, self.path("activity_user"), rollup_schema(ACTIVITY, user_dims), DAILY
        )
        build_rollups(
            days,
            ACTIVITY,
            [DAILY, WEEKLY],
            type_dims,
            period_start(F.lit(DAILY.name), F.col("dt")),
            self.path("activity_type"),
            merged=True,
        )
        by_user = partition_folders(spark, self.path("activity_user"))
        by_type = partition_folders(spark, self.path("activity_type"))
        first, last = _loaded(by_user, HOURLY)
        manifest = self._manifest(
            spark,
            "activity",
            _span(spark, first, last),
            [
                ("activity_raw", [HOURLY], None),
                ("activity_user", [HOURLY, DAILY, WEEKLY], by_user),
                ("activity_type", [DAILY, WEEKLY], by_type),
            ],
            HOURLY.shift(instant(last)),
        )
        merged = ("value", "max_value", "min_value", "n", "mean", "users")
        facts = (
            Fact(
                "activity_raw",
                "activity",
                ("event_type", "user_id", "ts", "amount") + merged,
                (FactStorage("lake", _reader(self.sf_dir, "events"), (HOURLY,), False),),
                500,
                aggregated=False,
                time_column="ts",
                exprs=ACTIVITY_EXPRS,
            ),
            Fact(
                "activity_user",
                "activity",
                ("event_type", "user_id") + merged,
                (
                    self._rolled("activity_user", ACTIVITY, user_dims, (HOURLY, DAILY, WEEKLY)),
                ),
                200,
            ),
            Fact(
                "activity_type",
                "activity",
                ("event_type",) + merged,
                (
                    self._rolled("activity_type", ACTIVITY, type_dims, (DAILY, WEEKLY)),
                ),
                100,
            ),
        )
        return Model((ACTIVITY,), facts, _dims(self.sf_dir), manifest)

    def _build_sales(self, spark: SparkSession) -> Model:
        lineitem = table(spark, self.sf_dir, "lineitem")
        dims = ["l_suppkey", "l_returnflag"]
        build_rollups(
            lineitem,
            SALES,
            [MONTHLY, QUARTERLY, YEARLY],
            dims,
            "l_shipdate",
            self.path("sales_supplier"),
            SALES_EXPRS,
        )
        folders = partition_folders(spark, self.path("sales_supplier"))
        first, last = _loaded(folders, MONTHLY)
        # days are known to be loaded up to the last one with rows of the last month
        recent = lineitem.filter(F.col("l_shipdate") >= instant(last))
        last_day = recent.agg(F.max("l_shipdate")).first()[0]
        manifest = self._manifest(
            spark,
            "sales",
            _span(spark, first, last_day),
            [
                ("sales_raw", [DAILY], None),
                ("sales_supplier", [MONTHLY, QUARTERLY, YEARLY], folders),
            ],
            DAILY.shift(instant(last_day)),
        )
        measures = ("quantity", "revenue", "max_price", "min_price", "lines", "tax")
        facts = (
            Fact(
                "sales_raw",
                "sales",
                tuple(a.name for a in SALES.attrs) + measures,
                (FactStorage("lake", _reader(self.sf_dir, "lineitem"), (DAILY,), False),),
                500,
                aggregated=False,
                time_column="l_shipdate",
                exprs=SALES_EXPRS,
            ),
            Fact(
                "sales_supplier",
                "sales",
                ("l_suppkey", "l_returnflag") + measures,
                (
                    self._rolled("sales_supplier", SALES, dims, (MONTHLY, QUARTERLY, YEARLY)),
                ),
                100,
            ),
        )
        return Model((SALES,), facts, _dims(self.sf_dir), manifest)


_OPEN: dict[tuple[str, str], Warehouse] = {}


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The warehouse of this application over a folder, built on first use."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Warehouse(spark, sf_dir)
    return _OPEN[key]
