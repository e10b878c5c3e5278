"""Building fact tables at coarser periods from finer ones."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubespark.model import Cube, CubeError, Measure
from cubespark.plans.periods import UpdatePeriod, period_start
from cubespark.session import settings

PARTITION_COLUMNS = ("update_period", "dt")


# Default aggregates that rollups can hold.
MERGED = ("sum", "min", "max", "count", "avg")
AVERAGE = "struct<sum:double,n:bigint>"


def merging_measures(cube: Cube) -> list[Measure]:
    """Measures whose default aggregate can be had from aggregates of parts.

    Measures without a default aggregate are not part of rollups.
    """
    other = [m.name for m in cube.measures if m.aggr and m.aggr.lower() not in MERGED]
    if other:
        raise CubeError(f"these measures cannot be merged from parts: {other}")
    return [m for m in cube.measures if m.aggr]


def state_type(measure: Measure) -> str:
    """Type of what a rollup holds of a measure: an average is kept as its sum and count."""
    return {"avg": AVERAGE, "count": "bigint"}.get(measure.aggr.lower(), measure.type)


def state_of(measure: Measure, value: str, merged: bool) -> Column:
    """Aggregate of a measure's values, or of what finer periods hold of it."""
    fn = measure.aggr.lower()
    if fn == "avg":
        total, n = (f"{value}.sum", f"sum({value}.n)") if merged else (value, f"count({value})")
        state = F.struct(F.expr(f"cast(sum({total}) as double)").alias("sum"), F.expr(n).alias("n"))
    elif fn == "count":
        state = F.expr(f"sum({value})" if merged else f"count({value})")
    else:
        state = F.expr(f"{fn}({value})")
    return state.cast(state_type(measure)).alias(measure.name)


def read_state(measure: Measure, column: str | Column) -> Column:
    """The value of one row's state."""
    state = F.col(column) if isinstance(column, str) else column
    return F.try_divide(state["sum"], state["n"]) if measure.aggr.lower() == "avg" else state


def rollup(
    df: DataFrame,
    cube: Cube,
    period: UpdatePeriod,
    dims: list[str],
    time: str | Column,
    exprs: Mapping[str, str] | None = None,
    merged: bool = False,
) -> DataFrame:
    """One row per period and combination of ``dims`` with the measures' default aggregates.

    ``exprs`` gives measures that the source does not hold under their own name;
    ``merged`` says that the source is a rollup itself.
    The aggregation combines before the shuffle, so a hot combination is cheap.
    """
    at = F.col(time) if isinstance(time, str) else time
    aggs = [state_of(m, (exprs or {}).get(m.name, m.name), merged) for m in merging_measures(cube)]
    return (
        df.groupBy(period.truncate(at).alias("_start"), *dims)
        .agg(*aggs)
        .withColumn("update_period", F.lit(period.name))
        .withColumn("dt", period.label(F.col("_start")))
        .drop("_start")
    )


def write_partitions(df: DataFrame, path: str, columns: tuple[str, ...] = PARTITION_COLUMNS) -> None:
    """Write partitions, replacing those that are there already (safe to run again).

    Rebalancing splits large partitions over tasks and lets one task write many small ones, but
    not all of them while others are idle: opening files is most of the work for these.
    """
    with settings(df.sparkSession, spark_sql_adaptive_coalescePartitions_minPartitionSize="16k"):
        (
            df.hint("rebalance", *columns)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*columns)
            .parquet(path)
        )


def read_partitions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A partitioned fact table; partition values stay strings."""
    return spark.read.schema(schema).parquet(path)


def read_period(
    spark: SparkSession, path: str, schema: T.StructType, period: UpdatePeriod
) -> DataFrame:
    """The partitions of one period; folders of other periods are not listed."""
    reader = spark.read.schema(schema).option("basePath", path)
    return reader.parquet(f"{path}/update_period={period.name}")


def rollup_schema(cube: Cube, dims: list[str]) -> T.StructType:
    fields = [f"`{d}` {cube.field(d).type}" for d in dims]
    fields += [f"`{m.name}` {state_type(m)}" for m in merging_measures(cube)]
    fields += [f"{c} string" for c in PARTITION_COLUMNS]
    return T.StructType.fromDDL(", ".join(fields))


def source_period(period: UpdatePeriod, written: list[UpdatePeriod]) -> UpdatePeriod | None:
    """Coarsest period already written whose partitions nest in ``period``."""
    nests = [
        p
        for p in written
        if p.rank < period.rank and (p is not UpdatePeriod.WEEKLY)
    ]
    return max(nests, key=lambda p: p.rank, default=None)


def build_rollups(
    source: DataFrame,
    cube: Cube,
    periods: list[UpdatePeriod],
    dims: list[str],
    time: str | Column,
    path: str,
    exprs: Mapping[str, str] | None = None,
    merged: bool = False,
) -> None:
    """Write a fact table at several periods, each from the next finer one.

    The source is read once, for the finest period; ``merged`` says that it is a rollup itself.
    """
    spark = source.sparkSession
    schema, written = rollup_schema(cube, dims), []
    for period in sorted(periods, key=lambda p: p.rank):
        finer = source_period(period, written)
        if finer is None:
            df = rollup(source, cube, period, dims, time, exprs, merged)
        else:
            below = read_period(spark, path, schema, finer)
            at = period_start(F.lit(finer.name), F.col("dt"))
            df = rollup(below, cube, period, dims, at, merged=True)
        write_partitions(df, path)
        written.append(period)


def consistency(a: DataFrame, b: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Two answers side by side with the difference of each measure.

    Rows are matched by grouping, so null keys match and nothing is joined;
    ``rows`` is 2 where both sides have the key exactly once.
    """
    if set(keys) & set(measures):
        raise CubeError("a column is both key and measure")

    def side(df: DataFrame, name: str, other: str) -> DataFrame:
        return df.select(
            *keys,
            *[F.col(m).alias(f"{m}_{name}") for m in measures],
            *[F.lit(None).cast(df.schema[m].dataType).alias(f"{m}_{other}") for m in measures],
        )

    both = side(a, "left", "right").unionByName(side(b, "right", "left"))
    aggs = [F.max(f"{m}_{s}").alias(f"{m}_{s}") for m in measures for s in ("left", "right")]
    result = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *aggs)
    return result.select(
        "*",
        *[(F.col(f"{m}_left") - F.col(f"{m}_right")).alias(f"{m}_difference") for m in measures],
    )
