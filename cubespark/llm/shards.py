"""Shards of near equal size by sampled splitters.

Rows are ordered by a hash of their text, so equal texts are neighbours. A sample
of keys, each row taken with a chance that grows with its size, gives quantile
boundaries; they cut the rows into ranges, and ranges with many rows into cells.
A text with more copies than a cell holds gets cells of its own, by a hash of the
row's place. Sums per range, per cell and inside a cell give each row its exact
position in bytes and rows, and its share of the whole names its shard.

Equal texts stay in one shard unless their group is larger than a tenth of a shard
and than the largest single row; then its rows are units of their own. So a shard
differs from the mean by at most one unit.

Null texts count as empty ones. Repeated rows are rows of their own, in one group.
Null ids are allowed. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubespark.llm.steps import Steps

SAMPLES_PER_RANGE = 64
RANGES_PER_SHARD = 8
CELL_ROWS = 1000
FIRST = -(1 << 63)


def sized(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """What is needed of each row; texts themselves are never shuffled."""
    raw = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.xxhash64(raw).alias("key"),
        # written with the row; spreads rows that are equal in every column
        F.monotonically_increasing_id().alias("at"),
    )


def splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantiles of a size-weighted sample; at most twice the sample's size is collected."""
    wanted = ranges * SAMPLES_PER_RANGE
    # the same rows are drawn whenever a task runs again
    draw = F.pmod(F.xxhash64("doc_id", "key", F.lit("draw")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    keys = [r[0] for r in rows.where(draw * total < F.col("size") * wanted).select("key").collect()]
    keys.sort()
    cuts = {keys[len(keys) * i // ranges] for i in range(1, ranges)} if keys else set()
    return sorted(cuts)


def _count_at_most(values: list[int], key: Column, width: int = 16) -> Column:
    """How many of the sorted values are not above the key, in two steps."""
    groups = [values[i : i + width] for i in range(0, len(values), width)] or [[]]
    if len(groups) == 1:
        return F.size(F.filter(_longs(values), lambda v: v <= key)) if values else F.lit(0)
    heads = F.size(F.filter(_longs([g[0] for g in groups[1:]]), lambda v: v <= key))
    nested = F.array(*[_longs(g) for g in groups])
    inside = F.size(F.filter(F.element_at(nested, heads + 1), lambda v: v <= key))
    return heads * width + inside


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values]) if values else F.array().cast("array<long>")


def shard_by_size(df: DataFrame, shards: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and slot of every row, sizes near equal."""
    steps = Steps(df.sparkSession)
    rows = steps.kept(sized(df, id_column, text), "shard-rows")
    total, largest = rows.agg(F.sum("size"), F.max("size")).first()
    total, largest = total or 1, largest or 1
    cuts = splitters(rows, total, shards * RANGES_PER_SHARD)
    rows = rows.withColumn("range", _count_at_most(cuts, F.col("key")))
    placed = steps.kept(_place(steps, rows, cuts), "shard-cells")
    steps.drop("shard-rows")
    return _assign(steps, placed, shards, total, max(largest, total // shards // 10))


def _place(steps: Steps, rows: DataFrame, cuts: list[int]) -> DataFrame:
    """The cell of each row: (range, part of the range, hot key, part of its rows)."""
    found = dict(rows.groupBy("range").count().collect())  # one row per range
    cells = [max(1, -(-found.get(i, 0) // CELL_ROWS)) for i in range(len(cuts) + 1)]
    lows = [FIRST, *cuts]
    widths = [float(b - a) / n for a, b, n in zip(lows, [*cuts, -FIRST], cells)]
    at = F.col("range") + 1
    low = F.element_at(_longs(lows), at).cast("double")
    width = F.element_at(F.array(*[F.lit(w) for w in widths]), at)
    part = F.floor((F.col("key").cast("double") - low) / width).cast("int")
    last = F.element_at(F.array(*[F.lit(n - 1) for n in cells]), at)
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > CELL_ROWS)
    hot = hot.select("key", F.col("key").alias("hot"), F.ceil(F.col("copies") / CELL_ROWS).alias("salts"))
    hot = steps.kept(hot, "hot-keys")  # a table, so that Spark can split the join's hot keys
    salt = F.pmod(F.xxhash64("at"), F.col("salts"))
    return (
        rows.withColumn("part", F.greatest(F.lit(0), F.least(part, last)))
        .join(hot, "key", "left")
        .withColumn("cell", F.struct("part", "hot", F.when(F.col("hot").isNotNull(), salt).alias("salt")))
        .drop("part", "hot", "salts", "at")
    )


def _assign(steps: Steps, rows: DataFrame, shards: int, total: int, unit: int) -> DataFrame:
    per_cell = rows.groupBy("range", "cell").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    per_range = per_cell.groupBy("range").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))

    def before(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    # one row per range, as many as the shards ask for
    ranges = Window.orderBy("range")
    offsets = per_range.select("range", before("bytes", ranges).alias("r_bytes"), before("rows", ranges).alias("r_rows"))
    cells = Window.partitionBy("range").orderBy("cell")
    group = Window.partitionBy("range", "cell.part", "cell.hot")
    per_cell = (
        per_cell.withColumn("c_bytes", before("bytes", cells))
        .withColumn("c_rows", before("rows", cells))
        .withColumn("hot_bytes", F.sum("bytes").over(group))
        .withColumn("hot_start", F.min("c_bytes").over(group))
        .join(offsets, "range")
        .select(
            "range",
            "cell",
            (F.col("r_bytes") + F.col("c_bytes")).alias("cell_start"),
            (F.col("r_rows") + F.col("c_rows")).alias("cell_row"),
            (F.col("r_bytes") + F.col("hot_start")).alias("hot_start"),
            "hot_bytes",
        )
    )
    inside = Window.partitionBy("range", "cell").orderBy("key", "doc_id")
    alike = Window.partitionBy("range", "cell", "key")
    hot = F.col("cell.hot").isNotNull()
    start = F.col("cell_start") + F.col("_before")
    rows = (
        rows.withColumn("_before", before("size", inside))
        .withColumn("_row", F.row_number().over(inside))
        .withColumn("_bytes", F.sum("size").over(alike))
        .withColumn("_first", F.min("_before").over(alike))
        .join(per_cell, ["range", "cell"])
    )
    unit_bytes = F.when(hot, F.col("hot_bytes")).otherwise(F.col("_bytes"))
    unit_start = F.when(hot, F.col("hot_start")).otherwise(F.col("cell_start") + F.col("_first"))
    twice = F.when(unit_bytes <= unit, 2 * unit_start + unit_bytes).otherwise(2 * start + F.col("size"))
    shard = F.least(F.lit(shards - 1), F.floor(twice.cast("decimal(30,0)") * shards / (2 * total))).cast("int")
    rows = rows.select(
        "doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("cell_row") + F.col("_row") - 1).alias("row")
    )
    rows = steps.kept(rows, "shard-positions")
    steps.drop("shard-cells")
    firsts = rows.groupBy("shard").agg(F.min("row").alias("first"))  # one row per shard
    return rows.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
