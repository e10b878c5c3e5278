"""Partition manifests.

A manifest is a DataFrame with one row per partition of a physical table:

``table, storage, period, dt``  which partition it is
``start, end``                  the half-open time span it holds
``spec``                        values of partition columns other than time
``location, format``            where its files lie (null for a table's own layout)
"""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubespark.model import CubeError
from cubespark.plans.periods import (
    UpdatePeriod,
    instant,
    instant_sql,
    parse_label,
    period_end,
    period_start,
)

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("storage", T.StringType()),
        T.StructField("period", T.StringType()),
        T.StructField("dt", T.StringType()),
        T.StructField("start", T.TimestampNTZType()),
        T.StructField("end", T.TimestampNTZType()),
        T.StructField("spec", T.MapType(T.StringType(), T.StringType())),
        T.StructField("location", T.StringType()),
        T.StructField("format", T.StringType()),
    ]
)

IDENTITY = ["table", "storage", "period", "dt"]


def manifest_rows(df: DataFrame) -> DataFrame:
    """Complete rows that give at least table, storage, period and dt."""
    start = period_start(F.col("period"), F.col("dt"))
    given = {c.lower() for c in df.columns}
    df = df.withColumn("start", start).withColumn(
        "end", period_end(F.col("period"), F.col("start"))
    )
    for name in ("spec", "location", "format"):
        if name not in given:
            df = df.withColumn(name, F.lit(None).cast(MANIFEST_SCHEMA[name].dataType))
    return df.select([F.col(f.name).cast(f.dataType) for f in MANIFEST_SCHEMA])


def manifest_of_span(
    span: DataFrame, table: str, storage: str, period: UpdatePeriod
) -> DataFrame:
    """Every partition of a period between two instants: a one-row ``(first, last)`` frame.

    A loaded period without rows is a partition too, it is just empty.
    """
    starts = span.select(
        F.explode(
            F.sequence(
                period.truncate(F.col("first")),
                period.truncate(F.col("last")),
                F.expr(period.interval),
            )
        ).alias("start")
    )
    return manifest_rows(
        starts.select(
            F.lit(table).alias("table"),
            F.lit(storage).alias("storage"),
            F.lit(period.name).alias("period"),
            period.label(F.col("start")).alias("dt"),
        )
    )


def add_partitions(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Manifest with further partitions; one already known stays as it is."""
    identity = IDENTITY + ["spec_key"]

    def keyed(df: DataFrame) -> DataFrame:
        # maps cannot be compared: use their entries in key order
        return df.withColumn(
            "spec_key", F.to_json(F.array_sort(F.map_entries(F.coalesce("spec", F.create_map()))))
        )

    known = keyed(manifest)
    fresh = keyed(rows).dropDuplicates(identity).join(known.select(identity), identity, "left_anti")
    return manifest.unionByName(fresh.select(manifest.columns))


def partitions(manifest: DataFrame, where: str | Column | None = None) -> DataFrame:
    """Partitions that satisfy a filter expression."""
    return manifest if where is None else manifest.filter(where)


def drop_by_filter(manifest: DataFrame, where: str | Column) -> DataFrame:
    """Manifest without the partitions that satisfy a filter; unknown counts as no."""
    cond = F.expr(where) if isinstance(where, str) else where
    return manifest.filter(~F.coalesce(cond, F.lit(False)))


def drop_by_values(manifest: DataFrame, columns: list[str], values: list) -> DataFrame:
    """Manifest without the one partition that has the given value in each column."""
    if len(columns) != len(values):
        raise CubeError(f"{len(columns)} partition columns but {len(values)} values")
    cond = F.lit(True)
    for name, value in zip(columns, values):
        cond = cond & F.col(name).eqNullSafe(F.lit(value))
    matches = manifest.filter(cond).limit(2).count()
    if matches != 1:
        raise CubeError(f"{'no' if matches == 0 else 'more than one'} partition has {values}")
    return manifest.filter(~cond)


def split_spec(df: DataFrame, period: UpdatePeriod, spec: str = "spec") -> DataFrame:
    """Split a map of partition values: those that parse by the period's pattern are time."""
    parsed = lambda v: parse_label(v, period.pattern)
    return df.withColumn(
        "time_spec",
        F.transform_values(
            F.map_filter(spec, lambda k, v: parsed(v).isNotNull()),
            lambda k, v: parsed(v),
        ),
    ).withColumn("other_spec", F.map_filter(spec, lambda k, v: parsed(v).isNull()))


def partition_folders(spark: SparkSession, base: str) -> DataFrame:
    """Period, ``dt`` and folder of each written partition of a table, from file names alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    part = r"update_period=([^/]+)/dt=([^/]+)/[^/]*$"
    found = files.select(
        F.regexp_extract("path", part, 1).alias("period"),
        F.regexp_extract("path", part, 2).alias("dt"),
    ).distinct()
    folder = F.concat_ws(
        "/",
        F.lit(base.rstrip("/")),
        F.concat(F.lit("update_period="), "period"),
        F.concat(F.lit("dt="), "dt"),
    )
    return found.withColumn("folder", folder)


def with_locations(manifest: DataFrame, folders: DataFrame) -> DataFrame:
    """Manifest with the folder of each partition; one without rows has none."""
    return (
        manifest.join(folders, ["period", "dt"], "left")
        .withColumn("location", F.coalesce("location", "folder"))
        .select(MANIFEST_SCHEMA.fieldNames())
    )


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One short row per partition, in one file.

    The rows move to the task that writes them: what they are computed from stays in tasks of
    its own, and none holds the joins and aggregations of all tables and periods at once.
    """
    manifest.repartition(1).write.parquet(path)


# --------------------------------------------------------------------------- cover


def cover(
    manifest: DataFrame,
    frm: str | datetime,
    to: str | datetime,
    periods: list[UpdatePeriod] | None = None,
    max_interval: UpdatePeriod | None = None,
    widen: list[str] = (),
) -> DataFrame:
    """Fewest partitions that make up ``[frm, to)``, per table.

    A partition is usable when it lies inside the range; a usable one is chosen
    unless a usable larger one contains it. Months, quarters and years take
    precedence over weeks, which do not nest in them. Tables named in ``widen``
    filter rows themselves, so they also get the partitions that overlap an edge.
    """
    lower, upper = instant_sql(frm), instant_sql(to)
    inside = f"(start >= {lower} and `end` <= {upper})"
    if widen:
        named = _texts(w.lower() for w in widen)
        inside = f"({inside} or lower(table) in ({named}) and start < {upper} and `end` > {lower})"
    allowed = [
        p
        for p in (periods or list(UpdatePeriod))
        if max_interval is None or p.rank <= max_interval.rank
    ]
    usable = manifest.filter(f"{inside} and period in ({_texts(p.name for p in allowed)})")
    weekly = UpdatePeriod.WEEKLY in allowed
    longer = [p for p in allowed if p.rank > UpdatePeriod.WEEKLY.rank]
    if weekly and longer:
        usable = _weeks_apart(usable, longer)
    # What is left nests: a partition lies in an earlier, larger one exactly when that one
    # reaches its end; the same partition on a second storage counts as contained too. Only
    # weeks cross a year, and they hold what starts in a week of the same year. So years are
    # independent: by the start for larger partitions, by the start's week for weeks.
    years = ["year(start)"] + (["year(trunc(cast(start as date), 'week'))"] if weekly else [])
    columns = ["table", "period", "start", "`end`", "dt", "storage", "location", "format"]
    reach = usable.selectExpr(
        *columns,
        *[
            f"max(`end`) over (partition by table, {year} order by start, `end` desc, storage "
            f"rows between unbounded preceding and 1 preceding) as _reach{i}"
            for i, year in enumerate(years)
        ],
    )
    for i in range(len(years)):
        reach = reach.filter(f"_reach{i} is null or `end` > _reach{i}")
    return reach.select(*columns)


def _texts(values) -> str:
    return ", ".join("'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def _weeks_apart(usable: DataFrame, longer: list[UpdatePeriod]) -> DataFrame:
    """Leave out weeks that share days with a usable month, quarter or year."""
    weeks = usable.filter(F.col("period") == UpdatePeriod.WEEKLY.name)
    spans = F.array(
        *[
            F.struct(F.lit(p.name).alias("p"), p.truncate(at).alias("s"))
            for p in longer
            for at in (F.col("start"), F.col("end") - F.expr("interval 1 microsecond"))
        ]
    )
    held = usable.select("table", F.col("period").alias("p"), F.col("start").alias("s"))
    shared = (
        weeks.select("table", "start", F.inline(spans))
        .join(held, ["table", "p", "s"], "left_semi")
        .select("table", "start")
    )
    apart = weeks.join(shared, ["table", "start"], "left_anti")
    return usable.filter(F.col("period") != UpdatePeriod.WEEKLY.name).unionByName(apart)


def gaps(chosen: DataFrame, frm: str | datetime, to: str | datetime) -> DataFrame:
    """Spans of ``[frm, to)`` that the chosen partitions of one table leave open.

    Partitions are followed year by year; a year's last one looks at the first one of the next
    year that has any, of which there is one row per year.
    """
    spark = chosen.sparkSession
    edge = spark.range(1).select(instant(frm).alias("start"), instant(frm).alias("end"))
    spans = edge.unionByName(chosen.select("start", "end")).withColumn("year", F.year("start"))
    firsts = spans.groupBy("year").agg(F.min("start").alias("first"))
    following = firsts.select("year", F.lead("first").over(Window.orderBy("year")).alias("later"))
    inside = Window.partitionBy("year").orderBy("start", "end")
    followed = spans.withColumn("near", F.lead("start").over(inside)).join(following, "year")
    return (
        followed.withColumn("next", F.coalesce("near", "later", instant(to)))
        .filter(F.col("end") < F.col("next"))
        .select(F.col("end").alias("gap_start"), F.col("next").alias("gap_end"))
    )


def missing_partitions(
    manifest: DataFrame,
    frm: str | datetime,
    to: str | datetime,
    finest: UpdatePeriod,
    periods: list[UpdatePeriod] | None = None,
) -> DataFrame:
    """Partitions of the finest period that a range needs and the manifest lacks.

    Only the open spans are expanded, never the whole range.
    """
    open_spans = gaps(cover(manifest, frm, to, periods), frm, to)
    starts = F.sequence(
        finest.truncate(F.col("gap_start")),
        finest.truncate(F.col("gap_end") - F.expr("interval 1 microsecond")),
        F.expr(finest.interval),
    )
    return open_spans.select(F.explode(starts).alias("start")).select(
        F.lit(finest.name).alias("period"),
        finest.label(F.col("start")).alias("dt"),
        "start",
    )


# ----------------------------------------------------------------------- predicates


def partition_predicate(
    parts: list,
    writer: str = "or",
    pattern: str | None = None,
    period_col: str = "update_period",
    dt_col: str = "dt",
) -> Column:
    """Predicate on the partition columns that holds for the listed partitions only.

    ``or`` lists the values; ``between`` writes each unbroken run of a period as
    a range. Both are plain comparisons of partition columns, so Spark prunes.
    """
    py_pattern = pattern and _python_pattern(pattern)
    by_period: dict[str, list] = {}
    for row in sorted(parts, key=lambda r: r["start"]):
        by_period.setdefault(row["period"], []).append(row)
    choices = []
    for name, rows in by_period.items():
        pattern_of = py_pattern or UpdatePeriod[name].py_pattern
        labels = [r["start"].strftime(pattern_of) for r in rows]
        if writer == "between":
            if labels != sorted(labels):
                raise CubeError(f"values of the format {pattern} do not sort by time: no ranges of them")
            runs, first = [], 0
            for i in range(len(rows)):
                if i + 1 == len(rows) or rows[i]["end"] != rows[i + 1]["start"]:
                    runs.append(F.col(dt_col).between(labels[first], labels[i]))
                    first = i + 1
            cond = reduce(Column.__or__, runs)
        elif writer == "or":
            cond = F.col(dt_col).isin(labels)
        else:
            raise CubeError(f"unknown range writer: {writer}")
        choices.append((F.col(period_col) == name) & cond)
    return reduce(Column.__or__, choices) if choices else F.lit(False)


def _python_pattern(pattern: str) -> str:
    # Date letters a partition pattern may use.
    letters = {
        "yyyy": "%Y",
        "MM": "%m",
        "dd": "%d",
        "HH": "%H",
        "mm": "%M",
        "ss": "%S",
    }
    rest = pattern
    for letter in letters:
        rest = rest.replace(letter, "")
    if any(c.isalpha() for c in rest):
        raise CubeError(f"unknown letters in a partition format: {pattern}")
    for letter, directive in letters.items():
        pattern = pattern.replace(letter, directive)
    return pattern


# ---------------------------------------------------------------------------- scans


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme and authority of its file system, as Spark names files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf).makeQualified(at).toString().rstrip("/")


def decoded_path(path: Column) -> Column:
    """A file's name as it is written, with no slashes after the scheme of local files."""
    # only % begins an escape in Spark's names of files; a plus stands for itself
    text = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(text, "^file:/+", "file:/")


def scan_partitions(
    spark: SparkSession,
    manifest: DataFrame | list,
    schema: T.StructType,
    readers: dict | None = None,
) -> DataFrame:
    """Read the listed partitions wherever they lie and attach their values.

    ``manifest`` may be rows of a manifest already chosen. A location may be a folder, with
    folders inside, or a single file, in any number; a file belongs to the longest location
    that its path begins with, and one that belongs to none is an error. One read per
    distinct format. ``readers`` maps a format name to a function of (spark, paths, schema);
    other formats go to ``spark.read.format``, which needs the list of locations.
    """
    rows = manifest
    if isinstance(manifest, DataFrame):
        rows = manifest.select("location", "format", "period", "dt").collect()
    if not rows:
        empty = spark.createDataFrame([], schema)
        return empty.withColumn("update_period", F.lit("")).withColumn("dt", F.lit(""))
    names = {r["location"]: _local(qualified(spark, r["location"])) for r in rows}
    listed = [(names[r["location"]], r["period"], r["dt"]) for r in rows]
    values = spark.createDataFrame(listed, "_location string, update_period string, dt string")
    values = values.select("_location", F.struct("update_period", "dt").alias("_at"))
    parts = None
    for fmt in sorted({r["format"] for r in rows}):
        # a location inside another one is read with it, once
        places = {names[r["location"]]: r["location"] for r in rows if r["format"] == fmt}
        paths = [at for name, at in places.items() if not any(up in places for up in _above(name))]
        read = (readers or {}).get(fmt)
        df = (
            read(spark, paths, schema)
            if read
            else spark.read.format(fmt).schema(schema).option("recursiveFileLookup", True).load(paths)
        )
        df = df.select(*[F.col(f.name) for f in schema], decoded_path(F.col("_metadata.file_path")).alias("_file"))
        parts = df if parts is None else parts.unionByName(df)
    # the depths of locations, a handful, say how far up a file's path has to be looked at
    depths = sorted({x[0].count("/") + 1 for x in listed}, reverse=True)
    found = parts
    for i, depth in enumerate(depths):
        mine = values.filter(F.size(F.split("_location", "/")) == depth).withColumnsRenamed({"_location": f"_folder{i}", "_at": f"_at{i}"})
        found = found.withColumn(f"_folder{i}", F.substring_index("_file", "/", depth)).join(mine, f"_folder{i}", "left")
    unknown = F.raise_error(F.concat(F.lit("a file of no listed partition: "), F.col("_file")))
    held = F.coalesce(*[F.col(f"_at{i}") for i in range(len(depths))], unknown)
    return found.withColumn("_at", held).select(*[f.name for f in schema], "_at.update_period", "_at.dt")


def _above(path: str) -> list[str]:
    """The folders around a path."""
    parts = path.split("/")
    return ["/".join(parts[:i]) for i in range(1, len(parts))]


def _local(path: str) -> str:
    return re.sub("^file:/+", "file:/", path)


def partitions_used(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct partition values that a filtered scan touches, with their row counts.

    Partition columns come from file paths, so only footers are read.
    """
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))


def latest_dump(df: DataFrame, as_of: str | datetime | None = None, period: UpdatePeriod | None = None, dt_col: str = "dt") -> str | None:
    """Value of the latest dump, of those not after ``as_of``: a value, or with a period an instant
    before which the dump begins. Only the partition column is read."""
    dumps = df.select(dt_col)
    if isinstance(as_of, datetime):
        dumps = dumps.filter(parse_label(F.col(dt_col), period.pattern) < instant(as_of))
    elif as_of is not None:
        dumps = dumps.filter(F.col(dt_col) <= F.lit(as_of))
    return dumps.agg(F.max(dt_col)).first()[0]


def dim_snapshot(df: DataFrame, as_of: str | None = None, dt_col: str = "dt") -> DataFrame:
    """Rows of the latest dump, or of the latest one not after ``as_of``; its value prunes the scan."""
    latest = latest_dump(df, as_of, dt_col=dt_col)
    return df.filter(F.col(dt_col) == F.lit(latest)) if latest is not None else df.limit(0)
