"""Writing query results as files: rows, header, footer, encoding, splitting."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from cubespark.operators.ordering import counted_index
from cubespark.session import new_dir
from cubespark.sources.nested_csv import CsvOptions, nested_csv_fields, to_nested_csv
from cubespark.sources.text import FIELD, to_hive_text


def csv_rows(df: DataFrame) -> DataFrame:
    return to_nested_csv(df)


def text_rows(df: DataFrame) -> DataFrame:
    return to_hive_text(df)


@dataclass(frozen=True)
class ResultOptions:
    """How a result is written. A formatter maps rows to one text column ``value``."""

    formatter: Callable[[DataFrame], DataFrame] = csv_rows
    header: bool | str = False
    footer: bool | str = False
    encoding: str = "UTF-8"
    compress: bool = False
    codec: str = "gzip"
    ext: str = "csv"
    split: bool = False
    # Fixed value: default rows per part.
    max_rows: int = 100_000
    # bytes above which persisted rows stay as they are, if asked for
    size_threshold: int | None = None
    csv: CsvOptions = field(default_factory=CsvOptions)


def _field_columns(df: DataFrame, options: ResultOptions) -> DataFrame:
    """Every column as its unquoted CSV text; Spark's CSV writer quotes them."""
    fields = nested_csv_fields(df, options.csv)
    return df.select(*[f.alias(f"c{i}") for i, f in enumerate(fields)])


def _header_text(names: list[str], options: ResultOptions) -> str | None:
    """The header as one line, for rows that are lines."""
    if isinstance(options.header, str):
        return options.header
    if options.formatter is text_rows:
        return FIELD.join(names)
    o = options.csv
    marks = {c: o.escape + c for c in (o.escape, o.quote)}
    return o.sep.join(o.quote + "".join(marks.get(c, c) for c in n) + o.quote for n in names)


def _footer_text(options: ResultOptions, rows: int) -> str:
    return options.footer if isinstance(options.footer, str) else f"Total rows:{rows}"


def _one_line(spark: SparkSession, text: str) -> DataFrame:
    return spark.range(1).select(F.lit(text).alias("value"))


def _write(df: DataFrame, path: str, options: ResultOptions, by: str | None = None) -> None:
    """Write a column ``value`` of lines as they are, or CSV columns with all fields quoted."""
    compression = options.codec if options.compress else "none"
    common = {
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
        "encoding": options.encoding,
        "compression": compression,
        "extension": options.ext,
        "emptyValue": "",
        "lineSep": "\n",
    }
    writer = lambda d: d.write.mode("overwrite").partitionBy(*([by] if by else []))
    if "value" not in df.columns:
        o = options.csv
        quoting = {"sep": o.sep, "quote": o.quote, "escape": o.escape, "quoteAll": "true"}
        writer(df).options(**common, **quoting).csv(path)
    elif options.encoding.upper() in ("UTF-8", "UTF8") and options.ext == "txt":
        writer(df).option("compression", compression).text(path)
    else:
        # the text writer knows one encoding and extension: write a CSV of one column
        # without quotes, and refuse the few lines that the CSV writer would quote
        keep = [by] if by else []
        lines = df.select(*keep, F.explode(F.split("value", "\n")).alias("value"))
        unfit = (F.col("value") == "") | F.col("value").rlike("[\\r\\x00\\x04\\x05]")
        refuse = F.raise_error(F.lit("empty lines and control characters need UTF-8 and ext='txt'"))
        lines = lines.withColumn("value", F.when(unfit, refuse).otherwise(F.col("value")))
        plain = {"sep": "\x04", "quote": "", "escape": "", "comment": "\x05", "escapeQuotes": "false"}
        writer(lines).options(**common, **plain).csv(path)


def write_result(df: DataFrame, path: str, options: ResultOptions = ResultOptions()) -> str:
    """Write a result; the order of a sorted frame is kept from file to file."""
    line_header = options.split and isinstance(options.header, str)
    if options.formatter is csv_rows and not line_header:
        rows = _field_columns(df, options)
    else:
        rows = options.formatter(df)
    return _write_rows(rows, df.columns, path, options)


def _header_row(rows: DataFrame, names: list[str], options: ResultOptions) -> DataFrame:
    one = rows.sparkSession.range(1)
    if "value" in rows.columns or isinstance(options.header, str):
        return one.select(F.lit(_header_text(names, options)).alias("value"))
    return one.select(*[F.lit(n).alias(c) for n, c in zip(names, rows.columns)])


def _write_rows(rows: DataFrame, names: list[str], path: str, options: ResultOptions) -> str:
    """Header, rows and footer below ``path``, in folders that sort in this order.

    Rows are counted while they are written, never twice.
    """
    spark = rows.sparkSession
    if options.split:
        return _write_split(rows, names, path, options)
    return _write_sections(rows, rows.columns, names, path, options)


def _write_sections(
    rows: DataFrame, columns: list[str], names: list[str], path: str, options: ResultOptions, by: str | None = None
) -> str:
    spark = rows.sparkSession
    # an earlier result may have other sections: empty the folder first
    spark.range(0).select(F.lit("").alias("value")).write.mode("overwrite").text(path)
    if options.header:
        _write(_header_row(rows.select(columns), names, options), f"{path}/section=0", options)
    seen = Observation()
    _write(rows.observe(seen, F.count(F.lit(1)).alias("rows")), f"{path}/section=1", options, by)
    if options.footer:
        footer = _one_line(spark, _footer_text(options, seen.get["rows"]))
        _write(footer, f"{path}/section=2", options)
    return path


def _write_split(rows: DataFrame, names: list[str], path: str, options: ResultOptions) -> str:
    """Parts of ``max_rows`` rows, each with the header, the last with the footer."""
    return _write_parts(*counted_index(rows, "_row"), rows.columns, names, path, options)


def _write_parts(indexed: DataFrame, total: int, columns: list[str], names: list[str], path: str, options: ResultOptions) -> str:
    """Parts of rows whose position is in ``_row``."""
    spark, size = indexed.sparkSession, options.max_rows
    parts = max(1, -(-total // size))
    pieces = indexed.withColumn("part", F.floor(F.col("_row") / size))
    if options.header:
        header = _header_row(indexed.select(columns), names, options).first()
        pieces = pieces.unionByName(
            spark.range(parts).select(
                F.col("id").alias("part"),
                F.lit(-1).cast("long").alias("_row"),
                *[F.lit(header[c]).alias(c) for c in columns],
            )
        )
    # parts are of equal size, so hashing them over the tasks is even
    placed = pieces.repartition("part").sortWithinPartitions("part", "_row").drop("_row")
    _write(placed, path, options, by="part")
    if options.footer:
        footer = _one_line(spark, _footer_text(options, total))
        _write(footer, f"{path}/part={parts - 1}/section=2", options)
    return path


PLACE = ("part", "section", "chunk", "file", "name", "block")


def _lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Lines of all part files, with where they are from: names that start with ``_`` or ``.`` are
    left out by Spark."""
    if encoding.upper() in ("UTF-8", "UTF8"):
        lines = spark.read.option("recursiveFileLookup", True).text(path)
    else:
        lines = (
            spark.read.option("recursiveFileLookup", True)
            .option("multiLine", True)  # a split inside a two-byte character cannot be read
            .csv(
                path, schema="value string", sep="\x04", quote="", comment="", encoding=encoding,
                ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
            )
        )
    file = F.col("_metadata.file_path")

    def number(text: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("long")

    return lines.select(
        number(file, r"/part=(\d+)/").alias("part"),
        F.coalesce(number(file, r"/section=(\d+)/"), F.lit(1)).alias("section"),
        F.coalesce(number(file, r"/chunk=(\d+)/"), F.lit(0)).alias("chunk"),
        number(F.col("_metadata.file_name"), r"(\d+)").alias("file"),
        F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )


def _in_order() -> list[Column]:
    return [F.col("part").asc_nulls_first(), *[F.col(c) for c in PLACE[1:]]]


def merge_parts(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Lines of all part files, sorted by section or part, number of the file, and position."""
    return _lines(spark, path, encoding).orderBy(*_in_order(), "line")


def numbered_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """``row``, the position of each line in the merged result, its file's ``chunk`` and the line.

    Lines do not move and are not sorted: a task numbers the lines of a piece of a file as it
    reads them, and the number of lines before the piece comes from one count per piece.
    """
    lines = _lines(spark, path, encoding).withColumn("place", F.struct(*PLACE))
    pieces = lines.groupBy("place").agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("n"))
    # one short row per piece of a file
    order = Window.orderBy(*[F.col("place")[c].asc_nulls_first() for c in PLACE])
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = new_dir(spark, "line-offsets")
    ranked = pieces.select("place", (before - F.col("first")).alias("shift"), (F.row_number().over(order) - 1).alias("rank"))
    ranked.coalesce(1).write.parquet(kept)  # a table, so that Spark knows its size
    placed = lines.join(spark.read.parquet(kept), "place")
    return placed.select((F.col("line") + F.col("shift")).alias("row"), F.col("rank").alias("chunk"), "value")


def persisted_size(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a directory; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def format_persisted(
    spark: SparkSession,
    source: str,
    names: list[str],
    path: str,
    options: ResultOptions = ResultOptions(),
) -> str:
    """Turn persisted part files into a formatted result.

    Above a given size threshold the directory stays as it is and is the result. Each piece of a
    file becomes a chunk of the result, numbered in order, so lines are not sorted.
    """
    if options.size_threshold is not None and persisted_size(spark, source) > options.size_threshold:
        return source
    lines = numbered_lines(spark, source)
    if options.split:
        indexed = lines.select(F.col("row").alias("_row"), "value")
        total = lines.agg(F.coalesce(F.max("row") + 1, F.lit(0))).first()[0]
        return _write_parts(indexed, total, ["value"], names, path, options)
    placed = lines.sortWithinPartitions("chunk", "row").drop("row")
    return _write_sections(placed, ["value"], names, path, options, by="chunk")


def page(df: DataFrame, order: list[Column | str], start: int, size: int, deep: int = 100_000) -> DataFrame:
    """``size`` rows from position ``start`` in an order; ties are broken by the other columns.

    Where a task would hold more than ``deep`` rows for it, rows are dealt into ranges of the order
    by sampled splitters; the ranges' counts tell which of them the page is in, and only these
    are sorted.
    """
    total = [*order, *[F.col(f"`{c}`") for c in df.columns]]
    if start + size <= deep:
        return df.orderBy(*total).offset(start).limit(size)
    spark, path, place = df.sparkSession, new_dir(df.sparkSession, "ranges"), "_range"
    while place in df.columns:
        place = "_" + place
    df.repartitionByRange(*total).withColumn(place, F.spark_partition_id()).write.partitionBy(place).parquet(path)
    dealt = spark.read.parquet(path)
    wanted, before, first = [], 0, 0
    for at, n in sorted(dealt.groupBy(place).count().collect()):  # one number per range
        if before + n > start and before < start + size:
            first = first if wanted else before
            wanted.append(at)
        before += n
    return dealt.filter(F.col(place).isin(wanted)).orderBy(*total).offset(start - first).limit(size).select(df.columns)


def result_schema(df: DataFrame) -> DataFrame:
    """Name, position and qualified type of each column, with the number of rows."""
    columns = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("name"),
            F.lit(
                f.metadata.get("__CHAR_VARCHAR_TYPE_STRING", f.dataType.simpleString())
            ).alias("type"),
        )
        for i, f in enumerate(df.schema)
    ]
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.inline(F.array(*columns)))
