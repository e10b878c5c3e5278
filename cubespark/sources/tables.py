"""Catalog tables: names, creation, overwriting, loading."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubespark.sources.text import NULL, read_delimited

# Table properties that name the physical table.
DB_PROPERTY = "native.db.name"
TABLE_PROPERTY = "native.table.name"


def physical_name(table: str, properties: Mapping[str, str] | None = None) -> str:
    """Physical ``db.table`` of a logical name.

    Properties replace either part; database ``default`` drops the prefix;
    without properties the name stays as it is.
    """
    db, _, name = table.rpartition(".")
    properties = properties or {}
    if TABLE_PROPERTY not in properties and DB_PROPERTY not in properties:
        return table
    db = properties.get(DB_PROPERTY, db)
    name = properties.get(TABLE_PROPERTY, name)
    return name if not db or db.lower() == "default" else f"{db}.{name}"


def scan_native(
    spark: SparkSession, table: str, properties: Mapping[str, str] | None = None
) -> DataFrame:
    """An ordinary table outside the cube model, by its logical name."""
    return spark.table(physical_name(table, properties))


def ctas(df: DataFrame, table: str, fmt: str = "parquet", path: str | None = None) -> DataFrame:
    """Create a table from a query, replacing one of that name; ``path`` makes it external."""
    writer = df.write.format(fmt).mode("overwrite")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def create_text_table(
    spark: SparkSession, table: str, ddl: str, path: str, sep: str = ",", null: str = NULL
) -> None:
    """A table of delimited text with a declared schema."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({ddl}) USING csv "
        f"OPTIONS (sep '{_sql_text(sep)}', nullValue '{_sql_text(null)}', "
        "ignoreLeadingWhiteSpace 'false', ignoreTrailingWhiteSpace 'false') "
        f"LOCATION '{_sql_text(path)}'"
    )


def _sql_text(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def insert_overwrite(df: DataFrame, table: str) -> None:
    """Replace the rows of a table; columns match by position and take its types."""
    target = df.sparkSession.table(table).schema
    if len(target) != len(df.columns):
        raise ValueError(f"{table} has {len(target)} columns, the query {len(df.columns)}")
    columns = [
        F.col(f"`{name}`").cast(f.dataType).alias(f.name) for name, f in zip(df.columns, target)
    ]
    df.select(*columns).write.mode("overwrite").insertInto(table)


def write_directory(df: DataFrame, path: str, sep: str = ",", null: str = NULL) -> None:
    """Replace a directory by delimited text, values as they are, without quotes."""
    fields = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null)) for c in df.columns]
    df.select(F.concat_ws(sep, *fields).alias("value")).write.mode("overwrite").text(path)


def load_into(
    spark: SparkSession,
    paths: str | list[str],
    table: str,
    schema: T.StructType,
    sep: str = ",",
    null: str = NULL,
) -> None:
    """Replace the rows of a table by those of text files."""
    insert_overwrite(read_delimited(spark, paths, schema, sep, null), table)
