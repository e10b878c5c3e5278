"""Delimited and whitespace-separated text, with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Separators of the Hive text format and its word for null.
FIELD, ITEM, KEY = "\x01", "\x02", "\x03"
NULL = r"\N"


def literal_regex(text: str) -> str:
    """Pattern that matches a text literally; one character needs no regex machine to split."""
    if len(text) == 1 and not text.isalnum():
        return "\\" + text if text in ".$|()[{^?*+\\" else text
    return "\\Q" + text + "\\E"


def cast_text(col: Column, to: T.DataType) -> Column:
    """Text to a declared type; what does not parse is null. ``char`` pads, ``varchar`` cuts."""
    if isinstance(to, T.CharType):
        return F.rpad(col, to.length, " ")
    if isinstance(to, T.VarcharType):
        return F.substring(col, 1, to.length)
    if isinstance(to, T.StringType):
        return col
    return F.nullif(col, F.lit("")).try_cast(to)  # a null is cheaper than a failing cast


def read_delimited(
    spark: SparkSession,
    paths: str | list[str],
    schema: T.StructType,
    sep: str = ",",
    null: str = NULL,
) -> DataFrame:
    """Rows of unquoted fields. An empty field is an empty string, or null for other types."""
    fields = F.split("value", literal_regex(sep), -1)
    columns = []
    for i, f in enumerate(schema):
        raw = F.get(fields, F.lit(i))
        columns.append(cast_text(F.nullif(raw, F.lit(null)), f.dataType).alias(f.name))
    return spark.read.text(paths).select(*columns)


def parse_tokens(df: DataFrame, names: list[str], column: str = "value") -> DataFrame:
    """Fields separated by runs of blanks and tabs, untyped."""
    tokens = F.split(F.trim(F.regexp_replace(column, r"\s+", " ")), " ")
    return df.select(*[F.get(tokens, F.lit(i)).alias(n) for i, n in enumerate(names)])


def _hive_value(col: Column, kind: T.DataType, padded: bool = True) -> Column:
    if isinstance(kind, T.CharType) and padded:
        col = F.rpad(col, kind.length, " ")
    return F.coalesce(col.cast("string"), F.lit(NULL))


def hive_text_column(col: Column, kind: T.DataType) -> Column:
    """One field in Hive text format; maps may come as arrays of key-value structs."""
    if isinstance(kind, T.StructType):
        parts = [_hive_value(col[f.name], f.dataType) for f in kind]
        return F.when(col.isNull(), NULL).otherwise(F.concat_ws(ITEM, *parts))
    if isinstance(kind, T.ArrayType):
        pair = kind.elementType
        if isinstance(pair, T.StructType) and pair.fieldNames() == ["key", "value"]:
            items = F.transform(
                col,
                lambda e: F.concat_ws(
                    KEY, *[_hive_value(e[f.name], f.dataType) for f in pair]
                ),
            )
        else:
            items = F.transform(col, lambda e: _hive_value(e, pair))
        return F.coalesce(F.array_join(items, ITEM), F.lit(NULL))
    if isinstance(kind, T.MapType):
        items = F.transform(
            F.map_entries(col),
            lambda e: F.concat_ws(
                KEY, _hive_value(e.key, kind.keyType), _hive_value(e.value, kind.valueType)
            ),
        )
        return F.coalesce(F.array_join(items, ITEM), F.lit(NULL))
    return _hive_value(col, kind)


def to_hive_text(df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Rows as lines of Hive text. ``schema`` may declare ``char(n)`` columns to pad."""
    kinds = schema or df.schema
    line = F.concat_ws(FIELD, *[hive_text_column(F.col(f"`{f.name}`"), f.dataType) for f in kinds])
    return df.select(line.alias("value"))
