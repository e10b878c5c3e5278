"""JSON documents, one per row, to declared columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubespark.sources.text import cast_text


def _field(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(text, kind)
    if isinstance(kind, T.StringType):
        return F.replace(text, F.lit("\n"), F.lit("\\n"))
    return cast_text(text, kind)


def parse_json_rows(
    df: DataFrame, schema: T.StructType, column: str = "value", mode: str = "FAILFAST"
) -> DataFrame:
    """Top-level keys match in any case; a missing or badly typed field is null.

    A text that is no JSON document is an error, or a row of nulls in mode
    ``PERMISSIVE``. Line breaks in strings come out as ``\\n`` in two characters.
    """
    document = F.from_json(F.col(column), "map<string,string>", {"mode": mode})
    parsed = df.select(document.alias("_document")).select(
        # the last of several keys that differ in case only comes first
        F.reverse(F.transform(F.map_keys("_document"), F.lower)).alias("_keys"),
        F.reverse(F.map_values("_document")).alias("_values"),
    )

    def named(name: str) -> Column:
        return F.get("_values", F.array_position("_keys", name.lower()) - 1)

    return parsed.select(*[_field(named(f.name), f.dataType).alias(f.name) for f in schema])
