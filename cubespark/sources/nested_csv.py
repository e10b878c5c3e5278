"""CSV whose fields may hold arrays, maps, structs and unions as text.

Maps are modelled as arrays of ``struct<key, value>``: they keep their order
and may hold a null key. A union is a struct whose first field is ``tag``,
followed by one field per branch, marked by field metadata ``{"union": true}``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubespark.sources.text import cast_text, literal_regex


@dataclass(frozen=True)
class CsvOptions:
    # The format's defaults.
    sep: str = ","
    quote: str = '"'
    escape: str = '"'
    null: str = "NULL"
    item: str = ","
    field: str = ":"
    tag: str = ":"
    pair: str = "="


def _is_union(metadata: dict) -> bool:
    return bool(metadata.get("union"))


def _tokens(col: Column, sep: str) -> Column:
    return F.filter(F.split(col, literal_regex(sep)), lambda t: t != "")


def _parse(
    col: Column, kind: T.DataType, o: CsvOptions, metadata: dict, nulls_read: bool = False
) -> Column:
    if not nulls_read:
        col = F.nullif(col, F.lit(o.null))
    if isinstance(kind, T.ArrayType):
        pair = kind.elementType
        if isinstance(pair, T.StructType) and pair.fieldNames() == ["key", "value"]:
            return _parse_pairs(col, pair["key"].dataType, pair["value"].dataType, o)
        return F.transform(_tokens(col, o.item), lambda t: _parse(t, pair, o, {}))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(_parse_pairs(col, kind.keyType, kind.valueType, o))
    if isinstance(kind, T.StructType) and _is_union(metadata):
        tag = F.split(col, literal_regex(o.tag), 2)
        number, rest = F.get(tag, F.lit(0)).try_cast("int"), F.get(tag, F.lit(1))
        branches = [
            F.when(number == i, _parse(rest, f.dataType, o, f.metadata)).alias(f.name)
            for i, f in enumerate(kind.fields[1:])
        ]
        return F.when(col.isNotNull(), F.struct(number.alias(kind.fields[0].name), *branches))
    if isinstance(kind, T.StructType):
        parts = _tokens(col, o.field)
        fields = [
            _parse(F.get(parts, F.lit(i)), f.dataType, o, f.metadata).alias(f.name)
            for i, f in enumerate(kind)
        ]
        return F.when(col.isNotNull(), F.struct(*fields))
    return cast_text(col, kind)


def _parse_pairs(col: Column, key: T.DataType, value: T.DataType, o: CsvOptions) -> Column:
    def entry(token: Column) -> Column:
        sides = F.split(token, literal_regex(o.pair))
        return F.struct(
            _parse(F.get(sides, F.lit(0)), key, o, {}).alias("key"),
            _parse(F.get(sides, F.lit(1)), value, o, {}).alias("value"),
        )

    return F.transform(_tokens(col, o.item), entry)


def parse_nested_csv(
    df: DataFrame,
    schema: T.StructType,
    options: CsvOptions = CsvOptions(),
    column: str = "value",
) -> DataFrame:
    """Lines of CSV to typed columns; a field that is the null word is null, quoted or not."""
    o = options
    raw = F.from_csv(
        F.col(column),
        ", ".join(f"c{i} string" for i in range(len(schema.fields))),
        {"sep": o.sep, "quote": o.quote, "escape": o.escape, "nullValue": o.null},
    )
    return df.select(raw.alias("_raw")).select(
        *[
            # the CSV parser has read the null word of whole fields
            _parse(F.col(f"_raw.c{i}"), f.dataType, o, f.metadata, True).alias(
                f.name, metadata=f.metadata
            )
            for i, f in enumerate(schema)
        ]
    )


def _format(col: Column, kind: T.DataType, o: CsvOptions, metadata: dict) -> Column:
    null = F.lit(o.null)
    if isinstance(kind, T.ArrayType):
        pair = kind.elementType
        if isinstance(pair, T.StructType) and pair.fieldNames() == ["key", "value"]:
            text = lambda e: F.concat(
                _format(e["key"], pair["key"].dataType, o, {}),
                F.lit(o.pair),
                _format(e["value"], pair["value"].dataType, o, {}),
            )
        else:
            text = lambda e: _format(e, pair, o, {})
        return F.coalesce(F.array_join(F.transform(col, text), o.item), null)
    if isinstance(kind, T.MapType):
        entries = F.transform(
            F.map_entries(col),
            lambda e: F.concat(
                _format(e["key"], kind.keyType, o, {}),
                F.lit(o.pair),
                _format(e["value"], kind.valueType, o, {}),
            ),
        )
        return F.coalesce(F.array_join(entries, o.item), null)
    if isinstance(kind, T.StructType) and _is_union(metadata):
        tag = col[kind.fields[0].name]
        value = null
        for i, f in enumerate(kind.fields[1:]):
            value = F.when(tag == i, _format(col[f.name], f.dataType, o, f.metadata)).otherwise(value)
        return F.coalesce(F.concat(tag.cast("string"), F.lit(o.tag), value), null)
    if isinstance(kind, T.StructType):
        parts = [_format(col[f.name], f.dataType, o, f.metadata) for f in kind]
        return F.when(col.isNull(), null).otherwise(F.concat_ws(o.field, *parts))
    return F.coalesce(col.cast("string"), null)


def nested_csv_fields(df: DataFrame, options: CsvOptions = CsvOptions()) -> list[Column]:
    """Every column as its field text, not quoted yet."""
    return [_format(F.col(f"`{f.name}`"), f.dataType, options, f.metadata) for f in df.schema]


def quoted(col: Column, o: CsvOptions) -> Column:
    """Quote a field, escaping quotes and escape characters in it."""
    for ch in dict.fromkeys([o.escape, o.quote]):
        col = F.replace(col, F.lit(ch), F.lit(o.escape + ch))
    return F.concat(F.lit(o.quote), col, F.lit(o.quote))


def to_nested_csv(df: DataFrame, options: CsvOptions = CsvOptions()) -> DataFrame:
    """Rows as CSV lines, every field quoted, null as the null word."""
    fields = [quoted(f, options) for f in nested_csv_fields(df, options)]
    return df.select(F.concat_ws(options.sep, *fields).alias("value"))
