"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


FAMILY = {
    "TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int", "HUGEINT": "huge",
    "DOUBLE": "float", "FLOAT": "float", "VARCHAR": "string", "BOOLEAN": "bool", "TIMESTAMP": "timestamp",
    "DATE": "date", "byte": "int", "short": "int", "integer": "int", "long": "int", "double": "float",
    "float": "float", "string": "string", "boolean": "bool", "timestamp_ntz": "timestamp", "date": "date",
}


def differences(spark, con, fn, sql: str, sf_dir: str) -> list[str]:
    """What differs between a query and its SQL; empty if nothing does."""
    df = fn(spark, sf_dir)
    got_columns = df.columns
    rel = con.sql(sql)
    problems = []
    if sorted(got_columns) != sorted(rel.columns):
        return [f"columns {sorted(got_columns)} != {sorted(rel.columns)}"]
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for f in df.schema:
        a = FAMILY.get(f.dataType.typeName(), f.dataType.typeName())
        b = FAMILY.get(types[f.name], types[f.name])
        if a != b:
            problems.append(f"type of {f.name}: {a} != {b}")
    got = _rows(got_columns, [tuple(r) for r in df.collect()])
    want = _rows(rel.columns, rel.fetchall())
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    if diff:
        problems.append(f"{len(diff)} rows differ, first: {diff[0]}")
    if not want:
        problems.append("no rows to compare")
    return problems
