"""The sample cube: two rolled-up facts, a raw one, and chained dimensions, as text files."""

from __future__ import annotations

import os

from pyspark.sql.types import StructType

from cubespark import Attr, Cube, Dim, DimStorage, Expr, Fact, FactStorage, Measure, Model, Ref
from cubespark.plans.partitions import manifest_rows, scan_partitions
from cubespark.plans.periods import UpdatePeriod, parse_instant
from cubespark.sources.text import read_delimited

HOURLY, DAILY, MONTHLY = UpdatePeriod.HOURLY, UpdatePeriod.DAILY, UpdatePeriod.MONTHLY
I = range(1, 9)

# Names, rows and partitions of the sample cube.
CUBE = Cube(
    "sample_cube",
    measures=(
        Measure("measure1", "bigint"),
        Measure("measure2", "int", "sum"),
        Measure("measure3", "float", "max", start=parse_instant("2013-12-12")),
        Measure("measure4", "double", "min"),
    ),
    attrs=(
        Attr("dim1", "int"),
        Attr("dim2", "int", start=parse_instant("2013-12-01")),
        Attr("dim3", "int", (Ref("sample_dim", "id"),)),
    ),
    exprs=(Expr("measure5", "double", "measure3 + measure4"),),
    timed=("dt",),
)

# name: (columns, weight, aggregated, {(period, dt): rows})
FACTS = {
    "fact1": (
        "dim1 int, measure2 bigint, measure3 int, measure4 float",
        100,
        True,
        {
            ("HOURLY", "2014-06-24-23"): [(20 + i, 100 * i, 100 * i, 100 * i) for i in I],
            ("DAILY", "2014-06-25"): [(20 + i, 2400 * i, 100 * i, 100 * i) for i in I],
            ("HOURLY", "2014-06-26-00"): [(20 + i, 100 * i, 100 * i, 100 * i) for i in I],
        },
    ),
    "fact2": (
        "dim1 int, dim3 int, measure2 int, measure3 float, measure4 float",
        200,
        True,
        {
            ("HOURLY", "2014-06-24-23"): [(20 + i, i, 100 * i, 100 * i, 100 * i) for i in I],
            ("DAILY", "2014-06-25"): [(20 + i, i, 2400 * i, 100 * i, 100 * i) for i in I],
            ("HOURLY", "2014-06-26-00"): [(20 + i, i, 100 * i, 100 * i, 100 * i) for i in I],
        },
    ),
    "rawfact": (
        "dim1 int, dim2 int, dim3 int, measure1 bigint, measure2 int, measure3 float, measure4 float",
        500,
        False,
        {
            ("HOURLY", dt): [(20 + i, 10 + i, i, 100 * i, 100 * i, 100 * i, 100 * i) for i in I]
            for dt in (
                "2014-06-25-20", "2014-06-25-21", "2014-06-25-22", "2014-06-25-23",
                "2014-06-26-00", "2014-06-26-01",
            )
        },
    ),
}

NAMES1 = ["first", "second", "third", "fourth", "fifth", "six", "seven", "eight"]
NAMES2 = ["eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "ninteen"]
DIM1 = [
    (i if i < 8 else None, NAMES1[i - 1], f"this is {i}", None if i == 7 else 10 + i)
    for i in I
]
DIM2 = [(10 + i if i < 9 else None, NAMES2[i - 1], f"details {i}") for i in range(1, 10)]


def _text(rows) -> str:
    return "".join(",".join(r"\N" if v is None else str(v) for v in row) + "\n" for row in rows)


def build(spark, root) -> Model:
    """Write the files below ``root`` and return the model over them."""
    manifest, facts = [], []
    for name, (ddl, weight, aggregated, parts) in FACTS.items():
        schema = StructType.fromDDL(ddl)
        for n, ((period, dt), rows) in enumerate(parts.items()):
            folder = os.path.join(str(root), f"{name}-part{n}")
            os.makedirs(folder)
            with open(os.path.join(folder, "data.txt"), "w") as f:
                f.write(_text(rows))
            manifest.append((name, "local", period, dt, folder, "text"))

        def open_parts(s, rows, schema=schema):
            readers = {"text": lambda s, paths, sch: read_delimited(s, paths, sch)}
            return scan_partitions(s, rows, schema, readers)

        periods = (HOURLY, DAILY, MONTHLY) if aggregated else (HOURLY,)
        storage = FactStorage("local", lambda s: None, periods, schema=schema, open_parts=open_parts)
        columns = tuple(schema.fieldNames())
        facts.append(Fact(name, "sample_cube", columns, (storage,), weight, aggregated))

    def dim_storage(name, ddl, rows):
        path = os.path.join(str(root), f"{name}.txt")
        with open(path, "w") as f:
            f.write(_text(rows))
        return DimStorage("local", lambda s: read_delimited(s, path, StructType.fromDDL(ddl)))

    dims = (
        Dim(
            "sample_dim",
            (
                Attr("id", "int"),
                Attr("name"),
                Attr("detail"),
                Attr("d2id", "int", (Ref("sample_dim2", "id"),)),
            ),
            (dim_storage("dim1", "id int, name string, detail string, d2id int", DIM1),),
        ),
        Dim(
            "sample_dim2",
            (Attr("id", "int"), Attr("name"), Attr("detail2")),
            (dim_storage("dim2", "id int, name string, detail2 string", DIM2),),
        ),
    )

    def read_manifest(s):
        return manifest_rows(
            s.createDataFrame(
                manifest,
                "table string, storage string, period string, dt string, location string, format string",
            )
        )

    return Model((CUBE,), tuple(facts), dims, read_manifest)
