"""Cube analytics on Spark: declare cubes, facts and dimensions, get DataFrames."""

from cubespark.model import (
    Attr,
    Cube,
    Dim,
    DimStorage,
    DimTable,
    Expr,
    Fact,
    FactStorage,
    Measure,
    Model,
    Ref,
)
from cubespark.operators.query import CubeError, Query, union_all
from cubespark.plans.periods import UpdatePeriod

__all__ = [
    "Attr",
    "Cube",
    "CubeError",
    "Dim",
    "DimStorage",
    "DimTable",
    "Expr",
    "Fact",
    "FactStorage",
    "Measure",
    "Model",
    "Query",
    "Ref",
    "UpdatePeriod",
    "union_all",
]
