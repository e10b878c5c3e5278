"""Functions that queries name, beyond those Spark calls by the same name."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def format_number(col: Column | str, places: int | str) -> Column:
    """Number with grouping and ``places`` decimals, or by a decimal pattern."""
    col = F.col(col) if isinstance(col, str) else col
    if isinstance(places, int):
        return F.format_number(col, places)
    return F.call_function("format_number", col, F.lit(places))


def register(
    spark: SparkSession,
    name: str,
    fn: Callable[..., pd.Series],
    returns: str | T.DataType,
) -> None:
    """Make a function on pandas series callable in query text by a name.

    Rows travel in Arrow batches; code files go to ``spark.addArtifacts``.
    """
    spark.udf.register(name, F.pandas_udf(fn, returns))
