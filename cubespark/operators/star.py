"""Star joins over plain DataFrames: fact reduction and aggregation below the joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubespark.model import CubeError


def reduce_fact(
    fact: DataFrame, filtered: list[tuple[DataFrame, str, str, str | Column]]
) -> DataFrame:
    """Keep fact rows whose key is in each filtered dimension.

    ``filtered`` lists (dimension, fact key, dimension key, condition). Only
    valid for dimensions that are inner joined later on.
    """
    for i, (dim, fk, pk, condition) in enumerate(filtered):
        keys = dim.filter(condition).select(F.col(pk).alias(f"_reduce{i}"))
        fact = fact.join(keys, F.col(fk) == F.col(f"_reduce{i}"), "left_semi")
    return fact


def partials(fn: str, arg: str, label: str) -> list[Column]:
    """What a part keeps of an aggregate, so that parts can be merged."""
    if fn == "avg":
        return [F.expr(f"sum({arg})").alias(f"{label}_sum"), F.expr(f"count({arg})").alias(f"{label}_n")]
    if fn in ("sum", "min", "max", "count"):
        return [F.expr(f"{fn}({arg})").alias(f"{label}_part")]
    raise CubeError(f"{fn} does not merge: aggregate above the joins instead")


def merged(fn: str, label: str) -> Column:
    """The aggregate from its parts: counts add up, an average is sum over count."""
    if fn == "avg":
        return F.try_divide(F.sum(f"{label}_sum"), F.sum(f"{label}_n"))
    if fn == "count":
        return F.coalesce(F.sum(f"{label}_part"), F.lit(0))
    return F.expr(f"{fn}({label}_part)")


def eager_agg(
    fact: DataFrame,
    dims: list[tuple[DataFrame, list[tuple[str, str]]]],
    keys: list[str],
    aggs: list[tuple[str, str, str]],
    fact_keys: list[str] = (),
) -> DataFrame:
    """Aggregate the fact by its join keys, join the dimensions, aggregate again.

    ``dims`` lists (dimension, [(fact key, dimension key)]); ``aggs`` lists
    (function, fact expression, alias); ``fact_keys`` are fact columns among
    ``keys``. Averages travel as sum and count, counts are summed, so the
    result equals that of one aggregation above the joins.
    """
    partial = [c for i, (fn, arg, _) in enumerate(aggs) for c in partials(fn, arg, f"_p{i}")]
    final = [merged(fn, f"_p{i}").alias(alias) for i, (fn, _, alias) in enumerate(aggs)]
    joined_by = [fk for _, pairs in dims for fk, _ in pairs]
    df = fact.groupBy(*dict.fromkeys([*joined_by, *fact_keys])).agg(*partial)
    for dim, pairs in dims:
        on = [F.col(fk) == F.col(pk) for fk, pk in pairs]
        df = df.join(dim, on, "inner")
    return df.groupBy(*keys).agg(*final)
