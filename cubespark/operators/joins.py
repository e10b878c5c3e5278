"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubespark.model import CubeError

# Join words and Spark's names for them.
JOIN_TYPES = {
    "inner": "inner",
    "left": "left",
    "left outer": "left",
    "right": "right",
    "right outer": "right",
    "full": "full",
    "full outer": "full",
    "semi": "left_semi",
    "left semi": "left_semi",
    "left_semi": "left_semi",
}


def join_type(word: str) -> str:
    try:
        return JOIN_TYPES[word.lower()]
    except KeyError:
        raise CubeError(f"unknown join type: {word}") from None


def outer_join(
    left: DataFrame,
    right: DataFrame,
    on: Column,
    how: str,
    left_columns: list[str],
    skewed: bool = False,
) -> DataFrame:
    """A join of rows; with ``skewed``, right and full joins in two parts.

    The parts are a join of the left side, and the unmatched right rows.

    Spark can split a hot key of an inner or left join over many tasks at run
    time, but not that of a full join. Unmatched rows are found against the
    distinct ``left_columns``, all that ``on`` uses of the left side, so a hot
    key shrinks to one row before it moves; the left side is read twice for it, so
    nested joins should not do this. Column names of the sides differ.
    """
    if how not in ("right", "full") or not skewed:
        return left.join(right, on, how)
    matched = left.join(right, on, "inner" if how == "right" else "left")
    alone = right.join(left.select(*left_columns).distinct(), on, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def unique_join(inputs: list[DataFrame], key: str, how: str = "full") -> DataFrame:
    """Several inputs merged on one key column that each of them has.

    ``full`` keeps every key, ``inner`` only those that all inputs have.
    """
    if how == "inner":
        return reduce(lambda a, b: a.join(b, key, "inner"), inputs)
    if how != "full":
        raise CubeError(f"unique join is full or inner, not {how}")

    # keys are unique, so none is hot; each input is read once
    return reduce(lambda a, b: a.join(b, key, "full"), inputs)
