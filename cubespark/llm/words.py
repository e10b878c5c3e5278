"""Words and word shingles as DataFrame expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
SPACES = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs without ASCII white space; null and empty give none."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    trimmed = F.trim(lower, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\x09-\\x0D]+"))


def shingles(text: Column, name, n: int = SHINGLE_WORDS) -> Column:
    """One value per run of n words, or for all words if there are fewer; none without words.

    ``name`` makes the value of a list of words. The list is bound to a lambda's variable,
    else a text would be split again for each run.
    """

    def of(w: Column) -> Column:
        size = F.size(w)
        runs = F.transform(F.sequence(F.lit(0), size - n), lambda i: name([F.get(w, i + k) for k in range(n)]))
        short = F.array(name([F.get(w, F.lit(k)) for k in range(n)]))
        return F.when(size >= n, runs).when(size > 0, short).otherwise(F.array().cast(_kind(name)))

    return F.get(F.transform(F.array(words(text)), of), F.lit(0))


def hashed(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def spelled(parts: list[Column]) -> Column:
    return F.concat_ws(" ", *parts)


def _kind(name) -> str:
    return "array<bigint>" if name is hashed else "array<string>"
