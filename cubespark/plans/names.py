"""Column names in expression text.

Spark parses expressions; this only finds the names in them, to learn which
columns of the model a query touches and to replace them by internal names.
"""

from __future__ import annotations

import re
from collections.abc import Callable

# quoted text | a name with an optional qualifier, not part of a number
_WORD = re.compile(
    r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|(?<![\w.])[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?"""
)
# The first five merge from partial results; the others need all rows.
MERGING = ("sum", "min", "max", "avg", "count")
AGGREGATES = MERGING + tuple(
    "mean stddev stddev_samp stddev_pop std variance var_samp var_pop skewness kurtosis corr covar_pop covar_samp "
    "collect_list collect_set array_agg approx_count_distinct count_if percentile percentile_approx approx_percentile "
    "median mode first last any_value max_by min_by bool_and bool_or every bit_and bit_or bit_xor "
    "regr_slope regr_intercept regr_r2 regr_count listagg string_agg".split()
)
_FILTER = re.compile(r"\s*filter\s*\(\s*where\b", re.IGNORECASE)
_CALL = re.compile(r"(?<![\w.])(%s)\s*\(" % "|".join(AGGREGATES), re.IGNORECASE)


def map_names(text: str, replace: Callable[[str], str | None]) -> str:
    """Text with each column name replaced; ``None`` leaves it as it is."""

    def swap(match: re.Match) -> str:
        word = match.group(0)
        rest = text[match.end() :].lstrip()
        if word[0] in "'\"`" or rest.startswith("("):
            return word
        return replace(word) or word

    return _WORD.sub(swap, text)


def _closing(text: str, at: int) -> int:
    """Index of the parenthesis that closes the one at ``at``; quoted text is skipped."""
    depth, quote, i = 0, None, at
    while i < len(text):
        ch = text[i]
        if quote:
            if ch == "\\":
                i += 1
            elif ch == quote:
                quote = None
        elif ch in "'\"`":
            quote = ch
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
            if depth == 0:
                return i
        i += 1
    raise ValueError(f"unbalanced parentheses: {text}")


def lift_aggregates(text: str, lift: Callable[..., str]) -> str:
    """Text with each aggregate call replaced by ``lift(function, distinct, argument)``.

    The condition of a ``filter (where ...)`` is a fourth argument.
    """
    out, at = [], 0
    quoted = [m.span() for m in _WORD.finditer(text) if m.group(0)[0] in "'\"`"]
    for match in _CALL.finditer(text):
        start = match.start()
        if start < at or any(a <= start < b for a, b in quoted):
            continue
        close = _closing(text, match.end() - 1)
        arg = text[match.end() : close].strip()
        distinct = re.match(r"distinct\b", arg, re.IGNORECASE)
        if distinct:
            arg = arg[distinct.end() :].strip()
        condition = None
        if kept := _FILTER.match(text, close + 1):
            end = _closing(text, text.index("(", close + 1))
            condition, close = text[kept.end() : end].strip(), end
        call = (match.group(1).lower(), bool(distinct), arg)
        out += [text[at:start], lift(*call) if condition is None else lift(*call, condition)]
        at = close + 1
    return "".join(out) + text[at:]
