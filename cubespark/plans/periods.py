"""Update periods and instants.

A period is a calendar unit at which a table receives partitions. Instants are
written ``yyyy-MM-dd-HH:mm:ss,SSS`` or any shorter prefix of it.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class UpdatePeriod(Enum):
    """Rank, truncation unit, SQL interval, ``dt`` pattern (Spark), pattern (Python)."""

    SECONDLY = (0, "second", "interval 1 second", "yyyy-MM-dd-HH-mm-ss", "%Y-%m-%d-%H-%M-%S")
    MINUTELY = (1, "minute", "interval 1 minute", "yyyy-MM-dd-HH-mm", "%Y-%m-%d-%H-%M")
    HOURLY = (2, "hour", "interval 1 hour", "yyyy-MM-dd-HH", "%Y-%m-%d-%H")
    DAILY = (3, "day", "interval 1 day", "yyyy-MM-dd", "%Y-%m-%d")
    WEEKLY = (4, "week", "interval 7 days", "yyyy-MM-dd", "%Y-%m-%d")
    MONTHLY = (5, "month", "interval 1 month", "yyyy-MM", "%Y-%m")
    QUARTERLY = (6, "quarter", "interval 3 months", "yyyy-MM", "%Y-%m")
    YEARLY = (7, "year", "interval 1 year", "yyyy", "%Y")

    @property
    def rank(self) -> int:
        return self.value[0]

    @property
    def unit(self) -> str:
        return self.value[1]

    @property
    def interval(self) -> str:
        return self.value[2]

    @property
    def pattern(self) -> str:
        return self.value[3]

    @property
    def py_pattern(self) -> str:
        return self.value[4]

    @classmethod
    def of(cls, name: str | UpdatePeriod) -> UpdatePeriod:
        """Period by name in any case."""
        return name if isinstance(name, cls) else cls[name.upper()]

    def truncate(self, instant: Column) -> Column:
        """Start of the period an instant lies in, as a zone-less timestamp.

        No step goes through a zoned timestamp, so hours that clock changes skip or
        repeat are hours like others.
        """
        at = instant.cast("timestamp_ntz")
        if self.rank >= UpdatePeriod.DAILY.rank:
            day = at.cast("date")
            return (day if self is UpdatePeriod.DAILY else F.trunc(day, self.unit)).cast("timestamp_ntz")
        zero = F.lit(0)
        minute = zero if self is UpdatePeriod.HOURLY else F.minute(at)
        second = F.second(at) if self is UpdatePeriod.SECONDLY else zero
        return F.make_timestamp_ntz(F.year(at), F.month(at), F.day(at), F.hour(at), minute, second)

    def shift(self, instant: Column, n: int = 1) -> Column:
        return instant + F.expr(self.interval) * F.lit(n)

    def label(self, start: Column) -> Column:
        """The ``dt`` partition value of the period that begins at ``start``."""
        text = start.cast("timestamp_ntz").cast("string")
        return F.translate(F.substring(text, 1, len(self.pattern)), " :", "--")


def floor_instant(at: datetime, period: UpdatePeriod) -> datetime:
    """Start of the period that an instant lies in."""
    if period is UpdatePeriod.WEEKLY:
        at = at - timedelta(days=at.weekday())
    units = ("year", "month", "day", "hour", "minute", "second")
    # How many of the units a start may have.
    kept = {"second": 6, "minute": 5, "hour": 4, "day": 3, "week": 3, "month": 2, "quarter": 2, "year": 1}[period.unit]
    values = [getattr(at, u) for u in units[:kept]] + [1, 1, 1, 0, 0, 0][kept:]
    if period is UpdatePeriod.QUARTERLY:
        values[1] = values[1] - (values[1] - 1) % 3
    return datetime(*values)


def shift_instant(at: datetime, period: UpdatePeriod, n: int = 1) -> datetime:
    """An instant some periods on; days that a month lacks become its last one."""
    months = {"month": 1, "quarter": 3, "year": 12}.get(period.unit)
    if months is None:
        seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[period.unit]
        return at + timedelta(seconds=seconds * n)
    year, month = divmod(at.year * 12 + at.month - 1 + months * n, 12)
    first = datetime(year, month + 1, 1)
    days = (datetime(year + month // 11, (month + 1) % 12 + 1, 1) - first).days
    return at.replace(year=year, month=month + 1, day=min(at.day, days))


def ceil_instant(at: datetime, period: UpdatePeriod) -> datetime:
    """The next start of a period that is not before an instant."""
    start = floor_instant(at, period)
    return start if start == at else shift_instant(start, period)


# The accepted patterns of an instant, shortest first.
INSTANT_PATTERNS = {
    4: "%Y",
    7: "%Y-%m",
    10: "%Y-%m-%d",
    13: "%Y-%m-%d-%H",
    16: "%Y-%m-%d-%H:%M",
    19: "%Y-%m-%d-%H:%M:%S",
    23: "%Y-%m-%d-%H:%M:%S,%f",
}


def parse_instant(text: str | datetime) -> datetime:
    if isinstance(text, datetime):
        return text
    text = text.strip()
    pattern = INSTANT_PATTERNS.get(len(text))
    if pattern is None:
        raise ValueError(f"not an instant (yyyy-MM-dd-HH:mm:ss,SSS or a prefix): {text!r}")
    return datetime.strptime(text, pattern)


def instant_sql(value: str | datetime) -> str:
    """Zone-less timestamp literal as text; does not depend on the driver's time zone."""
    return f"timestamp_ntz'{parse_instant(value).isoformat(sep=' ')}'"


def instant(value: str | datetime) -> Column:
    return F.expr(instant_sql(value))


def parse_label(dt: Column, pattern: str) -> Column:
    """Instant of a ``dt`` value of a period's pattern; null if it is none."""
    digits = "^" + re.sub("[A-Za-z]", r"[0-9]", pattern) + "$"
    # Where the parts of a value begin.
    begins = ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2))
    parts = [
        F.substring(dt, at, n).cast("int") if at <= len(pattern) else F.lit(least)
        for (at, n), least in zip(begins, (1, 1, 1, 0, 0, 0))
    ]
    return F.when(dt.rlike(digits), F.try_make_timestamp_ntz(*parts))


def period_start(period: Column, dt: Column) -> Column:
    """Parse a ``dt`` partition value by the pattern of its period; null if it does not parse."""
    by_pattern: dict[str, list[str]] = {}
    for p in UpdatePeriod:
        by_pattern.setdefault(p.pattern, []).append(p.name)
    return F.coalesce(
        *[F.when(period.isin(names), parse_label(dt, pattern)) for pattern, names in by_pattern.items()]
    )


def period_end(period: Column, start: Column) -> Column:
    return F.coalesce(*[F.when(period == p.name, p.shift(start)) for p in UpdatePeriod])


def time_range(column: str | Column, frm: str | datetime, to: str | datetime) -> Column:
    """Half-open range predicate: ``from`` inclusive, ``to`` exclusive."""
    lower, upper = parse_instant(frm), parse_instant(to)
    if lower >= upper:
        raise ValueError(f"empty time range: {lower} .. {upper}")
    col = F.col(column) if isinstance(column, str) else column
    return (col >= instant(lower)) & (col < instant(upper))
