"""The cube model: plain declarations, no I/O.

Storages carry a ``read`` callable, so that a table may be anything Spark can
read (files, catalog tables, a database). Names compare without regard to case.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from cubespark.plans.periods import UpdatePeriod

Reader = Callable[[SparkSession], DataFrame]


class CubeError(ValueError):
    """A query that the model cannot answer."""


@dataclass(frozen=True)
class Ref:
    """Target of a foreign key: a column of a dimension.

    ``role`` is a further name of the dimension as reached by this key, so that one query
    can join it several times.
    """

    table: str
    column: str
    role: str | None = None


@dataclass(frozen=True)
class Measure:
    name: str
    type: str = "double"
    aggr: str | None = None
    start: datetime | None = None
    end: datetime | None = None
    format: str | None = None
    unit: str | None = None
    cost: float | None = None


@dataclass(frozen=True)
class Attr:
    name: str
    type: str = "string"
    refs: tuple[Ref, ...] = ()
    start: datetime | None = None
    end: datetime | None = None
    cost: float | None = None


@dataclass(frozen=True)
class Expr:
    """Column given by SQL text over other columns of the same table."""

    name: str
    type: str
    text: str


def _named(items, name: str):
    return next((i for i in items if i.name.lower() == name.lower()), None)


@dataclass(frozen=True)
class Cube:
    name: str
    measures: tuple[Measure, ...]
    attrs: tuple[Attr, ...]
    exprs: tuple[Expr, ...] = ()
    timed: tuple[str, ...] = ()
    parent: str | None = None
    properties: Mapping[str, str] = field(default_factory=dict)

    def field(self, name: str) -> Measure | Attr | Expr | None:
        return _named(self.exprs + self.measures + self.attrs, name)

    def derive(self, name: str, measures: list[str], attrs: list[str]) -> Cube:
        """Cube over a subset of names; definitions stay those of this cube."""
        ms = tuple(_named(self.measures, m) for m in measures)
        ats = tuple(_named(self.attrs, a) for a in attrs)
        if None in ms + ats:
            raise CubeError(f"derived cube {name}: a name is not in cube {self.name}")
        return replace(
            self, name=name, measures=ms, attrs=ats, exprs=(), parent=self.parent or self.name
        )

    @property
    def base_name(self) -> str:
        return (self.parent or self.name).lower()


@dataclass(frozen=True)
class FactStorage:
    """One physical table of a fact.

    ``partitioned`` tables have string columns ``update_period`` and ``dt``;
    others are filtered on the fact's time column. With a ``base`` folder and a
    ``schema``, only the folders of the chosen partitions are listed and read
    (their locations come from the manifest), never the whole table. Partitions
    that lie anywhere are opened by ``open_parts(spark, manifest rows)``.

    ``dt`` belongs to the cube's first range. ``others`` says of further timed dimensions in
    which partition column, and at which period, their values are kept.
    """

    storage: str
    read: Reader
    periods: tuple[UpdatePeriod, ...]
    partitioned: bool = True
    base: str | None = None
    schema: StructType | None = None
    open_parts: Callable[[SparkSession, list], DataFrame] | None = None
    others: Mapping[str, tuple[str, UpdatePeriod]] = field(default_factory=dict)


@dataclass(frozen=True)
class Fact:
    """A table of a cube's measures. Aggregated ones hold what ``operators.rollup`` writes: counts
    as numbers to add up, averages as a struct of sum and count."""

    name: str
    cube: str
    columns: tuple[str, ...]
    storages: tuple[FactStorage, ...]
    weight: float = 0.0
    aggregated: bool = True
    time_column: str | None = None
    exprs: Mapping[str, str] = field(default_factory=dict)

    def has(self, names: set[str]) -> bool:
        return names <= {c.lower() for c in self.columns}


@dataclass(frozen=True)
class DimStorage:
    """One physical table of a dimension; with a period it keeps dumps in column ``dt``."""

    storage: str
    read: Reader
    period: UpdatePeriod | None = None


@dataclass(frozen=True)
class DimTable:
    """Some columns of a dimension, its key among them, kept by themselves."""

    name: str
    columns: tuple[str, ...]
    storages: tuple[DimStorage, ...]
    weight: float = 0.0

    def has(self, names: set[str]) -> bool:
        return names <= {c.lower() for c in self.columns}


@dataclass(frozen=True)
class Dim:
    """A dimension in one table, its ``storages``, or in several ``tables`` of different columns."""

    name: str
    attrs: tuple[Attr, ...]
    storages: tuple[DimStorage, ...] = ()
    exprs: tuple[Expr, ...] = ()
    weight: float = 0.0
    tables: tuple[DimTable, ...] = ()

    def field(self, name: str) -> Attr | Expr | None:
        return _named(self.exprs + self.attrs, name)

    def choices(self) -> list[DimTable]:
        """Its tables, lightest first."""
        own = DimTable(self.name, tuple(a.name for a in self.attrs), self.storages, self.weight)
        return sorted(self.tables + ((own,) if self.storages else ()), key=lambda t: (t.weight, t.name))


@dataclass(frozen=True)
class Model:
    """Cubes, facts and dimensions, plus the manifest of fact partitions."""

    cubes: tuple[Cube, ...] = ()
    facts: tuple[Fact, ...] = ()
    dims: tuple[Dim, ...] = ()
    manifest: Reader | None = None

    def table(self, name: str) -> Cube | Dim:
        found = _named(self.cubes + self.dims, name)
        if found is None:
            raise CubeError(f"unknown cube or dimension: {name}")
        return found

    def dim(self, name: str) -> Dim | None:
        return _named(self.dims, name)

    def role(self, name: str) -> tuple[str, Attr, Ref] | None:
        """Table, attribute and reference that give a dimension this name."""
        found = [
            (t.name.lower(), attr, ref)
            for t in self.cubes + self.dims
            for attr in t.attrs
            for ref in attr.refs
            if (ref.role or "").lower() == name.lower()
        ]
        if len({(owner, attr.name) for owner, attr, _ in found}) > 1:
            raise CubeError(f"several references are called {name}")
        return found[0] if found else None

    def facts_of(self, cube: Cube) -> list[Fact]:
        return [f for f in self.facts if f.cube.lower() == cube.base_name]

    def path(self, source: str, target: str, via: str | None = None) -> list[tuple]:
        """Shortest chain of references ``(table, column, dim, key)`` between two tables.

        Several shortest chains are an error unless ``via`` names a dimension
        that only one of them passes.
        """
        goal, level, found, seen = target.lower(), [(source.lower(), [])], [], {source.lower()}
        while level and not found:
            following = []
            for name, steps in level:
                for attr in self.table(name).attrs:
                    for ref in attr.refs:
                        table = ref.table.lower()
                        if table in seen:
                            continue
                        step = steps + [(name, attr.name, table, ref.column)]
                        passes = via is None or via.lower() in {s[2] for s in step}
                        if table == goal and passes:
                            found.append(step)
                        elif table != goal:
                            following.append((table, step))
            seen |= {name for name, _ in following}
            level = following
        if not found:
            raise CubeError(f"no reference path from {source} to {target}")
        if len(found) > 1:
            raise CubeError(f"several reference paths from {source} to {target}: name one by via")
        return found[0]
