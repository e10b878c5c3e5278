"""Which fact and which partitions answer a query.

Only names, weights and partition values are looked at here, never data rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.model import Cube, CubeError, Dim, DimStorage, DimTable, Fact, FactStorage, Model
from cubespark.plans import partitions as P
from cubespark.plans.periods import UpdatePeriod, ceil_instant, floor_instant, instant, shift_instant, time_range


@dataclass(frozen=True)
class QueryConf:
    """Options of a query.

    ``eager``: aggregate the fact by its join keys before the joins. By default
    this is done where the fact has one join key, so that the joins see few rows
    per key and no key is hot; several keys together seldom repeat.

    ``reduce``: keep only fact rows whose keys the filtered dimensions hold, before any
    aggregation or join. By default this is done where the keys are small enough for a
    broadcast by Spark's estimate; beyond that Spark's own Bloom filters do it at run time.

    ``other_ranges``: further time ranges (timed dimension, from, to) that partitions of the
    fact can be chosen by; ``exact_ranges`` asks for facts whose partitions end where they do.
    """

    join_type: str = "inner"
    auto_join: bool = True
    aggregate_default: bool = True
    promote_select: bool = True
    promote_groupby: bool = False
    multi_table: bool = True
    fail_if_partial: bool = False
    lightest_first: bool = False
    max_interval: UpdatePeriod | None = None
    valid_facts: tuple[str, ...] | None = None
    valid_storages: tuple[str, ...] | None = None
    valid_storage_tables: tuple[str, ...] | None = None
    valid_dim_tables: tuple[str, ...] | None = None
    valid_update_periods: Mapping = field(default_factory=dict)
    process_time_col: str | None = None
    lookahead: int | Mapping = 1
    replace_timedim: bool = True
    writer: str = "or"
    partition_format: str | None = None
    validity: str = "reject"
    dim_as_of: str | None = None  # a dump's value, or "range": as of the end of the time range
    via: Mapping[str, str] = field(default_factory=dict)
    eager: bool | None = None
    reduce: bool | None = None
    other_ranges: tuple = ()
    exact_ranges: bool = False


@dataclass(frozen=True)
class Resolution:
    """The chosen fact, its partitions and what is missing."""

    fact: Fact
    storages: tuple[FactStorage, ...]
    chosen: DataFrame | None  # its cover
    parts: list | None  # chosen partitions; None where nothing is partitioned
    covered: float  # seconds
    wanted: float
    until: datetime | None = None  # end of the partitions asked for

    @property
    def complete(self) -> bool:
        return self.covered >= self.wanted


def storage_table(storage: str, table: str) -> str:
    """Physical name of a table on a storage."""
    return f"{storage}_{table}"


def _allowed(conf: QueryConf, storage: str, table: str) -> bool:
    ok = conf.valid_storages is None or storage.lower() in {s.lower() for s in conf.valid_storages}
    tables = conf.valid_storage_tables
    return ok and (
        tables is None or storage_table(storage, table).lower() in {t.lower() for t in tables}
    )


def _text(name: str) -> str:
    """A lower-case SQL literal."""
    return "'" + name.lower().replace("\\", "\\\\").replace("'", "\\'") + "'"


def check_names(model: Model, cube: Cube, conf: QueryConf) -> None:
    """Refuse options that name facts or storages the cube does not have."""
    known = {(f.name.lower(), s.storage.lower()) for f in model.facts_of(cube) for s in f.storages}
    unknown = {(f.lower(), s.lower()) for f, s in conf.valid_update_periods} - known
    if unknown:
        raise CubeError(f"no such fact and storage: {sorted(unknown)}")


def periods_of(fact: Fact, storage: FactStorage, conf: QueryConf) -> list[UpdatePeriod]:
    asked = {(f.lower(), s.lower()): v for (f, s), v in conf.valid_update_periods.items()}
    only = asked.get((fact.name.lower(), storage.storage.lower()))
    allowed = None if only is None else {UpdatePeriod.of(p) for p in only}
    limit = conf.max_interval and UpdatePeriod.of(conf.max_interval).rank
    return [
        p
        for p in storage.periods
        if (allowed is None or p in allowed) and (limit is None or p.rank <= limit)
    ]


def candidate_facts(
    model: Model, cube: Cube, columns: set[str], raw_only: bool, conf: QueryConf
) -> list[tuple[Fact, tuple[FactStorage, ...]]]:
    """Facts that have every column asked for, with the storages they may use."""
    found = []
    for fact in model.facts_of(cube):
        if conf.valid_facts is not None and fact.name.lower() not in {
            f.lower() for f in conf.valid_facts
        }:
            continue
        if (raw_only and fact.aggregated) or not fact.has(columns):
            continue
        if conf.process_time_col is not None and fact.time_column is None:
            continue  # its rows could not be told from those of other event times
        storages = tuple(
            s
            for s in fact.storages
            if _allowed(conf, s.storage, fact.name) and periods_of(fact, s, conf) and _exact(s, conf)
        )
        whole = tuple(s for s in storages if not s.partitioned)
        if whole or model.manifest is None:  # each holds all rows: read one of them
            storages = (whole or storages)[:1]
        if storages:
            found.append((fact, storages))
    return found


def _exact(storage: FactStorage, conf: QueryConf) -> bool:
    """Whether partitions alone decide the further ranges, if that is asked for."""
    if not conf.exact_ranges:
        return True
    kept = {name.lower(): period for name, (_, period) in storage.others.items()}
    return all(
        (period := kept.get(name.lower())) and all(floor_instant(at, period) == at for at in (frm, to))
        for name, frm, to in conf.other_ranges
    )


def look_ahead(to: datetime, periods: list[UpdatePeriod], conf: QueryConf) -> datetime:
    """End of the process-time range that may hold rows of the event-time range.

    Some of a fact's finest periods further on, by the calendar.
    """
    if conf.process_time_col is None:
        return to
    finest = min(periods, key=lambda p: p.rank)
    n = conf.lookahead
    if not isinstance(n, int):
        n = n.get(finest, n.get(finest.name, 1))
    return shift_instant(ceil_instant(to, finest), finest, n)


def resolve_fact(
    spark: SparkSession,
    model: Model,
    cube: Cube,
    columns: set[str],
    raw_only: bool,
    span: tuple[str, datetime, datetime],
    conf: QueryConf,
) -> Resolution:
    """Lightest fact among those whose partitions fill the range.

    If none is complete: an error, or the fact that covers most of it.
    """
    check_names(model, cube, conf)
    candidates = candidate_facts(model, cube, columns, raw_only, conf)
    if not candidates:
        raise CubeError(
            f"no {'unaggregated ' if raw_only else ''}fact of {cube.name} has {sorted(columns)}"
        )
    candidates.sort(key=lambda c: (c[0].weight, c[0].name))
    if conf.lightest_first:
        candidates = candidates[:1]
    _, frm, to = span
    if model.manifest is None:
        fact, storages = candidates[0]
        wanted = (to - frm).total_seconds()
        return Resolution(fact, storages, None, None, wanted, wanted, to)

    manifest, best = model.manifest(spark), None
    for fact, storages in candidates:
        found = _covered(manifest, fact, storages, frm, to, conf)
        if best is None or found.covered / found.wanted > best.covered / best.wanted:
            best = found
        if found.complete:
            return found
    if conf.fail_if_partial:
        raise CubeError(f"no fact of {cube.name} has all partitions of {frm} .. {to}")
    return best


def _covered(
    manifest: DataFrame, fact: Fact, storages: tuple[FactStorage, ...], frm: datetime, to: datetime, conf: QueryConf
) -> Resolution:
    """A fact's cover of a range. Its partitions come to the driver, since a reader needs the list of
    folders it reads; those of other facts do not, unless lighter ones are incomplete."""
    kept, until = [], to
    for s in storages:
        periods = periods_of(fact, s, conf)
        until = max(until, look_ahead(to, periods, conf))
        names = ", ".join(f"'{p.name}'" for p in periods)
        kept.append(f"(lower(storage) = {_text(s.storage)} and period in ({names}))")
    mine = manifest.filter(f"lower(table) = {_text(fact.name)} and ({' or '.join(kept)})")
    periods = sorted({p for s in storages for p in periods_of(fact, s, conf)}, key=lambda p: p.rank)
    widened = [fact.name] if fact.time_column and not fact.aggregated else []
    chosen = P.cover(mine, frm, until, periods, widen=widened)
    parts = chosen.collect()
    seconds = sum(max((min(r["end"], until) - max(r["start"], frm)).total_seconds(), 0.0) for r in parts)
    return Resolution(fact, storages, chosen, parts, seconds, (until - frm).total_seconds(), until)


def scan_fact(
    spark: SparkSession,
    res: Resolution,
    span: tuple[str, datetime, datetime],
    conf: QueryConf,
) -> DataFrame:
    """Rows of the chosen partitions, read from the storages that hold them."""
    _, frm, to = span
    fact, result = res.fact, None
    for storage in res.storages:
        if not storage.partitioned or res.chosen is None:
            df = storage.read(spark)
        else:
            mine = [r for r in res.parts if r["storage"].lower() == storage.storage.lower()]
            if storage.base and storage.schema:
                mine = [r for r in mine if r["location"]]
            if not mine:
                continue
            df = _read_parts(spark, storage, mine)
            df = df.filter(P.partition_predicate(mine, conf.writer, conf.partition_format))
            for condition in _by_others(storage, conf):
                df = df.filter(condition)
        rows_decide = (
            not storage.partitioned
            or not fact.aggregated
            or conf.process_time_col is not None
            or not conf.replace_timedim
        )
        if fact.time_column and rows_decide:
            df = df.filter(time_range(fact.time_column, frm, to))
        result = df if result is None else result.unionByName(df)
    if result is None:  # no partition at all: no rows, with the right columns
        first = res.storages[0]
        if first.schema:
            return spark.createDataFrame([], first.schema)
        return first.read(spark).filter(F.lit(False))
    return result


def _by_others(storage: FactStorage, conf: QueryConf) -> list[str]:
    """Predicates on the partition columns of further timed dimensions; values sort by time."""
    kept = {name.lower(): place for name, place in storage.others.items()}
    found = []
    for name, frm, to in conf.other_ranges:
        if name.lower() in kept:
            column, period = kept[name.lower()]
            first, end = (at.strftime(period.py_pattern) for at in (floor_instant(frm, period), ceil_instant(to, period)))
            found.append(f"`{column}` >= '{first}' and `{column}` < '{end}'")
    return found


def _read_parts(spark: SparkSession, storage: FactStorage, parts: list) -> DataFrame:
    if storage.open_parts:
        return storage.open_parts(spark, parts)
    if storage.base and storage.schema:
        reader = spark.read.schema(storage.schema).option("basePath", storage.base)
        return reader.parquet(*[r["location"] for r in parts])
    return storage.read(spark)


def check_validity(fields, frm: datetime, to: datetime) -> list[str]:
    """Names of fields that are not valid over the whole range."""
    return [
        f.name
        for f in fields
        if (f.start is not None and frm < f.start) or (f.end is not None and to > f.end)
    ]


def valid_only(field_, column: Column, at: Column) -> Column:
    """Column with values outside the field's validity window nulled."""
    cond = F.lit(True)
    if field_.start is not None:
        cond = cond & (at >= instant(field_.start))
    if field_.end is not None:
        cond = cond & (at < instant(field_.end))
    return F.when(cond, column)


def choose_dim(
    spark: SparkSession, dim: Dim, columns: set[str], conf: QueryConf, span: tuple | None = None
) -> tuple[DimTable, DimStorage, str | None]:
    """Lightest table of a dimension that has the columns and, if it is kept as dumps, one in force;
    with the storage and the dump's value."""
    tables, allowed = conf.valid_dim_tables, False
    for table in dim.choices():
        for s in table.storages:
            if tables is not None and storage_table(s.storage, table.name).lower() not in {t.lower() for t in tables}:
                continue
            if conf.valid_storages is not None and s.storage.lower() not in {v.lower() for v in conf.valid_storages}:
                continue
            allowed = True
            if not table.has(columns):
                continue
            if s.period is None:
                return table, s, None
            as_of = span[2] if conf.dim_as_of == "range" and span else conf.dim_as_of
            dump = P.latest_dump(s.read(spark), None if as_of == "range" else as_of, s.period)
            if dump is not None:
                return table, s, dump
    if not allowed:
        raise CubeError(f"no storage of dimension {dim.name} is allowed")
    raise CubeError(f"no table of dimension {dim.name} has {sorted(columns)} and a dump in force")


def read_dim(
    spark: SparkSession, dim: Dim, columns: set[str], conf: QueryConf, span: tuple | None = None
) -> DataFrame:
    """A dimension as one snapshot, so that its key stays unique."""
    _, storage, dump = choose_dim(spark, dim, columns, conf, span)
    df = storage.read(spark)
    return df if dump is None else df.filter(F.col("dt") == F.lit(dump))


def fits_broadcast(spark: SparkSession, df: DataFrame) -> bool:
    """Whether Spark estimates a frame as small enough to broadcast."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(size) <= limit
