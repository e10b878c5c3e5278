"""Cube and dimension queries.

A ``Query`` is an immutable description; ``to_df`` turns it into a lazy
DataFrame. The model supplies what the query leaves out: the fact and its
partitions, aggregates of measures, grouping columns and join conditions.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.model import Attr, Cube, CubeError, Dim, Expr, Measure, Model
from cubespark.operators.joins import join_type, outer_join
from cubespark.operators.star import merged, partials
from cubespark.plans import partitions as P
from cubespark.plans import resolve as R
from cubespark.plans.names import MERGING, lift_aggregates, map_names
from cubespark.plans.periods import instant_sql, parse_instant

_ALIAS = re.compile(r"^(.*\S)\s+as\s+(\w+)$", re.IGNORECASE | re.DOTALL)
_BARE = re.compile(r"^(?:(\w+)\.)?(\w+)$")
_ORDER = re.compile(r"^(.*\S)\s+(asc|desc)$", re.IGNORECASE | re.DOTALL)
_LIFTED = re.compile(r"(?<!\w)_agg\d+(?!\w)")


@dataclass(frozen=True)
class _Join:
    dim: str
    how: str
    on: tuple[tuple[str, str], ...] | None
    on_filter: str | None


@dataclass
class _Names:
    """What the texts of a query touch: columns per table, aggregate calls."""

    columns: dict[str, set[str]] = field(default_factory=dict)
    fields: dict[str, object] = field(default_factory=dict)
    calls: dict[tuple[str, bool, str, str | None], str] = field(default_factory=dict)
    call_columns: dict[str, set[str]] = field(default_factory=dict)
    raw_only: bool = False
    states: dict[str, str] = field(default_factory=dict)  # columns that hold counts or averages of parts

    def use(self, table: str, column: str) -> str:
        self.columns.setdefault(table, set()).add(column)
        return f"{table}__{column}"


class PartialAnswer(UserWarning):
    """No fact has all partitions of a query's range."""


class Answer(NamedTuple):
    """A result, and how much of the range it is of; ``missing`` lists partitions, if any are."""

    df: DataFrame
    fact: str | None
    complete: bool
    missing: DataFrame | None


@dataclass(frozen=True)
class Query:
    model: Model
    root: Cube | Dim
    items: tuple[tuple[str, str | None], ...] = ()
    wheres: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()
    havings: tuple[str, ...] = ()
    orders: tuple[str, ...] = ()
    joins: tuple[_Join, ...] = ()
    span: tuple[str, datetime, datetime] | None = None
    ranges: tuple[tuple[str, datetime, datetime], ...] = ()
    roles: tuple[tuple[str, str, str | None], ...] = ()
    n: int | None = None
    is_distinct: bool = False
    options: R.QueryConf = field(default_factory=R.QueryConf)

    # ------------------------------------------------------------------ building

    @classmethod
    def of(cls, model: Model, root: str | Cube | Dim) -> Query:
        return cls(model, model.table(root) if isinstance(root, str) else root)

    def select(self, *items: str | tuple[str, str]) -> Query:
        """Names, expressions, ``"expr as alias"`` or ``(expr, alias)`` pairs."""
        parsed = []
        for item in items:
            if isinstance(item, tuple):
                parsed.append(item)
                continue
            match = _ALIAS.match(item.strip())
            parsed.append(match.groups() if match else (item.strip(), None))
        return replace(self, items=self.items + tuple(parsed))

    def distinct(self) -> Query:
        return replace(self, is_distinct=True)

    def time_range(self, column: str, frm: str | datetime, to: str | datetime) -> Query:
        """Range of a timed dimension of the cube, ``from`` inclusive and ``to`` exclusive.

        The first one chooses partitions by ``dt``; one of another timed dimension chooses
        partitions of facts that keep it as a partition column, and filters rows otherwise.
        The same name again replaces its range.
        """
        lower, upper = parse_instant(frm), parse_instant(to)
        if lower >= upper:
            raise CubeError(f"empty time range: {lower} .. {upper}")
        timed = {t.lower() for t in getattr(self.root, "timed", ())}
        if timed and column.lower() not in timed:
            raise CubeError(f"{column} is not a timed dimension of {self.root.name}: {sorted(timed)}")
        if self.span is not None and self.span[0].lower() != column.lower():
            others = tuple(r for r in self.ranges if r[0].lower() != column.lower())
            return replace(self, ranges=(*others, (column, lower, upper)))
        return replace(self, span=(column, lower, upper))

    def where(self, condition: str) -> Query:
        """Further conditions are combined by AND."""
        return replace(self, wheres=self.wheres + (condition,))

    def group_by(self, *columns: str) -> Query:
        return replace(self, groups=self.groups + columns)

    def having(self, condition: str) -> Query:
        return replace(self, havings=self.havings + (condition,))

    def order_by(self, *columns: str) -> Query:
        return replace(self, orders=self.orders + columns)

    def limit(self, n: int) -> Query:
        return replace(self, n=n)

    def join(
        self,
        dim: str,
        how: str = "inner",
        on: list[tuple[str, str]] | None = None,
        on_filter: str | None = None,
    ) -> Query:
        """Join a dimension; without ``on`` the model's references give the condition.

        ``on`` lists (column of the query, column of the dimension) pairs, all
        of which must be equal; ``on_filter`` is a further join condition.
        """
        joined = _Join(dim.lower(), join_type(how), on and tuple(on), on_filter)
        return replace(self, joins=self.joins + (joined,))

    def role(self, name: str, dim: str, via: str | None = None) -> Query:
        """A further name for a dimension, as reached through the dimension or role ``via``.

        Each role is joined by itself, so one dimension may be there several times. References
        of the model that have a role need no declaration here.
        """
        if self.model.dim(dim) is None:
            raise CubeError(f"unknown dimension: {dim}")
        return replace(self, roles=(*self.roles, (name.lower(), dim.lower(), via and via.lower())))

    def conf(self, **options) -> Query:
        return replace(self, options=replace(self.options, **options))

    # ----------------------------------------------------------------- name lookup

    @property
    def _root(self) -> str:
        return self.root.name.lower()

    def _dim(self, name: str) -> Dim | None:
        """The dimension that a name or a role stands for."""
        declared = next((dim for role, dim, _ in self.roles if role == name), None)
        if declared is None and self.model.dim(name) is None:
            edge = self.model.role(name)
            declared = edge and edge[2].table
        return self.model.dim(declared or name)

    def _path(self, target: str) -> list[tuple]:
        """References from the root to a dimension or role, the last one named by it."""
        for role, dim, via in self.roles:
            if role != target:
                continue
            if via is not None and self.model.dim(via) is None:  # behind another role
                home = self._dim(via)
                if home is None:
                    raise CubeError(f"unknown dimension or role: {via}")
                start, onward = home.name.lower(), self.model.path(home.name, dim)
                steps = self._path(via) + [(via if t == start else t, *rest) for t, *rest in onward]
            else:
                steps = self.model.path(self._root, dim, via)
            return [*steps[:-1], (*steps[-1][:2], target, steps[-1][3])]
        edge = None if self.model.dim(target) else self.model.role(target)
        if edge:
            owner, attr, ref = edge
            before = [] if owner == self._root else self._path(owner)
            return [*before, (owner, attr.name, target, ref.column)]
        return self.model.path(self._root, target, self.options.via.get(target))

    def _find(self, word: str, home: str) -> tuple[str, object] | None:
        """Table and field a name stands for."""
        table, _, name = word.lower().rpartition(".")
        if table:
            owner = self.root if table == self._root else self._dim(table)
            if owner is None:
                return None
            found = owner.field(name)
            if found is None:
                raise CubeError(f"{owner.name} has no column {name}")
            return table, found
        owner = self.root if home == self._root else self._dim(home)
        found = owner.field(name)
        if found is not None:
            return home, found
        joined = [
            (j.dim, self._dim(j.dim).field(name))
            for j in self.joins
            if self._dim(j.dim) and self._dim(j.dim).field(name)
        ]
        if len(joined) > 1:
            raise CubeError(f"{name} is in several joined dimensions: qualify it")
        return joined[0] if joined else None

    def _expand(self, text: str, home: str, around: tuple = ()) -> str:
        """Text with expression columns replaced by what they stand for."""

        def swap(word: str) -> str | None:
            hit = self._find(word, home)
            if hit is None:
                return None
            table, found = hit
            if isinstance(found, Expr):
                name = (table, found.name.lower())
                if name in around:
                    raise CubeError(f"expression columns refer to each other: {found.text}")
                inner = self._expand(found.text, table, (*around, name))
                return f"cast(({inner}) as {found.type})"
            return f"{table}.{found.name}"

        return map_names(text, swap)

    def _text(self, text: str, names: _Names, home: str | None = None) -> tuple[str, set[str]]:
        """Spark text over internal column names, and those names outside aggregates."""
        text, outside = self._expand(text, home or self._root), set()

        def column(into: set[str], bare_measure) -> callable:
            def swap(word: str) -> str | None:
                hit = self._find(word, self._root)
                if hit is None:
                    return None
                table, found = hit
                names.fields[f"{table}__{found.name.lower()}"] = found
                if bare_measure and isinstance(found, Measure):
                    return bare_measure(table, found)
                internal = names.use(table, found.name.lower())
                into.add(internal)
                return internal

            return swap

        def lift(fn: str, distinct: bool, arg: str, condition: str | None = None) -> str:
            touched: set[str] = set()
            inner = map_names(arg, column(touched, None))
            only = None if condition is None else map_names(condition, column(touched, None))
            bare = _BARE.match(arg)
            hit = self._find(arg, self._root) if bare else None
            default = (
                hit is not None
                and isinstance(hit[1], Measure)
                and (hit[1].aggr or "").lower() == fn
                and not distinct
                and condition is None
            )
            if not default:
                names.raw_only = True
            key = (fn, distinct, inner, only)
            call = names.calls.setdefault(key, f"_agg{len(names.calls)}")
            names.call_columns[call] = touched
            return call

        def measure(table: str, found: Measure) -> str:
            if found.aggr is None:
                raise CubeError(f"measure {found.name} has no default aggregate: name one")
            return lift(found.aggr.lower(), False, f"{table}.{found.name}")

        text = lift_aggregates(text, lift)
        bare = measure if self.options.aggregate_default else None
        return map_names(text, column(outside, bare)), outside

    # --------------------------------------------------------------------- analysis

    def _outputs(self, names: _Names) -> list[tuple[str, str]]:
        """(text, alias) of each selected item."""
        taken: dict[str, int] = {}
        for text, alias in self.items:
            simple = alias or text.rpartition(".")[2]
            taken[simple.lower()] = taken.get(simple.lower(), 0) + 1
        result = []
        for text, alias in self.items:
            if alias is None:
                bare = _BARE.match(text)
                alias = bare.group(2) if bare else text
                if bare and bare.group(1) and taken[alias.lower()] > 1:
                    alias = f"{bare.group(1)}_{alias}"
            result.append((self._text(text, names)[0], alias))
        return result

    def _with_aliases(self, text: str, outputs: list[tuple[str, str]]) -> str | None:
        """The text of the selected item that ``text`` names by its alias."""
        return next((t for t, a in outputs if a.lower() == text.strip().lower()), None)

    def _group_text(self, text: str, outputs, names: _Names) -> str:
        aliased = self._with_aliases(text, outputs)
        if aliased and _BARE.match(text) and self._find(text, self._root) is None:
            return aliased
        return self._text(text, names)[0]

    def _having_text(self, text: str, outputs, names: _Names) -> str:
        aliased = {a.lower(): t for t, a in outputs}
        marks: dict[str, str] = {}

        def swap(word: str) -> str | None:
            target = aliased.get(word.lower())
            if target is None or not _LIFTED.search(target):
                return None
            mark = f"_alias{len(marks)}"
            marks[mark] = target
            return mark

        # aliases only outside aggregate calls: inside, a name is a column
        calls: list[str] = []

        def hide(fn: str, distinct: bool, arg: str, condition: str | None = None) -> str:
            only = "" if condition is None else f" filter (where {condition})"
            calls.append(f"{fn}({'distinct ' if distinct else ''}{arg}){only}")
            return f"_call{len(calls) - 1}"

        text = map_names(lift_aggregates(text, hide), swap)
        text = map_names(
            text, lambda w: calls[int(w[5:])] if re.fullmatch(r"_call\d+", w) else None
        )
        text = self._text(text, names)[0]
        return map_names(text, lambda w: f"({marks[w]})" if w in marks else None)

    def _join_steps(self, names: _Names) -> list[tuple[_Join, list[tuple[str, str]]]]:
        """Joins in order, each with pairs of internal columns that must be equal."""
        explicit = {j.dim: j for j in self.joins}
        steps: dict[str, tuple[_Join, list[tuple[str, str]]]] = {}

        def add(dim: str, pairs: list[tuple[str, str]]) -> None:
            if dim in steps:
                return
            if dim not in explicit and not self.options.auto_join:
                raise CubeError(f"automatic joins are off: join {dim} explicitly")
            given = explicit.get(dim) or _Join(
                dim, join_type(self.options.join_type), None, None
            )
            steps[dim] = (given, pairs)

        def need(dim: str) -> None:
            if dim in steps or dim == self._root:
                return
            given = explicit.get(dim)
            if given is not None and given.on is not None:
                pairs = []
                for left, right in given.on:
                    text, touched = self._text(left, names)
                    for column in touched:
                        need(column.partition("__")[0])
                    pairs.append((text, names.use(dim, right.rpartition(".")[2].lower())))
                add(dim, pairs)
                return
            for table, column, target, key in self._path(dim):
                add(target, [(names.use(table, column.lower()), names.use(target, key.lower()))])

        for j in self.joins:
            need(j.dim)
        for table in list(names.columns):
            need(table)
        if steps and not self.options.multi_table:
            raise CubeError(f"query needs {sorted(steps)} but only single tables are allowed")
        return list(steps.values())

    # -------------------------------------------------------------------- execution

    def resolve(self, spark: SparkSession) -> R.Resolution:
        """The fact and partitions this query would use."""
        settled, names = self._settled(spark), _Names()
        settled._analyse(names)
        return settled._resolve(spark, names)

    def missing_partitions(self, spark: SparkSession) -> DataFrame:
        """Partitions the chosen fact lacks for the range, at its finest period; with process time
        also those that it would have to look ahead for."""
        return self._missing(spark, self.resolve(spark))

    def _missing(self, spark: SparkSession, res: R.Resolution) -> DataFrame:
        frm = self.span[1]
        periods = {p for s in res.storages for p in R.periods_of(res.fact, s, self.options)}
        finest = min(periods, key=lambda p: p.rank)
        manifest = self.model.manifest(spark).filter(F.lower("table") == res.fact.name.lower())
        return P.missing_partitions(manifest, frm, res.until, finest, sorted(periods, key=lambda p: p.rank))

    def answer(self, spark: SparkSession) -> Answer:
        """The result with the fact it comes from and the partitions that it lacks."""
        settled, names = self._settled(spark), _Names()
        if not isinstance(self.root, Cube) or self.model.manifest is None:
            return Answer(settled._plan(spark), None, True, None)
        settled._analyse(names)
        res = settled._resolve(spark, names)
        missing = None if res.complete else settled._missing(spark, res)
        return Answer(settled._plan(spark, res), res.fact.name, res.complete, missing)

    def _settled(self, spark: SparkSession) -> Query:
        """Further ranges decided by partitions alone where a complete fact allows it; else they
        choose partitions as far as these go and are conditions on rows as well."""
        if not self.ranges:
            return self
        pruned = replace(self, ranges=(), options=replace(self.options, other_ranges=self.ranges))
        try:
            exact, names = pruned.conf(exact_ranges=True), _Names()
            exact._analyse(names)
            if exact._resolve(spark, names).complete:
                return exact
        except CubeError:  # no fact keeps them so
            pass
        rows = [f"{c} >= {instant_sql(low)} and {c} < {instant_sql(high)}" for c, low, high in self.ranges]
        return replace(pruned, wheres=(*self.wheres, *rows))

    def _analyse(self, names: _Names):
        if not self.items:
            raise CubeError("nothing is selected")
        outputs = self._outputs(names)
        groups = [self._group_text(g, outputs, names) for g in self.groups]
        wheres = [self._text(w, names) for w in self.wheres]
        havings = [self._having_text(h, outputs, names) for h in self.havings]
        orders = []
        for order in self.orders:
            match = _ORDER.match(order.strip())
            text, word = match.groups() if match else (order, "asc")
            aliased = self._with_aliases(text, outputs)
            orders.append((aliased or self._text(text, names)[0], word.lower() == "desc"))
        on_filters = {
            j.dim: self._text(j.on_filter, names) for j in self.joins if j.on_filter is not None
        }
        steps = self._join_steps(names)
        if isinstance(self.root, Cube) and self.options.process_time_col is None and self.span is None:
            raise CubeError(f"cube {self.root.name} needs a time range")
        aggregated = bool(names.calls or groups or havings)
        if not aggregated:
            names.raw_only = True
        return outputs, groups, wheres, havings, orders, on_filters, steps, aggregated

    def _resolve(self, spark: SparkSession, names: _Names) -> R.Resolution:
        fields = [f for f in names.fields.values() if isinstance(f, (Measure, Attr))]
        _, frm, to = self.span
        outside = R.check_validity(fields, frm, to)
        raw_only = names.raw_only
        if outside:
            if self.options.validity == "reject":
                raise CubeError(f"not valid over the whole range: {outside}")
            raw_only = True
        return R.resolve_fact(
            spark,
            self.model,
            self.root,
            names.columns.get(self._root, set()),
            raw_only,
            self.span,
            self.options,
        )

    def _read_root(self, spark: SparkSession, names: _Names, res: R.Resolution | None) -> DataFrame:
        columns = sorted(names.columns.get(self._root, set()))
        aggregated = False
        if isinstance(self.root, Dim):
            df, exprs, at = R.read_dim(spark, self.root, set(columns), self.options), {}, None
        else:
            if res is None:
                res = self._resolve(spark, names)
                if not res.complete:
                    had = f"{res.fact.name} has {res.covered:.0f} of {res.wanted:.0f} seconds of the range"
                    warnings.warn(f"{had}: see missing_partitions", PartialAnswer, stacklevel=4)
            df = R.scan_fact(spark, res, self.span, self.options)
            exprs = {k.lower(): v for k, v in res.fact.exprs.items()}
            at, aggregated = res.fact.time_column, res.fact.aggregated
        selected = []
        for name in columns:
            declared = self.root.field(name)
            col = F.expr(exprs.get(name, f"`{name}`"))
            fn = (getattr(declared, "aggr", None) or "").lower()
            if aggregated and fn in ("count", "avg"):
                names.states[f"{self._root}__{name}"] = fn
            else:
                col = col.cast(declared.type)
            if at and self.options.validity == "null" and (declared.start or declared.end):
                col = R.valid_only(declared, col, F.col(at))
            selected.append(col.alias(f"{self._root}__{name}"))
        return df.select(*selected)

    def _read_dim(self, spark: SparkSession, name: str, columns: set[str]) -> DataFrame:
        dim = self._dim(name)
        if dim is None:
            raise CubeError(f"unknown dimension: {name}")
        return R.read_dim(spark, dim, columns, self.options, self.span).select(
            *[F.col(c).cast(dim.field(c).type).alias(f"{name}__{c}") for c in sorted(columns)]
        )

    def _reduced(self, spark: SparkSession, df: DataFrame, names: _Names, steps, late, on_filters) -> DataFrame:
        """Fact rows whose keys are in the filtered dimensions.

        Only through inner and semi joins, which drop the other rows anyway, and only where the
        keys fit a broadcast, so that the fact does not move for it.
        """
        if self.options.reduce is False or not isinstance(self.root, Cube):
            return df
        conditions = [*late, *(on_filters[given.dim] for given, _ in steps if given.dim in on_filters)]
        for given, pairs in steps:
            lefts = _words([left for left, _ in pairs])
            if given.how not in ("inner", "left_semi") or {w.partition("__")[0] for w in lefts} != {self._root}:
                continue
            keys = self._read_dim(spark, given.dim, names.columns[given.dim])
            members = {given.dim}
            # what is reached through this dimension alone may filter it
            for later, more in steps:
                behind = {w.partition("__")[0] for w in _words([left for left, _ in more])}
                if later.dim not in members and later.how == "inner" and behind and behind <= members:
                    table = self._read_dim(spark, later.dim, names.columns[later.dim])
                    keys = keys.join(table, F.expr(" and ".join(f"{x} = {y}" for x, y in more)))
                    members.add(later.dim)
            mine = [t for t, cols in conditions if cols and {c.partition("__")[0] for c in cols} <= members]
            if not mine:
                continue
            for condition in mine:
                keys = keys.filter(F.expr(condition))
            rights = [right for _, right in pairs]
            keys = keys.select(*[F.col(r).alias(f"{r}__key") for r in rights])
            if self.options.reduce or R.fits_broadcast(spark, keys):
                on = " and ".join(f"{left} = {right}__key" for left, right in pairs)
                df = df.join(keys, F.expr(on), "left_semi")
        return df

    def to_df(self, spark: SparkSession) -> DataFrame:
        """The result. If no fact has all partitions of the range, that of the fact with most of
        them, with a warning (``PartialAnswer``); ``fail_if_partial`` refuses it, ``answer`` tells
        what is missing."""
        return self._settled(spark)._plan(spark)

    def _plan(self, spark: SparkSession, res: R.Resolution | None = None) -> DataFrame:
        names = _Names()
        outputs, groups, wheres, havings, orders, on_filters, steps, aggregated = self._analyse(names)
        mine = f"{self._root}__"
        fact_first = all(step[0].how in ("inner", "left", "left_semi") for step in steps)
        early = [w for w, cols in wheres if fact_first and all(c.startswith(mine) for c in cols)]
        late = [(w, cols) for w, cols in wheres if w not in early]

        df = self._read_root(spark, names, res)
        for condition in early:
            df = df.filter(F.expr(condition))
        if fact_first:
            df = self._reduced(spark, df, names, steps, late, on_filters)

        eager = aggregated and bool(steps) and self._can_pre_aggregate(names, steps, fact_first)
        if eager:
            held = self._held_columns(
                mine, names, groups, outputs, orders, steps, on_filters, wheres, early
            )
            df = _pre_aggregate(df, sorted(held), names)

        for given, pairs in steps:
            dim = self._read_dim(spark, given.dim, names.columns.get(given.dim, set()))
            conditions = [f"{left} = {right}" for left, right in pairs]
            if given.dim in on_filters:
                conditions.append(f"({on_filters[given.dim][0]})")
            on = F.expr(" and ".join(conditions))
            if eager:  # a pre-aggregated side has no hot key left
                df = df.join(dim, on, given.how)
            else:
                used = _words(conditions)
                df = outer_join(df, dim, on, given.how, [c for c in df.columns if c in used])
        for condition, _ in late:
            df = df.filter(F.expr(condition))

        if aggregated:
            df, outputs, orders = self._aggregate(df, outputs, groups, havings, orders, names, eager)
        return self._finish(df, outputs, orders)

    def _can_pre_aggregate(self, names: _Names, steps, fact_first: bool) -> bool:
        if self.options.eager is False or not isinstance(self.root, Cube):
            return False
        mine = f"{self._root}__"
        keys = {left for _, pairs in steps for left, _ in pairs if mine in left}
        if self.options.eager is None and len(keys) != 1:
            return False
        for (fn, distinct, _, condition), call in names.calls.items():
            touched = names.call_columns[call]
            if distinct or condition is not None or fn not in MERGING or not all(c.startswith(mine) for c in touched):
                return False
            if not touched and not fact_first:
                return False  # count(*) also counts unmatched dimension rows
        return bool(names.calls)

    def _held_columns(
        self, mine, names, groups, outputs, orders, steps, on_filters, wheres, early
    ) -> set[str]:
        """Fact columns that later steps need besides the aggregates."""
        texts = groups + [t for t, _ in outputs] + [t for t, _ in orders]
        texts += [left for _, pairs in steps for left, _ in pairs]
        texts += [text for text, _ in on_filters.values()]
        texts += [w for w, _ in wheres if w not in early]
        return {word for word in _words(texts) if word.startswith(mine)}

    def _aggregate(self, df, outputs, groups, havings, orders, names: _Names, eager: bool):
        keys = list(dict.fromkeys(groups))
        outputs = list(outputs)
        for text, alias in outputs:
            if _LIFTED.search(text) or text in keys:
                continue
            if not self.options.promote_select:
                raise CubeError(f"{alias} is neither aggregated nor grouped by")
            keys.append(text)
        if self.options.promote_groupby:
            shown = {text for text, _ in outputs}
            for text, given in zip(groups, self.groups):
                if text not in shown:
                    outputs.append((text, given.rpartition(".")[2]))
        key_name = {
            text: text if re.fullmatch(r"\w+", text) else f"_key{i}" for i, text in enumerate(keys)
        }
        calls = [
            (merged(fn, call) if eager else _call_column(fn, distinct, arg, condition, names)).alias(call)
            for (fn, distinct, arg, condition), call in names.calls.items()
        ]
        grouped = df.groupBy(*[F.expr(t).alias(key_name[t]) for t in keys])
        df = grouped.agg(*calls) if calls else df.select(
            *[F.expr(t).alias(key_name[t]) for t in keys]
        ).distinct()
        for text in havings:
            df = df.filter(F.expr(text))
        rename = lambda t: key_name.get(t, t)
        return (
            df,
            [(rename(t), a) for t, a in outputs],
            [(rename(t), desc) for t, desc in orders],
        )

    def _finish(self, df: DataFrame, outputs, orders) -> DataFrame:
        aliases = {}
        for text, alias in outputs:
            aliases.setdefault(text, alias)
        hidden = {
            text: f"_order{i}" for i, (text, _) in enumerate(orders) if text not in aliases
        }
        if hidden and self.is_distinct:
            raise CubeError("select distinct can only be ordered by selected columns")
        df = df.select(
            *[F.expr(text).alias(alias) for text, alias in outputs],
            *[F.expr(text).alias(name) for text, name in hidden.items()],
        )
        if self.is_distinct:
            df = df.distinct()
        if orders:
            by = [F.col(f"`{aliases.get(text) or hidden[text]}`") for text, _ in orders]
            df = df.orderBy(*[c.desc() if desc else c.asc() for c, (_, desc) in zip(by, orders)])
        if self.n is not None:
            df = df.limit(self.n)
        return df.drop(*hidden.values())


def _words(texts: list[str]) -> set[str]:
    found: set[str] = set()
    for text in texts:
        map_names(text, found.add)
    return found


def _call_column(fn: str, distinct: bool, arg: str, condition: str | None, names: _Names) -> Column:
    if arg in names.states:  # only default aggregates of a measure come here
        if fn == "avg":
            return F.try_divide(F.sum(F.col(arg)["sum"]), F.sum(F.col(arg)["n"]))
        return F.coalesce(F.sum(arg), F.lit(0))
    only = "" if condition is None else f" filter (where {condition})"
    return F.expr(f"{fn}({'distinct ' if distinct else ''}{arg}){only}")


def _pre_aggregate(df: DataFrame, keys: list[str], names: _Names) -> DataFrame:
    """First stage: partial aggregates per join key, so joins see few rows per key."""
    parts = []
    for (fn, _, arg, _), call in names.calls.items():
        state = names.states.get(arg)
        if state == "avg":
            parts += [F.expr(f"sum({arg}.sum)").alias(f"{call}_sum"), F.expr(f"sum({arg}.n)").alias(f"{call}_n")]
        elif state == "count":
            parts.append(F.sum(arg).alias(f"{call}_part"))
        else:
            parts += partials(fn, arg, call)
    return df.groupBy(*keys).agg(*parts)


def union_all(spark: SparkSession, *queries: Query | DataFrame) -> DataFrame:
    """Union of queries and frames by position; each query is resolved on its own."""
    frames = [q.to_df(spark) if isinstance(q, Query) else q for q in queries]
    result = frames[0]
    for df in frames[1:]:
        result = result.union(df)
    return result
