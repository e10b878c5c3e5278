"""Cheapest repair of the structure of conversations.

A conversation should be an optional system row, then pairs of a user and an assistant row, or
nothing: its role initials are ``(s?(ua)+)?``. Rows are kept (K, free), given another role
(R, 3), deleted (D, 4) or inserted without text (I, 3). Blank rows and repeated ones must go; a
truncated row that stays adds 3. Among the cheapest lists of edits the least one in ASCII order
is taken.

Rows go to tasks by conversation and are sorted by turn there. ``mapInPandas`` streams them and
carries, across Arrow batches, the best cost of each of the grammar's four states:

* What can follow depends only on how costs differ and on the order of the states' lists of
  edits, so steps are remembered: a row is one look-up. Two lists of edits over the same rows
  that end in a row's edit are equal or differ before one of them ends; so numbers in place of
  lists keep their order.
* Each row leaves two bytes, the number of its step, from which the edits are read backwards
  at the end. Beyond ``HELD`` rows they go to a temporary file of the task.
* Each state has a running hash of its repaired rows, so no text is held.

A row is repeated if its role and text were there earlier. The first turn of each role and text
that is there in several rows is a table of its own, joined to the rows, so a conversation
needs no memory of what it has seen.

Null roles and texts are one space, and a null turn comes first. Rows of one turn are sorted by
role, then text. Null ids are one conversation. Roles count by their first character; other
ones than s, u and a, and the empty role, cannot be kept. Turns are whole numbers; gaps beyond a
long stop at its end. An empty table gives an empty one. Columns not named are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubespark.llm.steps import Steps
from cubespark.llm.words import SPACES

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {("s", EMPTY): SYSTEM, ("u", EMPTY): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
WHOLE = (EMPTY, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
# from any state two insertions lead to a whole conversation and a third to each other state;
# a system row that no longer fits is deleted: a state that costs more than that is never best
MOST = 3 * INSERT + DELETE
HELD = 1 << 20
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SUMMARY = ", ".join(["conv string", *(f"{c} bigint" for c in COUNTS), "audit string", "repaired_sha256 string"])

# a state's value: cost, order of its list of edits up to the last row's edit, insertions since
Value = tuple[int, int, int]
Values = tuple[Value | None, ...]
# how a state is reached: earlier state, edit of the row, state after it, insertions after that
Back = tuple[int, str, int, int]


class Edits:
    """Steps of the dynamic program over the grammar's states, remembered by number."""

    def __init__(self) -> None:
        values, self.start_back = self.with_insertions({EMPTY: (0, 0, EMPTY, "")})
        self.numbers: dict[tuple[Values, str, bool, bool], int] = {}
        self.steps: list[tuple[Values, int, tuple[Back | None, ...]]] = []
        self.start = values

    @staticmethod
    def with_insertions(after: dict[int, tuple[int, int, int, str]]) -> tuple[Values, tuple[Back | None, ...]]:
        """Best ways into each state from those after a row (cost, order, earlier state, edit)."""
        best: dict[int, tuple[int, int, int, int]] = {}
        for state, (cost, order, _, _) in after.items():
            at, n = state, 0
            while at is not None and n <= 2:
                best[at] = min(best.get(at, (1 << 60, 0, 0, 0)), (cost + INSERT * n, order, n, state))
                at, n = next((NEXT[r, at] for r in "ua" if (r, at) in NEXT), None), n + 1
        values: list[Value | None] = [None] * 4
        back: list[Back | None] = [None] * 4
        for at, (cost, order, n, state) in best.items():
            values[at] = (cost, order, n)
            back[at] = (after[state][2], after[state][3], state, n)
        return tuple(values), tuple(back)

    def step(self, values: Values, initial: str, must_go: bool, truncated: bool) -> int:
        """Number of the step that a row with this initial and these faults makes from the values."""
        key = (values, initial, must_go, truncated)
        number = self.numbers.get(key)
        if number is not None:
            return number
        extra = TRUNCATED if truncated else 0
        ways: dict[int, tuple[int, tuple[int, str], int, str]] = {}
        for state, value in enumerate(values):
            if value is None:
                continue
            cost, order, n = value
            options = [(DELETE, "D", state)]
            if not must_go:
                options += [(extra, "K", NEXT[initial, state])] if (initial, state) in NEXT else []
                options += [(REROLE + extra, "R", NEXT[r, state]) for r in "ua" if (r, state) in NEXT]
            for more, edit, to in options:
                way = (cost + more, (order, "I" * n + edit), state, edit)
                ways[to] = min(ways.get(to, way), way)
        orders = {o: k for k, o in enumerate(sorted({w[1] for w in ways.values()}))}
        after = {to: (cost, orders[order], state, edit) for to, (cost, order, state, edit) in ways.items()}
        found, back = self.with_insertions(after)
        least = min(v[0] for v in found if v)
        kept = tuple(v and ((v[0] - least, *v[1:]) if v[0] <= least + MOST else None) for v in found)
        number = self.numbers[key] = len(self.steps)
        self.steps.append((kept, least, back))
        return number


class Trail:
    """Numbers of the steps of one conversation; long ones spill to a temporary file."""

    def __init__(self) -> None:
        self.held, self.file, self.blocks = array("H"), None, 0

    def add(self, number: int) -> None:
        self.held.append(number)
        if len(self.held) == HELD:
            self.file = self.file or tempfile.TemporaryFile()
            self.held.tofile(self.file)
            self.held, self.blocks = array("H"), self.blocks + 1

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.held)
        for k in range(self.blocks - 1, -1, -1):
            self.file.seek(k * HELD * self.held.itemsize)
            block = array("H")
            block.fromfile(self.file, HELD)
            yield from reversed(block)
        if self.file:
            self.file.close()


class Conversation:
    """One conversation while its rows go by."""

    def __init__(self, key: str | None, edits: Edits) -> None:
        self.key, self.edits, self.trail = key, edits, Trail()
        self.values, self.cost = edits.start, 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first_turn = self.last_turn = self.previous = None
        self.turns, self.initial = 0, None
        empty = hashlib.sha256()
        self.hashes = [b and self._inserted(empty, b[2], b[3]) for b in edits.start_back]

    @staticmethod
    def _line(hashed, state: int, role: str, text: str):
        """With one more row; nothing has been written before the first one."""
        out = hashed.copy()
        out.update(f"{'' if state == EMPTY else chr(10)}{role}:{text}".encode())
        return out

    def _inserted(self, hashed, state: int, n: int):
        for _ in range(n):
            to = USER if state != USER else ASSISTANT
            hashed = self._line(hashed, state, ROLES[to], "")
            state = to
        return hashed

    def add(self, turn: int | None, role: str, text: str, seen: bool, blank: bool, truncated: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1
        seen = seen or self.previous == (turn, role, text)
        self.previous = (turn, role, text)
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.initial = initial
        fault = "blank" if blank else "duplicate" if seen else "truncated" if truncated else None
        if fault:
            self.counts[fault] += 1
        number = self.edits.step(self.values, initial if initial in ("s", "u", "a") else "", fault in ("blank", "duplicate"), fault == "truncated")
        self.trail.add(number)
        self.values, least, back = self.edits.steps[number]
        self.cost += least
        rows: dict[tuple[int, str, int], object] = {}
        hashes = []
        for value, way in zip(self.values, back):
            if value is None:
                hashes.append(None)
                continue
            earlier, edit, state, n = way
            if (earlier, edit, state) not in rows:
                old = self.hashes[earlier]
                rows[earlier, edit, state] = (
                    old if edit == "D" else self._line(old, earlier, role if edit == "K" else ROLES[state], text)
                )
            hashes.append(self._inserted(rows[earlier, edit, state], state, n))
        self.hashes = hashes

    def summary(self) -> tuple:
        state = min((s for s in WHOLE if self.values[s]), key=lambda s: self.values[s][:2])
        cost, digest, out = self.cost + self.values[state][0], self.hashes[state].hexdigest(), bytearray()
        for number in self.trail.backwards():
            state, edit, _, n = self.edits.steps[number][2][state]
            out += b"I" * n + edit.encode()
        out += b"I" * self.edits.start_back[state][3]
        out.reverse()
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        self.counts |= {"gaps": min(gaps, (1 << 63) - 1), "cost": cost}
        return (self.key, *self.counts.values(), out.decode(), digest)


def _values(frame: pd.DataFrame) -> Iterator[tuple]:
    """Rows; what is missing is None in every type of column."""
    return zip(*(frame[c].astype(object).where(frame[c].notna(), None).tolist() for c in frame.columns))


def _summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    edits, now, done = Edits(), None, []
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    for frame in frames:
        for key, turn, role, text, times, seen, blank, truncated in _values(frame):
            if now is None or key != now.key:
                if now:
                    done.append(now.summary())
                now = Conversation(key, edits)
            for _ in range(times):
                now.add(None if turn is None else int(turn), role, text, seen, blank, truncated)
        if done:
            yield pd.DataFrame(done, columns=names)
            done = []
    if now:
        yield pd.DataFrame([now.summary()], columns=names)


def _rows(df: DataFrame, conv: str, turn: str, role: str, text: str, times: str | None) -> DataFrame:
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))

    return df.select(
        F.struct(F.col(f"`{conv}`").cast("string").alias("conv")).alias("key"),
        F.struct(F.col(f"`{turn}`").cast("bigint").alias("turn")).alias("at"),
        spaced(role).alias("role"),
        spaced(text).alias("text"),
        (F.lit(1) if times is None else F.greatest(F.coalesce(F.col(f"`{times}`"), F.lit(0)), F.lit(0))).cast("bigint").alias("times"),
    )


def _streamed(rows: DataFrame) -> DataFrame:
    """Rows of a conversation in one task, in order."""
    order = ["key", F.col("at.turn").asc_nulls_first(), "role", "text"]
    return rows.repartition("key").sortWithinPartitions(*order)


def repair(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: str | None = None
) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each
    conversation: its numbers of missing turns and of rows by first fault, of illegal neighbours,
    the cost and initials of its edits, and the digest of ``role:text`` of the repaired rows,
    joined by newlines.

    ``times`` names a column that says how often a row is there; a conversation whose rows are all
    there 0 times is empty.
    """
    kind = df.schema[conv].dataType.simpleString()
    end = F.rtrim("text", F.lit(SPACES))
    rows = _rows(df, conv, turn, role, text, times).withColumns({"blank": end == "", "truncated": ~F.right(end, F.lit(1)).isin(".", "!", "?")})
    rows = rows.withColumn("digest", F.when((F.col("times") > 0) & ~F.col("blank"), F.sha2("text", 256)))
    several = rows.where("digest is not null").groupBy("key", "role", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    several = Steps(df.sparkSession).kept(several.where("n > 1").drop("n"), "repeated-rows")
    flagged = rows.join(several, ["key", "role", "digest"], "left")
    later = F.col("first").isNotNull() & (F.col("at") > F.col("first"))
    streamed = _streamed(flagged.withColumn("seen", later)).select(
        "key.conv", F.col("at.turn").cast("string").alias("turn"), "role", "text", "times", "seen", "blank", "truncated"
    )
    found = streamed.mapInPandas(_summaries, SUMMARY)
    return found.withColumn("conv", F.col("conv").cast(kind)).withColumnRenamed("conv", conv)


def _edited(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["conv", "place", "edit", "role", "text"]
    key, audit, at, place, state = object(), "", 0, 0, EMPTY
    out: list[tuple] = []

    def put(edit: str, role: str, text: str) -> None:
        nonlocal place, state
        initial = role[:1] if edit == "K" else "a" if state == USER else "u"
        state = NEXT[initial, state]
        out.append((key, place, edit, role if edit == "K" else ROLES[state], text))
        place += 1

    def insertions() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            put("I", "", "")
            at += 1

    for frame in frames:
        for conv, edits, role, text, times in _values(frame):
            if edits is not None:
                insertions()
                key, audit, at, place, state = conv, edits, 0, 0, EMPTY
                continue
            for _ in range(times):
                insertions()
                if audit[at] != "D":
                    put(audit[at], role, text)
                at += 1
        if out:
            yield pd.DataFrame(out, columns=names)
            out.clear()
    insertions()
    if out:
        yield pd.DataFrame(out, columns=names)


def repaired_rows(
    df: DataFrame,
    repairs: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    times: str | None = None,
) -> DataFrame:
    """(conv, place, edit, role, text) of the rows that the edits of ``repairs`` leave or insert."""
    kind = df.schema[conv].dataType.simpleString()
    rows = _rows(df, conv, turn, role, text, times).withColumn("audit", F.lit(None).cast("string"))
    heads = repairs.select(F.struct(F.col(f"`{conv}`").cast("string").alias("conv")).alias("key"), "audit")
    both = rows.unionByName(heads, allowMissingColumns=True)
    order = ["key", F.col("audit").isNull(), F.col("at.turn").asc_nulls_first(), "role", "text"]
    streamed = both.repartition("key").sortWithinPartitions(*order).select("key.conv", "audit", "role", "text", F.coalesce("times", F.lit(0)).alias("times"))
    found = streamed.mapInPandas(_edited, "conv string, place bigint, edit string, role string, text string")
    return found.withColumn("conv", F.col("conv").cast(kind)).withColumnRenamed("conv", conv)
