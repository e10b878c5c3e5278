import hashlib
import random
import re
from itertools import product

import pytest

from cubespark.llm import conversations

COLUMNS = "conv_id bigint, turn bigint, role string, text string, key string, at int, audit string, digest string"
SPACE = " \t\n\x0b\f\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], COLUMNS).repartition(3)


def faults(rows):
    """Rows (role, text) with their first fault."""
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(SPACE)
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def every_way(rows):
    """(cost, audit, repaired rows) of the best edits, by trying all with two insertions a gap at most."""
    gaps = [g for n in range(3) for g in product(("user", "assistant"), repeat=n)]
    ways = []
    for role, _, fault in rows:
        extra = 3 if fault == "truncated" else 0
        own = [("D", 4, None)]
        if fault not in ("blank", "duplicate"):
            own += [("K", extra, role), ("R", 3 + extra, "user"), ("R", 3 + extra, "assistant")]
        ways.append(own)
    best = None
    for edits in product(*ways):
        for inserted in product(gaps, repeat=len(rows) + 1):
            cost = sum(e[1] for e in edits) + 3 * sum(map(len, inserted))
            if best and cost > best[0]:
                continue
            audit, out = "I" * len(inserted[0]), [(r, "") for r in inserted[0]]
            for (edit, _, role), (_, text, _), more in zip(edits, rows, inserted[1:]):
                audit += edit + "I" * len(more)
                out += [] if role is None else [(role, text)]
                out += [(r, "") for r in more]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def by_lists(rows):
    """The same by a dynamic program that keeps whole lists of edits."""
    step = {("s", ""): "s", ("u", ""): "u", ("u", "s"): "u", ("u", "a"): "u", ("a", "u"): "a"}

    def inserted(states):
        for _ in range(2):
            for state, (cost, audit, out) in list(states.items()):
                for role in ("user", "assistant"):
                    to = step.get((role[0], state))
                    if to:
                        states[to] = min(states.get(to, (1 << 60, "", [])), (cost + 3, audit + "I", [*out, (role, "")]))
        return states

    states = inserted({"": (0, "", [])})
    for role, text, fault in rows:
        new = {}
        for state, (cost, audit, out) in states.items():
            ways = [(4, "D", None)]
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                ways += [(extra, "K", role), (3 + extra, "R", "user"), (3 + extra, "R", "assistant")]
            for more, edit, as_role in ways:
                to = state if as_role is None else step.get((as_role[:1], state))
                if to is not None:
                    way = (cost + more, audit + edit, out if as_role is None else [*out, (as_role, text)])
                    new[to] = min(new.get(to, way), way)
        states = inserted(new)
    return min(states[s] for s in ("", "a") if s in states)


def expected(rows, best=by_lists):
    """Everything about one conversation's rows (turn, role, text), nulls already spaces."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    marked = faults([r[1:] for r in rows])
    cost, audit, out = best(marked)
    count = lambda f: sum(x[2] == f for x in marked)
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest), out


def drawn(draw, n, roles=("user", "assistant", "system", "user", "assistant", "tool", "")):
    texts = ["Yes.", "No!", "why", "", " \t", "Yes.\n", "é?", "other"]
    return [(draw.choice([None, *range(n + 3)]), draw.choice(roles), draw.choice(texts) + draw.choice(["", str(i) + "."])) for i in range(n)]


def streamed(rows):
    """The program's own result without Spark."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    now = conversations.Conversation("c", conversations.Edits())
    for (turn, role, text), (_, _, fault) in zip(rows, faults([r[1:] for r in rows])):
        end = text.rstrip(SPACE)
        now.add(turn, role, text, fault == "duplicate", not end, bool(end) and end[-1] not in ".!?")
    return now.summary()[1:]


def test_lists_against_every_way():
    draw = random.Random(1)
    for _ in range(60):
        rows = faults([r[1:] for r in drawn(draw, draw.randint(0, 3))])
        assert by_lists(rows)[:2] == every_way(rows)[:2]


def test_steps_against_lists():
    draw = random.Random(2)
    for _ in range(3000):
        rows = drawn(draw, draw.randint(0, 14))
        assert streamed(rows) == expected(rows)[0]


def test_numbers_of_steps_fit_in_two_bytes():
    edits, queue, seen = conversations.Edits(), [], set()
    queue.append(edits.start)
    while queue:
        values = queue.pop()
        if values in seen:
            continue
        seen.add(values)
        for initial, fault in product(["s", "u", "a", ""], [(False, False), (True, False), (False, True)]):
            queue.append(edits.steps[edits.step(values, initial, *fault)][0])
    assert len(edits.steps) < 1 << 16


def test_trails_spill(monkeypatch):
    monkeypatch.setattr(conversations, "HELD", 7)
    draw = random.Random(3)
    for n in (6, 7, 8, 14, 40):
        rows = drawn(draw, n)
        assert streamed(rows) == expected(rows)[0]


def conversations_of(draw):
    rows = []
    for conv in [None, *range(40)]:
        rows += [(conv, *r) for r in drawn(draw, draw.randint(1, 12))]
    rows += rows[5:25]  # repeated rows
    return [(c, t, None if draw.random() < 0.05 else r, None if draw.random() < 0.05 else x) for c, t, r, x in rows]


@pytest.mark.parametrize("batch", ["10000", "3"])
def test_against_lists(spark, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rows = conversations_of(random.Random(4))
    try:
        df = frame(spark, rows)
        repairs = conversations.repair(df)
        got = {r["conv_id"]: tuple(r)[1:] for r in repairs.collect()}
        left = {}
        for r in conversations.repaired_rows(df, repairs).orderBy("place").collect():
            left.setdefault(r["conv_id"], []).append((r["place"], r["edit"], r["role"], r["text"]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 41
    for conv in got:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        want, out = expected(own)
        assert got[conv] == want
        found = left.get(conv, [])
        assert [(r, t) for _, _, r, t in found] == out
        assert "".join(e for _, e, _, _ in found) == want[6].replace("D", "")
        assert [p for p, *_ in found] == list(range(len(found)))


def test_times(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "user", "Gone."), (3, 0, "system", "Twice.")]
    df = frame(spark, rows).withColumn("n", (4 - (spark_col := conversations.F.col("conv_id"))) * (spark_col != 2).cast("int"))
    got = {r["conv_id"]: r for r in conversations.repair(df, times="n").collect()}
    assert [got[1][c] for c in ("duplicate", "audit", "cost")] == [4, "KDDKDD", 16]
    assert tuple(got[2])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert (got[3]["audit"], got[3]["cost"]) == ("D", 4)


def test_one_long_conversation(spark):
    df = spark.range(30_000).selectExpr(
        "7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('Text ', id, if(id % 1000 = 5, '', '.')) as text"
    )
    (row,) = conversations.repair(df.repartition(5)).collect()
    assert (row["truncated"], row["illegal"], row["gaps"], row["cost"]) == (30, 0, 0, 90)
    assert row["audit"] == "K" * 30_000


def test_empty_table_and_extreme_turns(spark):
    assert conversations.repair(frame(spark, [])).collect() == []
    low, high = -(1 << 63), (1 << 63) - 1
    (row,) = conversations.repair(frame(spark, [(1, low, "user", "A."), (1, high, "assistant", "B.")])).collect()
    assert row["gaps"] == high
