import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import corpus, prose

from cubespark.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def brute(words):
    """Every run by comparing words period by period."""
    n, out = len(words), []
    codes = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if n else np.zeros(0, int)
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[0], codes[q:] == codes[:-q], [0]])
        for start, end in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)):
            length = int(end - start) + q
            if length >= max(12, 2 * q):
                run = words[start : start + length]
                if not any(run[:-d] == run[d:] for d in range(1, q)):
                    out.append((int(start), length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    draw = random.Random(3)
    for _ in range(2500):
        n, kinds = draw.randint(0, 70), draw.choice([1, 2, 2, 3, 5, 40])
        words = [b"%d" % draw.randint(0, kinds) for _ in range(n)]
        if n and draw.random() < 0.6:
            a = draw.randrange(n)
            p = 1 + draw.randrange(max(1, (n - a) // 2))
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            words += draw.choice([[], [b"x", *words[:30]], words[-5:]])
        yield words


def test_runs_against_brute_force():
    found = 0
    for words in texts():
        want = brute(words)
        runs = periodic.runs_of(words)
        assert [tuple(r) for r in runs.tolist()] == want
        assert b" ".join(periodic.without_repeats(words, runs)) == collapsed(words, want)
        found += len(want)
    assert found > 1000


def test_stretches_lose_no_run():
    draw = random.Random(5)
    codes = [draw.randint(0, 10**9) for _ in range(300)]
    line = [draw.randint(0, 10**9) for _ in range(20)]
    words = [b"%d" % c for c in codes[:100] + line + codes[100:200] + line + line + codes[200:]]
    raw = np.array([int(w) for w in words], np.uint64)
    assert periodic.repeating_stretches(raw) == [(220, 260)]
    assert periodic.runs_of(words).tolist() == [[220, 40, 20]]


def test_long_texts():
    base = prose(3, 20_000).encode().split()
    words = base[:5000] + [base[5000 + i % 3000] for i in range(15_000)]
    runs = periodic.runs_of(words)
    assert [5000, 15_000, 3000] in runs.tolist()
    assert len(periodic.without_repeats([b"a"] * 20_000, periodic.runs_of([b"a"] * 20_000))) == 1


def test_rows_and_other_columns(spark, documents):
    again = " ".join(["one two three four"] * 5)
    pairs = [*corpus(), (30, again), (31, "  a b\n" * 9 + "c"), (None, again)]
    df = documents(pairs).withColumn("runs", F.lit("mine"))
    got = periodic.periodic_runs(df).collect()
    assert len(got) == len(pairs)
    seen = sorted(((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=str)
    want = []
    for i, t in pairs:
        words = (t or "").encode().split()
        runs = brute(words) if len(words) < 1000 else [tuple(r) for r in periodic.runs_of(words).tolist()]
        want.append((str(i), len(words), runs, collapsed(words, runs).decode()))
    assert seen == sorted(want, key=str)
    assert {r["source"] for r in got} == {"s"}
    (top,) = periodic.periodic_runs(df).where("doc_id = 31").select(periodic.longest(F.col("runs")).alias("top")).collect()
    assert tuple(top["top"]) == (0, 18, 2)


def test_empty_table(spark, documents):
    assert periodic.periodic_runs(documents([])).collect() == []


def edited(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = edited(d["doc_id"], (d["text"] or "").encode().split())
        runs = brute(words)
        some += bool(runs)
        row = got[d["doc_id"]]
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        want = (len(runs), *top, top[1] and 1000 * top[1] // top[2])
        assert tuple(row[c] for c in ("n_runs", "start", "length", "period", "exponent_milli")) == want
        lines = "".join("%d,%d,%d\n" % r for r in runs)
        assert row["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs)).hexdigest()
    assert some > 10


@pytest.mark.parametrize("text", [None, "", " \t\n"])
def test_texts_without_words(spark, tmp_path, text):
    path = str(tmp_path / "in")
    spark.createDataFrame([(i, text) for i in [None, *range(30)]], "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    empty = hashlib.sha256(b"").hexdigest()
    for r in queries.op12_periodic_runs(spark, path).collect():
        assert tuple(r)[1:] == (0, None, None, None, None, empty, empty)
