import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import corpus, prose

from cubespark.llm import batches, fingerprints, queries

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    words = [w.lower() for w in (text or "").encode().split()]
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def slow(text):
    """A fingerprint bin by bin."""
    flat = np.frombuffer(text.encode(), np.uint8)
    words, bounds = batches.word_hashes(flat, np.array([0, len(flat)]))
    hashes, _ = batches.shingle_hashes(words, bounds)
    bins = {}
    for h in hashes.tolist():
        at, value = h >> (64 - fingerprints.BIN_BITS), h & ((1 << 64 - fingerprints.BIN_BITS) - 1)
        bins[at] = min(bins.get(at, 1 << 64), value)
    if not bins:
        return ""
    first = fingerprints.attempts()
    low = [bins[i if i in bins else min(bins, key=lambda j: first[i, j])] & 15 for i in range(fingerprints.BINS)]
    return bytes(a << 4 | b for a, b in zip(low[::2], low[1::2])).hex()


def test_every_bin_comes_up():
    first = fingerprints.attempts()
    assert first.min() == 1 and first.shape == (fingerprints.BINS, fingerprints.BINS)
    assert len({tuple(r) for r in first.tolist()}) == fingerprints.BINS
    assert all(len(set(r)) == len(r) for r in first.tolist())  # one bin an attempt


def test_fingerprints_bin_by_bin(spark, documents):
    got = Counter((r["n_chars"], r["fingerprint"]) for r in fingerprints.fingerprints(documents(corpus())).collect())
    assert got == Counter((len(t or ""), slow(t or "")) for _, t in corpus())


def test_segments_of_long_texts(monkeypatch):
    text = prose(4, 3000).encode() + b" " * 700 + b"x" * 900 + b" end of it all \n\n"
    offsets = np.array([0, len(text)])
    flat = np.frombuffer(text, np.uint8)
    whole, _ = fingerprints.sketches(flat, offsets)
    monkeypatch.setattr(fingerprints, "SEGMENT", 100)
    assert (fingerprints.sketches(flat, offsets)[0] == whole).all()
    few = b"a" * 150 + b" " * 300 + b"b c"
    short = fingerprints.sketches(np.frombuffer(few, np.uint8), np.array([0, len(few)]))
    monkeypatch.setattr(fingerprints, "SEGMENT", 1 << 19)
    assert (fingerprints.sketches(np.frombuffer(few, np.uint8), np.array([0, len(few)]))[0] == short[0]).all()


@pytest.mark.parametrize("words", [8, 40, 400, 4000])
def test_estimates_are_right_on_average(words):
    draw, errors = random.Random(words), []
    for k in range(60):
        one = [f"{k}w{i}" for i in range(words)]
        cut = draw.randint(0, words)
        other = one[:cut] + [f"{k}v{i}" for i in range(words - cut)]
        raw = [" ".join(x).encode() for x in (one, other)]
        flat, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        bits, some = fingerprints.sketches(flat, offsets)
        got = fingerprints.estimates(bits[:1], some[:1], bits[1:], some[1:])[0]
        errors.append(got - jaccard(" ".join(one), " ".join(other)))
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < (0.12 if words < 100 else 0.05)


def test_likeness_of_columns(spark, documents):
    pairs = [(1, prose(1, 200)), (2, prose(1, 200).upper()), (3, prose(2, 200)), (4, ""), (5, None)]
    found = fingerprints.fingerprints(documents(pairs))
    other = found.select(F.col("doc_id").alias("b"), F.col("fingerprint").alias("other"))
    got = found.join(other, F.col("doc_id") <= F.col("b")).select("doc_id", "b", fingerprints.likeness(F.col("fingerprint"), F.col("other")).alias("x"))
    got = {(r[0], r[1]): r[2] for r in got.collect()}
    assert got[1, 1] == got[4, 5] == got[4, 4] == 1 and got[1, 4] == got[3, 5] == 0 and got[1, 3] < 0.1


def expected(rows):
    """(id, n_chars, digest of the edited text, fingerprint, its fingerprint) and the true similarities."""
    out = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        third = len(text) // 3
        changed = text[: len(text) - third] + after[:third]
        out.append(((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), slow(text), slow(changed)), jaccard(text, changed), jaccard(text, after)))
    return out


@pytest.mark.parametrize("partitions", ["1", "8", "40"])
def test_neighbours_across_partitions(spark, documents, partitions, monkeypatch):
    monkeypatch.setattr(fingerprints, "CHUNK", 3000)
    pairs = [(i, prose(i, 20 + 13 * i % 400) if i % 7 else None if i % 2 else "") for i in range(60)] + [(100, "é" * 50), (101, "𝄞 x " * 300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(documents(pairs)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    rows = sorted(pairs, reverse=True, key=lambda p: p[0])
    assert len(got) == len(rows)
    for want, near_edited, near_next in expected(rows):
        row = got[want[0]]
        assert tuple(row)[:5] == want
        assert abs(row["near_edited"] - near_edited) < 0.2 and abs(row["near_next"] - near_next) < 0.1


def test_repeated_and_null_ids(spark, documents):
    pairs = [(None, prose(1, 50)), (None, prose(1, 50)), (None, None), (5, "a b c d e f"), (5, "a b c d e f"), (5, ""), (9, prose(2, 30))]
    got = fingerprints.edited_fingerprints(documents(pairs)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in pairs)
    top = next(r for r in got if r["doc_id"] == 9)
    heads = [prose(2, 30)[: -(len(prose(2, 30)) // 3)] + after[: len(prose(2, 30)) // 3] for after in ("a b c d e f", "")]
    assert top["edited_sha256"] in [hashlib.sha256(h.encode()).hexdigest() for h in heads]
    # one row follows itself
    (one,) = fingerprints.edited_fingerprints(documents([(1, "abcdef")])).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1


def test_empty_table(spark, documents):
    assert fingerprints.edited_fingerprints(documents([])).collect() == []
    assert fingerprints.fingerprints(documents([])).collect() == []


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op13_fingerprints(spark, SF).collect()}
    errors = []
    for want, near_edited, near_next in expected(sorted(map(tuple, docs), reverse=True)):
        row = got.pop(want[0])
        assert tuple(row)[:5] == want
        errors += [row["near_edited"] - near_edited, row["near_next"] - near_next]
    assert not got and abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
