import hashlib
from collections import Counter

import numpy as np
import pytest
from texts import corpus, prose

import corpus_pipeline
from cubespark.llm import queries, suffix_dedup

LENGTH = suffix_dedup.LENGTH


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[p : p + LENGTH] for r in raws for p in range(len(r) - LENGTH + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for p in range(len(r) - LENGTH + 1):
            if seen[r[p : p + LENGTH]] > 1:
                gone[p : p + LENGTH] = True
        left = bytes(b for b, g in zip(r, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left.decode(errors="ignore")))
    return out


def check(spark, documents, pairs):
    df = suffix_dedup.remove_repeats(documents(pairs), with_text=False)
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in df.collect()), key=key)
    want = sorted(((i, *b[:4]) for (i, _), b in zip(pairs, brute([t for _, t in pairs]))), key=key)
    assert got == want


def test_against_brute_force(spark, documents):
    check(spark, documents, [(i, t if t is None else t[:9000]) for i, t in corpus()])


def test_near_copies_with_edits_everywhere(spark, documents):
    base = prose(8, 200)
    pairs = [(0, base)]
    for i in range(1, 12):
        at = 97 * i % (len(base) - 5)
        pairs.append((i, base[:at] + "#" * (i % 4) + base[at + i % 3 :]))
    check(spark, documents, pairs)


@pytest.mark.parametrize("size", [399, 400, 401, 480])
def test_lengths_around_the_threshold(spark, documents, size):
    shared = prose(9, 200)[:size]
    check(spark, documents, [(1, "x" + shared + "y"), (2, "z" + shared + "w"), (3, shared[:399])])


def test_segments_of_long_texts(spark, documents, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    raw = prose(10, 900)
    flat = np.frombuffer((raw + raw[:700]).encode(), np.uint8)
    offsets = np.array([0, len(flat)])
    covered = np.zeros(len(flat), int)
    for found in suffix_dedup.anchors(flat, offsets):
        for a, b in zip(found["first"], found["last"]):
            covered[a : b + 1] += 1
    assert (covered[: len(flat) - LENGTH + 1] == 1).all()


def test_empty_table(spark, documents):
    assert suffix_dedup.remove_repeats(documents([])).collect() == []


def test_rewrite_keeps_all_columns(spark, documents):
    pairs = [(i, t if t is None else t[:5000]) for i, t in corpus()]
    out = suffix_dedup.rewrite(documents(pairs))
    assert out.columns == documents(pairs).columns
    want = list((str(i), None if t is None else b[4]) for (i, t), b in zip(pairs, brute([t for _, t in pairs])))
    got = [(str(r["doc_id"]), r["text"]) for r in out.collect()]
    key = lambda r: (r[0], r[1] is None, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_rewrite_with_clashing_names(spark, documents):
    shared = prose(9, 200)
    df = documents([(1, "x" + shared), (2, "y" + shared), (None, None)])
    odd = df.withColumnsRenamed({"lang": "_body", "source": "_runs", "id": "lo", "hash": "c1", "n": "row"})
    out = suffix_dedup.rewrite(odd)
    assert out.schema == odd.schema
    want = dict(zip((1, 2, None), (b[4] for b in brute(["x" + shared, "y" + shared, None])))) | {None: None}
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want
    assert {r["_runs"] for r in out.collect()} == {"s"} and {r["row"] for r in out.collect()} == {1}


@pytest.mark.parametrize("length", [80, 250])
def test_other_lengths(spark, documents, monkeypatch, length):
    shared = prose(31, 200).encode()
    texts = [t for _, t in corpus() if t is None or len(t) < 5000]
    for i, size in enumerate((length - 1, length, length + 1, length + 90)):
        part = shared[150 * i : 150 * i + size].decode(errors="ignore")
        texts += [f"x{i}" + part + prose(40 + i, 30), prose(50 + i, 30) + part + f"{i}y"]
    out = suffix_dedup.rewrite(documents(list(enumerate(texts))), length=length).collect()
    monkeypatch.setattr("test_suffix_dedup.LENGTH", length)
    assert {r["doc_id"]: r["text"] for r in out} == {i: t if t is None else b[-1] for i, (t, b) in enumerate(zip(texts, brute(texts)))}


def test_lengths_that_have_no_cells(documents):
    for length in (79, 252, 640):
        with pytest.raises(ValueError):
            suffix_dedup.rewrite(documents([]), length=length)


def test_stage_goes_by_words(spark, documents):
    """Passages of 51 words go, those of 50 stay unless they have 400 bytes; every copy goes."""
    long, short = ([f"{kind}{i:04d}" for i in range(n)] for kind, n in (("a", 51), ("b", 50)))
    wide = [f"c{i:03d}" + "x" * 20 for i in range(20)]
    pairs, want = [], {}
    for n, words in enumerate((long, short, wide)):
        for i in (10 * n, 10 * n + 1):
            own = f"{prose(60 + i, 20)} <{'pq'[i % 2]}", f"{'pq'[i % 2]}> {prose(90 + i, 20)}"
            passage = f" {' '.join(words)} "
            pairs.append((i, passage.join(own)))
            want[i] = passage.join(own) if words is short else "".join(own)
    assert len(" ".join(long)) < 400 and 250 < len(" ".join(short)) < 400 and len(" ".join(wide)) >= 400
    out = corpus_pipeline.unrepeated(spark, documents(pairs), "").collect()
    assert {r["doc_id"]: r["text"] for r in out} == want
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_query_counts_passages_by_words(spark, documents, monkeypatch):
    """Passages of 51 words that several documents hold are counted below 400 bytes; what is removed goes by 400 bytes."""
    long, short = ([f"{kind}{i:04d}" for i in range(n)] for kind, n in (("a", 51), ("b", 50)))
    wide = [f"c{i:03d}" + "x" * 20 for i in range(20)]
    pairs, want = [], {}
    for n, words in enumerate((long, short, wide)):
        for i in (10 * n, 10 * n + 1):
            passage = f" {' '.join(words)} "
            pairs.append((i, f"{prose(60 + i, 20)} <{'pq'[i % 2]}{passage}{'pq'[i % 2]}> {prose(90 + i, 20)}"))
            want[i] = (0, 0) if words is short else (1, len(passage))
    same = prose(9, 300)
    pairs += [(None, same), (40, same), (41, None), (41, ""), (42, prose(77, 100))]
    want |= {None: (1, len(same.encode())), 40: (1, len(same.encode())), 41: (0, 0), 42: (0, 0)}
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: documents(pairs))
    out = queries.op1_suffix_dedup(spark, "").collect()
    exact = Counter((i, *b[:4]) for (i, _), b in zip(pairs, brute([t for _, t in pairs])))
    assert Counter(tuple(r)[:5] for r in out) == exact
    assert len(out) == len(pairs) and all((r["n_passages"], r["passage_bytes"]) == want[r["doc_id"]] for r in out)
    assert {r["n_removed"] for r in out if r["doc_id"] in (0, 1, 10, 11)} == {0}


def test_passages_beside_repeats(spark, documents):
    """With passages counted, the same bytes go as without, on texts of all kinds."""
    pairs = [(i, t if t is None else t[:9000]) for i, t in corpus()]
    plain, counted = (suffix_dedup.remove_repeats(documents(pairs), words=w) for w in (None, 50))
    assert counted.columns == [*plain.columns, "n_passages", "passage_bytes"]
    rows = counted.collect()
    assert Counter(tuple(r)[:5] for r in rows) == Counter(map(tuple, plain.collect()))
    assert all(r["n_passages"] > 0 for r in rows if r["n_removed"]) and any(r["n_removed"] for r in rows)


def test_copies_beside_parts_of_them(spark, documents):
    """Rows of one text, of one id, several or none, and texts that share a part with them."""
    shared, alone, short = prose(11, 400), prose(12, 300), prose(13, 20)
    pairs = [(None, shared), (1, shared), (1, shared), (2, shared[:450] + "x"), (3, alone), (4, alone), (4, alone)]
    pairs += [(5, short), (6, short), (None, None), (7, ""), (8, None), (9, "y" + shared[-500:] + "z"), (1, "w" + alone[:100])]
    check(spark, documents, pairs)
