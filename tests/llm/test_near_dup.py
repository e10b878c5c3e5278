import re
from collections import Counter

import numpy as np
from texts import corpus, prose

import corpus_pipeline
from cubespark.llm import near_dup
from cubespark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    if len(w) >= 5:
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def brute(pairs):
    sets = [(i, shingle_set(t)) for i, t in pairs]
    label = {i: i for i, _ in pairs if i is not None}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return sorted((str(i), len(s), i and root(i), i is None or root(i) == i) for i, s in sets)


def check(documents, pairs):
    got = near_dup.near_duplicates(documents(pairs)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(pairs)


def test_against_brute_force(spark, documents):
    check(documents, corpus())


def test_chains_of_edits(spark, documents):
    """Neighbours link, ends do not: the component is the whole chain."""
    words = prose(1, 120).split(" ")
    pairs = []
    for i in range(30):
        words[(7 * i) % 115] = f"e{i}"
        pairs.append((100 - i, " ".join(words)))
    check(documents, pairs)


def test_one_group_with_members_that_do_not_link(spark, documents):
    words = prose(2, 150).split(" ")
    draw = np.random.default_rng(1)
    pairs = []
    for i in range(80):
        own = words.copy()
        for at in draw.integers(0, 150, draw.integers(0, 9)):
            own[at] = f"q{i}"
        pairs.append((i, " ".join(own)))
    check(documents, pairs)


def test_rows_that_repeat(spark, documents):
    """Ten thousand equal rows are one node, compared once."""
    a = prose(3, 80)
    near = a.rsplit(" ", 1)[0] + " end"
    pairs = [(i % 3, a) for i in range(10_000)] + [(50, near)] * 2000 + [(60, prose(4, 80))]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(documents(pairs)).collect())
    copies = Counter(i % 3 for i in range(10_000))
    want = {(i, 76, 0, i == 0): n for i, n in copies.items()}
    assert got == want | {(50, 76, 0, False): 2000, (60, 76, 60, True): 1}


def test_a_bucket_with_one_stray(spark, documents, monkeypatch):
    """A large component's members meet the stray, and not one another again."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    words = prose(5, 120).split(" ")
    pairs = []
    for i in range(200):
        own = words.copy()
        own[60] = f"q{i}"
        pairs.append((i, " ".join(own)))
    stray = words.copy()
    for at in (10, 20, 30, 40, 50):
        stray[at] = "z"
    check(documents, pairs + [(900, " ".join(stray))])


def test_a_group_just_below_the_limit(spark, documents, monkeypatch):
    """Members that look alike and hardly link: steps hold a row per member and band, not one per pair."""
    words = prose(6, 300).split(" ")
    draw = np.random.default_rng(3)
    pairs = []
    for i in range(150):
        own = words.copy()
        for at in draw.choice(60, 5, replace=False) * 5:
            own[at] = f"q{i}"
        pairs.append((i, " ".join(own)))
    pairs.append((200, pairs[149][1] + " end"))
    rows, kept = {}, near_dup.Steps.kept

    def counted(self, df, label):
        out = kept(self, df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(near_dup.Steps, "kept", counted)
    got = near_dup.near_duplicates(documents(pairs), limit=(80, 100)).collect()
    sets = [(i, shingle_set(t)) for i, t in pairs]
    linked = [(i, j) for n, (i, a) in enumerate(sets) for j, b in sets[:n] if 100 * len(a & b) >= 80 * len(a | b)]
    want = {i: i for i, _ in pairs}
    for _ in pairs:
        for i, j in linked:
            want[i] = want[j] = min(want[i], want[j])
    assert len(set(want.values())) > 100 and {r["doc_id"]: r["component_id"] for r in got} == want
    assert rows["members"] / 10 < rows["close"] <= rows["members"] and rows["more-links"] <= 20


def test_names_that_clash(spark, documents):
    a = prose(3, 80)
    df = documents([(1, a), (2, a), (3, prose(4, 80)), (None, a)])
    odd = df.withColumnsRenamed({"lang": "_id", "source": "_name", "id": "_row", "hash": "_n"})
    out = near_dup.keep_one(odd)
    assert out.columns == odd.columns and out.schema["_id"].dataType == odd.schema["_id"].dataType
    assert sorted((r["doc_id"], r["_id"], r["_name"]) for r in out.collect()) == [(1, None, "s"), (3, None, "s")]


def test_ids_that_are_no_numbers_count_as_null(spark):
    df = spark.createDataFrame([("x1", prose(1, 30)), ("2", prose(1, 30)), ("3", prose(1, 30))], "doc_id string, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df).collect()}
    assert got == {None: (None, True), 2: (2, True), 3: (2, False)}


def test_rows_that_share_an_id(spark, documents):
    a, b = prose(3, 80), prose(4, 80)
    got = near_dup.near_duplicates(documents([(1, a), (5, a), (5, b), (9, b)])).collect()
    assert {r["component_id"] for r in got} == {1}


def test_empty_table_and_only_empty_texts(spark, documents):
    assert near_dup.near_duplicates(documents([])).collect() == []
    check(documents, [(1, None), (2, ""), (3, " ")])


def test_keep_one(spark, documents):
    out = near_dup.keep_one(documents(corpus()))
    assert out.columns == documents([]).columns
    assert {r["doc_id"] for r in out.collect()} == {1, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14, 15, 16, 17, 18, None}


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 400)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {400: 400, 500: 400}


def between_limits():
    """Two texts whose similarity is between 0.8 and 0.85, and one unlike them."""
    words = prose(21, 200).split(" ")
    other = words.copy()
    for at in (20, 60, 100, 140):
        other[at] = f"other{at}"
    a, b = " ".join(words), " ".join(other)
    assert 0.8 <= len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b)) < 0.85
    return [(1, a), (2, b), (3, prose(22, 200))]


def test_limit_of_links(spark, documents):
    docs = documents(between_limits())
    got = {limit: {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, limit=limit).collect()} for limit in ((85, 100), (80, 100))}
    assert got == {(85, 100): {1: 1, 2: 2, 3: 3}, (80, 100): {1: 1, 2: 1, 3: 3}}


def test_pipeline_stage_links_from_four_fifths(spark, documents):
    out = corpus_pipeline.distinct(spark, documents(between_limits()), "")
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def test_bands_miss_few_pairs_at_the_limit():
    assert near_dup.banding((85, 100))[1:] == (44, 8)
    for percent in (50, 70, 80, 85, 95, 100):
        plan = near_dup.banding((percent, 100))
        assert (1 - (percent / 100) ** plan.rows) ** plan.bands <= 1e-6 and plan.minima <= near_dup.MINIMA


def test_keep_one_counts_rows(spark, documents):
    """Repeated rows, rows that share an id, and rows without one leave a single row of each text."""
    a, b, c, d = (prose(i, 80) for i in (31, 32, 33, 34))
    close = d.rsplit(" ", 1)[0] + " end"
    pairs = [(1, a), (1, a), (1, a), (5, a), (None, a), (None, b), (None, b), (6, c), (6, d), (6, close), (7, ""), (7, None), (None, None), (None, "")]
    out = near_dup.keep_one(documents(pairs))
    assert out.columns == documents([]).columns
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect())
    six = [t for i, t in got if i == "6"]
    assert len(six) == 2 and c in six and (d in six or close in six)
    assert [x for x in got if x[0] != "6"] == sorted([("1", a), ("None", b), ("7", ""), ("None", ""), ("None", "")])
