import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import corpus, prose

from cubespark.llm import quality, toxicity
from cubespark.llm.batches import IS_MARK, mixed, shingle_hashes, word_hashes

LABELS = "doc_id bigint, toxic int, quality int, text string, score double"


def flat_of(texts):
    raws = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
    return np.frombuffer(b"".join(raws), np.uint8), offsets


def labelled_corpus(n=400):
    """Texts with a bad word are toxic, texts of marks are of low quality."""
    draw = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = prose(1000 + i, draw.randint(20, 200)).split(" ")
        toxic, poor = i % 5 == 0, i % 7 == 0
        if toxic:
            words[draw.randrange(len(words))] = draw.choice(["zorgling", "zorgly", "blorf", "blorfen"])
        if poor:
            words = [w + draw.choice(["%%%", "###", "$$$"]) for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic), int(not poor), None, 0.0))
    return docs, labels


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def test_word_and_shingle_hashes_against_python():
    texts = [t or "" for _, t in corpus()][:20] + ["", "x", "a b c d e f"]
    texts = [t[:3000] for t in texts]
    words, bounds = word_hashes(*flat_of(texts))
    hashes, rows = shingle_hashes(words, bounds)
    names, runs = {}, {}
    for i, text in enumerate(texts):
        lower = "".join(c.lower() if c.isascii() else c for c in text)
        own = [w for w in lower.replace("\n", " ").replace("\t", " ").split(" ") if w]
        assert bounds[i + 1] - bounds[i] == len(own)
        for w, h in zip(own, words[bounds[i] : bounds[i + 1]]):
            assert names.setdefault(w, h) == h
        wanted = [tuple(own[k : k + 5]) for k in range(len(own) - 4)] or ([tuple(own)] if own else [])
        assert len(wanted) == (rows == i).sum()
        for w, h in zip(wanted, hashes[rows == i]):
            assert runs.setdefault(w, h) == h
    assert len(set(names.values())) == len(names) and len(set(runs.values())) == len(runs)


def test_prefixes_and_marks():
    words, _, four = word_hashes(*flat_of(["Stupid, stupidly; stup"]), IS_MARK, (4,))
    assert len(words) == 3 and len(set(words.tolist())) == 3 and len(set(four.tolist())) == 1


@pytest.mark.parametrize("operator,label,least", [(toxicity, "toxic", 0.95), (quality, "quality", 0.97)])
def test_held_out_accuracy(spark, documents, operator, label, least):
    docs, labels = labelled_corpus()
    table = documents(docs)
    model = operator.fit(table, spark.createDataFrame(labels, LABELS), label)
    column = {"toxic": 1, "quality": 2}[label]
    truth = {r[0]: r[column] for r in labels}
    got = operator.score(table, model).collect()
    held = [(r["score"], truth[r["doc_id"]]) for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 50 and auc(held) > least
    assert all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_odd_rows(spark, documents, operator):
    """Null, empty and very long texts, repeated rows, null ids, and no labels at all."""
    table = documents(corpus())
    labels = spark.createDataFrame([(None, 1, 1, None, None), (7, 1, 1, None, None), (4, None, None, None, None)], LABELS)
    model = operator.fit(table, labels)
    got = operator.score(table, model).collect()
    assert len(got) == len(corpus()) and all(r["score"] is not None for r in got)
    assert operator.score(documents([]), model).collect() == []


def test_rows_are_found_in_all_partitions(spark):
    found = toxicity.in_one_task(spark.range(0, 100, 1, 5).select(F.spark_partition_id().alias("p")))
    assert {r["p"] for r in found.collect()} == set(range(5)) and found.rdd.getNumPartitions() == 1


def test_held_out_is_the_same_as_in_python(spark):
    ids = spark.createDataFrame([(i,) for i in [*range(200), None]], "doc_id long")
    for r in ids.select("doc_id", toxicity.held_out(ids["doc_id"]).alias("h")).collect():
        assert r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_ftrl_leaves_useless_weights_at_zero():
    draw = np.random.default_rng(3)
    samples = [(np.append(draw.integers(10, 5000, 40), i % 2), i % 2) for i in range(300)]
    at, w = toxicity.train([(np.unique(a), y) for a, y in samples])
    assert len(at) < 600 and dict(zip(at, w))[1] > 0 > dict(zip(at, w))[0]


def test_chunks_cover_every_byte():
    for size in (0, 1, 63, 64, 65, 511, 512, 513, 960, 961, 5000):
        starts = quality.chunk_starts(size)
        assert starts[0] == 0 and starts[-1] + quality.CHUNK >= size
        counts = max(1, -(-(size - (quality.CHUNK - quality.STEP)) // quality.STEP))
        assert len(starts) == counts


def test_gradients_against_differences():
    draw = np.random.default_rng(5)
    model = {k: v.astype(np.float64) for k, v in quality.start().items()}
    model["last"] = draw.normal(0, 0.3, model["last"].shape)
    x = draw.integers(0, 256, (5, quality.CHUNK)).astype(np.uint8)
    firsts, labels = np.array([0, 2, 3]), np.array([1, 0, 1])

    def loss():
        p = 1 / (1 + np.exp(-quality.pooled(quality.responses(model, x)[0], firsts) @ model["last"]))
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    grads = quality._gradients(model, x, firsts, labels)
    for name, g in grads.items():
        for at in draw.integers(0, g.size, 6):
            kept = model[name].flat[at]
            model[name].flat[at] = kept + 1e-5
            up = loss()
            model[name].flat[at] = kept - 1e-5
            down = loss()
            model[name].flat[at] = kept
            assert abs((up - down) / 2e-5 - g.flat[at]) < 1e-4


def test_keep_good_keeps_all_columns(spark, documents):
    docs, labels = labelled_corpus(200)
    table = documents(docs)
    model = quality.fit(table, spark.createDataFrame(labels, LABELS))
    out = quality.keep_good(table, model)
    scores = {r["doc_id"]: r["score"] for r in quality.score(table, model).collect()}
    assert out.columns == table.columns
    assert {r["doc_id"] for r in out.collect()} == {i for i, s in scores.items() if s >= 0.3}


def slow_toxicity(model, text):
    """The score of one text from its features, listed one by one."""
    weights = dict(zip(model[0].tolist(), model[1].tolist()))
    words = [w for w in re.split(rb"[^A-Za-z0-9\x80-\xff]+", text.encode()) if w]

    kinds, mask = [int(k) for k in toxicity.KINDS], (1 << 64) - 1
    names = [int(word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]), IS_MARK)[0][0]) for w in words]
    found = [n * kinds[0] for n in names]
    found += [a * kinds[1] + b * kinds[2] for a, b in zip(names, names[1:])]
    found += [a * kinds[3] + b * kinds[4] for a, b in zip(names, names[2:])]
    for w in words:
        _, _, *prefixes = word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]), IS_MARK, toxicity.PREFIXES)
        found += [int(p[0]) * kinds[5 + i] for i, p in enumerate(prefixes)]
    at = {int(mixed(np.array([x & mask], np.uint64))[0]) >> (64 - toxicity.SPACE_BITS) for x in found}
    total = weights.get(1 << toxicity.SPACE_BITS, 0.0) + sum(weights.get(i, 0.0) for i in at)
    return 1 / (1 + math.exp(-max(-35, min(35, total))))


def slow_quality(model, raw):
    """The score of one text's bytes, filter by filter and place by place."""
    responses = []
    for begin in quality.chunk_starts(len(raw)):
        chunk = raw[begin : begin + quality.CHUNK].ljust(quality.CHUNK, b"\0")
        embedded = [model["embedding"][b] for b in chunk]
        best = [-math.inf] * quality.FILTERS
        for place in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
            window = np.concatenate(embedded[place : place + quality.WIDTH]).astype(np.float64)
            for f in range(quality.FILTERS):
                best[f] = max(best[f], float(window @ model["filters"][:, f]))
        responses.append([max(0.0, b + float(s)) for b, s in zip(best, model["shift"])])
    features = [sum(c) / len(responses) for c in zip(*responses)] + [max(c) for c in zip(*responses)] + [1.0]
    total = sum(x * float(w) for x, w in zip(features, model["last"]))
    return 1 / (1 + math.exp(-max(-35, min(35, total))))


@pytest.mark.parametrize("operator,label", [(toxicity, "toxic"), (quality, "quality")])
def test_scores_against_brute_force(spark, documents, operator, label):
    docs, labels = labelled_corpus(60)
    model = operator.fit(documents(docs), spark.createDataFrame(labels, LABELS), label)
    pairs = [(i, t if t is None else t[:1200]) for i, t in corpus()] + docs[:10]
    got = sorted(((str(r["doc_id"]), r["score"]) for r in operator.score(documents(pairs), model).collect()))
    slow = (lambda t: slow_toxicity(model, t)) if operator is toxicity else (lambda t: slow_quality(model, t.encode()))
    want = sorted((str(i), slow(t or "")) for i, t in pairs)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-4)


def test_ftrl_against_the_formulas():
    """Training, coordinate by coordinate in plain Python."""
    draw = np.random.default_rng(8)
    samples = [(np.unique(draw.integers(0, 30, 6)), int(i % 3 == 0)) for i in range(40)]
    z, n, bias = {}, {}, 1 << toxicity.SPACE_BITS

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        return (math.copysign(toxicity.L1, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(11)
    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(samples)):
            at = [*samples[k][0].tolist(), bias]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - samples[k][1]
            for i in at:
                rate = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - rate * w[i]
                n[i] = n.get(i, 0.0) + g * g
    want = {i: weight(i) for i in z if weight(i)}
    at, w = toxicity.train(samples)
    assert dict(zip(at.tolist(), w.tolist())) == pytest.approx(want)
