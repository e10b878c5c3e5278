"""Toxicity by logistic regression, trained with FTRL-proximal on hashed n-grams.

Words are runs of letters, digits and bytes above 127, A-Z lower-cased. Features of a text,
each once: words, pairs of neighbours, pairs with one word between (skip-grams), and the
first four to eight bytes of words, for forms of a word that training has not seen; all
hashed to 2^20 coordinates. Each coordinate has a learning rate of its own, and the L1 term
keeps most weights at zero, so the model is a short list of (coordinate, weight): at most
2^20 of them, which bounds what is broadcast.

Training reads at most ``rows`` labelled texts, those with the smallest hash of their id, in
one task. Its model goes to the workers, which score every whole text.

Null and empty texts have no feature and get the bias alone. Labels without a text, null
labels and rows of other folds are not used; without any label the score is 0.5. If an id has
several labels, the largest counts. Repeated rows are scored alike. Long texts are scored whole,
each as a piece of its own. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespark.llm.batches import IS_MARK, mixed, pieces, text_bytes, word_hashes

SPACE_BITS = 20
ROWS = 20_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 1.0
PREFIXES = (4, 5, 6, 7, 8)
KINDS = np.random.default_rng(3).integers(1, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def features(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of the texts' features and the text of each, with repeats."""
    words, bounds, *prefixes = word_hashes(flat, offsets, IS_MARK, PREFIXES)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found, of = [words * KINDS[0]], [rows]
    for gap, kind in ((1, 1), (2, 3)):
        same = rows[gap:] == rows[:-gap]
        found.append((words[:-gap] * KINDS[kind] + words[gap:] * KINDS[kind + 1])[same])
        of.append(rows[gap:][same])
    for i, prefix in enumerate(prefixes):
        found.append(prefix * KINDS[5 + i])
        of.append(rows)
    at = (mixed(np.concatenate(found)) >> np.uint64(64 - SPACE_BITS)).astype(np.int64)
    return at, np.concatenate(of)


class Ftrl:
    """FTRL-proximal on sparse rows of ones, with a bias at the last coordinate."""

    def __init__(self, size: int) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * L1 - z
        w = shrunk / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        grown = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (grown - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def train(samples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights that are not zero, from (distinct coordinates, label)."""
    model = Ftrl(1 << SPACE_BITS)
    bias = np.array([1 << SPACE_BITS])
    order = np.random.default_rng(11)
    for _ in range(epochs):
        for i in order.permutation(len(samples)):
            at, label = samples[i]
            model.learn(np.concatenate([at, bias]), label)
    every = model.weights(np.arange(len(model.z)))
    at = np.flatnonzero(every)
    return at, every[at]


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(id, text, label) of at most ``rows`` labelled texts outside the held-out fifth."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most ``rows`` pairs of numbers
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")


def held_out(doc_id):
    """Whether a row belongs to the fifth that is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def in_one_task(sample: DataFrame) -> DataFrame:
    """A bounded sample in one partition; what finds its rows still runs in all partitions."""
    return sample.repartition(1)


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    samples: list[tuple[int, np.ndarray, int]] = []
    for batch in batches:
        flat, offsets = text_bytes(batch, "text")
        labels, ids = batch.column("label").to_numpy(), batch.column("doc_id").to_numpy()
        for low, high in pieces(offsets):
            at, rows = features(flat, offsets[low : high + 1])
            order = np.argsort(rows, kind="stable")
            cuts = np.searchsorted(rows[order], np.arange(1, high - low))
            for i, own in enumerate(np.split(at[order], cuts)):
                samples.append((int(ids[low + i]), np.unique(own).astype(np.int32), int(labels[low + i])))
    # the order of rows in a task may differ from run to run
    samples.sort(key=lambda s: (s[0], s[2], len(s[1])))
    at, w = train([s[1:] for s in samples]) if samples else (np.zeros(0, np.int64), np.zeros(0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], names=["at", "weight"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The model: coordinates and weights, at most 2^20 + 1 of them."""
    sample = labelled(docs, labels, label, rows)
    found = in_one_task(sample).mapInArrow(_train_rows, "at bigint, weight double").toArrow()
    return found.column("at").to_numpy(), found.column("weight").to_numpy()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = sent.value
        weights = np.zeros((1 << SPACE_BITS) + 1)
        weights[at] = w
        for batch in batches:
            flat, offsets = text_bytes(batch, "text")
            total = np.full(len(offsets) - 1, weights[-1])
            for low, high in pieces(offsets):
                found, rows = features(flat, offsets[low : high + 1])
                counts = weights[found] != 0
                pairs = np.unique(rows[counts] * (1 << SPACE_BITS) + found[counts])
                np.add.at(total, low + (pairs >> SPACE_BITS), weights[pairs & ((1 << SPACE_BITS) - 1)])
            scores = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores)], names=["id", "score"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_column)
