"""Quality by a byte-level convolutional network in numpy.

A text's bytes are cut into chunks of 512 that overlap by 64 and cover all of it. Bytes are
embedded, filters eight bytes wide slide over each chunk, and the largest response of each
filter in the chunk is kept. The mean and the maximum of these over a text's chunks give one
probability by a logistic layer. Embedding, filters and the last layer are learned together.

Training reads at most ``rows`` labelled texts, those with the smallest hash of their id, in
one task, and at most 24 chunks of a text per step, drawn anew each time. Scores are from all
chunks of whole texts. The model has about 6,000 numbers.

Null and empty texts are one chunk of padding. Labels without a text, null labels and rows of
other folds are not used; without any label all texts are scored by the untrained network. If
an id has several labels, the largest counts. Repeated rows are scored alike. All chunks of a
long text are scored, some thousands at a time. An empty table gives an empty one. Other
columns are not read; ``keep_good`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespark.llm.batches import pieces, text_bytes
from cubespark.llm.toxicity import in_one_task, labelled

CHUNK, STEP = 512, 448
WIDTH, STRIDE, DEPTH, FILTERS = 8, 2, 8, 24
PLACES = (CHUNK - WIDTH) // STRIDE + 1
ROWS, STEPS, BATCH, TRAIN_CHUNKS = 4000, 1000, 32, 24
BLOCK = 128

Model = dict[str, np.ndarray]


def start() -> Model:
    draw = np.random.default_rng(23)
    scale = (2 / (WIDTH * DEPTH)) ** 0.5
    return {
        "embedding": draw.normal(0, 0.5, (256, DEPTH)).astype(np.float32),
        "filters": draw.normal(0, scale, (WIDTH * DEPTH, FILTERS)).astype(np.float32),
        "shift": np.zeros(FILTERS, np.float32),
        "last": np.zeros(2 * FILTERS + 1, np.float32),
    }


def chunk_starts(size: int) -> np.ndarray:
    """Where the chunks of a text of that many bytes begin; the last one reaches its end."""
    return np.arange(0, max(1, size - (CHUNK - STEP)), STEP)


def chunks(flat: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes of chunks, padded with zeros behind the end of their text."""
    at = begins[:, None] + np.arange(CHUNK)
    inside = at < ends[:, None]
    if not len(flat):
        return np.zeros(at.shape, np.uint8)
    return np.where(inside, flat[np.minimum(at, len(flat) - 1)], 0)


def responses(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest response of each filter in each chunk, where it is, and all windows."""
    e = model["embedding"][x].reshape(len(x), CHUNK * DEPTH)
    windows = np.lib.stride_tricks.sliding_window_view(e, WIDTH * DEPTH, axis=1)[:, :: STRIDE * DEPTH]
    out = windows.reshape(-1, WIDTH * DEPTH) @ model["filters"]
    out = out.reshape(len(x), PLACES, FILTERS)
    return np.maximum(out.max(1) + model["shift"], 0), out, windows


def pooled(h: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Mean and maximum over the chunks of each text, and a one."""
    counts = np.diff(np.append(firsts, len(h)))[:, None]
    mean = np.add.reduceat(h, firsts, axis=0) / counts
    return np.concatenate([mean, np.maximum.reduceat(h, firsts, axis=0), np.ones_like(mean[:, :1])], 1)


def _gradients(model: Model, x: np.ndarray, firsts: np.ndarray, labels: np.ndarray) -> Model:
    h, out, windows = responses(model, x)
    place = out.argmax(1)
    features = pooled(h, firsts)
    error = (1 / (1 + np.exp(-(features @ model["last"]))) - labels) / len(labels)
    counts = np.diff(np.append(firsts, len(x)))
    text = np.repeat(np.arange(len(firsts)), counts)
    back = error[:, None] * model["last"][None, :-1]
    mean, most = back[:, :FILTERS], back[:, FILTERS:]
    at_most = h == features[:, FILTERS : 2 * FILTERS][text]
    g = (mean / counts[:, None])[text] + np.where(at_most, most[text], 0)
    g = np.where(h > 0, g, 0).astype(np.float32)
    chunk = np.arange(len(x))[:, None]
    chosen = windows[chunk, place]  # chunk x filter x window
    by_byte = (g[:, :, None] * model["filters"].T[None]).reshape(-1, DEPTH)
    at = x[chunk[:, :, None], (place * STRIDE)[:, :, None] + np.arange(WIDTH)].ravel()
    embedding = np.stack([np.bincount(at, by_byte[:, d], 256) for d in range(DEPTH)], 1)
    return {
        "embedding": embedding.astype(np.float32),
        "filters": np.einsum("cf,cfw->wf", g, chosen),
        "shift": g.sum(0),
        "last": (features * error[:, None]).sum(0).astype(np.float32),
    }


def train(texts: list[bytes], labels: list[int], total: int = STEPS) -> Model:
    model = start()
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    draw = np.random.default_rng(29)
    y = np.array(labels, np.float32)
    steps = 0
    while steps < total:
        order = draw.permutation(len(texts))
        for low in range(0, len(order), BATCH):
            rows = order[low : low + BATCH]
            x, firsts, n = [], [], 0
            for i in rows:
                starts = chunk_starts(len(texts[i]))
                if len(starts) > TRAIN_CHUNKS:
                    starts = draw.choice(starts, TRAIN_CHUNKS, replace=False)
                flat = np.frombuffer(texts[i], np.uint8)
                x.append(chunks(flat, starts, np.full(len(starts), len(flat))))
                firsts.append(n)
                n += len(starts)
            grads = _gradients(model, np.concatenate(x), np.array(firsts), y[rows])
            steps += 1
            rate = 0.01 * (1 - steps / (total + 1))
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                step = first[k] / (1 - 0.9**steps) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)
                model[k] -= np.float32(rate) * step.astype(np.float32)
    return model


def probabilities(model: Model, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One probability per text, from all of its chunks."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-(sizes - (CHUNK - STEP)) // STEP))
    firsts = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(sizes)), counts)
    begins = offsets[:-1][text] + STEP * (np.arange(len(text)) - firsts[text])
    ends = offsets[1:][text]
    h = np.empty((len(text), FILTERS), np.float32)
    for low in range(0, len(text), BLOCK):
        part = slice(low, low + BLOCK)
        h[part] = responses(model, chunks(flat, begins[part], ends[part]))[0]
    logits = pooled(h, firsts) @ model["last"]
    return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -35, 35)))


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    samples: list[tuple[int, int, bytes]] = []
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("doc_id", "label", "text")]
        samples += [(i, label, text.encode()) for i, label, text in zip(*columns)]
    samples.sort()  # the order of rows in a task may differ from run to run
    model = train([s[2] for s in samples], [s[1] for s in samples]) if samples else start()
    arrays = [pa.array(list(model)), pa.array([v.tobytes() for v in model.values()], pa.binary())]
    yield pa.RecordBatch.from_arrays(arrays, names=["name", "weights"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS) -> Model:
    found = in_one_task(labelled(docs, labels, label, rows)).mapInArrow(_train_rows, "name string, weights binary").collect()
    shapes = {k: v.shape for k, v in start().items()}
    return {r["name"]: np.frombuffer(r["weights"], np.float32).reshape(shapes[r["name"]]) for r in found} or start()


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = text_bytes(batch, "text")
            found = [probabilities(sent.value, flat, offsets[a : b + 1]) for a, b in pieces(offsets)]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores)], names=["id", "score"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_column)


def keep_good(docs: DataFrame, model: Model, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows whose score is not below the limit, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = text_bytes(batch, text)
            found = [probabilities(sent.value, flat, offsets[a : b + 1]) for a, b in pieces(offsets)]
            yield batch.filter(pa.array(np.concatenate(found) >= least)) if found else batch

    return docs.mapInArrow(run, docs.schema)
