"""Cross-entropy difference between a target and a background language model.

Both models are word bigram models over one vocabulary, all words of all texts (A-Z
lower-cased runs without ASCII white space). The background is counted over every text, the
target over the texts with a given id list, such as those labelled as good. With counts c of
a model, N its words, p0(w) the share of a word in the background, and the same m in both,

    p(w) = (c(w) + m p0(w)) / (N + m)        p(w | h) = (c(h w) + m p(w)) / (c(h) + m),

where the first word of a text has the start as its history, and what p(w | h) leaves is the
chance that the text ends. A text's score is the mean over its words of target loss minus
background loss, in nats: the lower, the more it resembles the target.

The counts are a keyed table that grows with the corpus; no part of it is left out, gathered
or broadcast:

1. Texts are dealt into blocks of some megabytes. A block counts its words and bigrams, which
   combines most of what repeats, and gives them as sorted lists of 64-bit names, one list
   per range of names, written as gaps of six bytes.
2. A range adds up the lists of all blocks, and gives each list the totals of its names.
3. A block meets its totals again, looks up its words in them and scores its texts.

So a name that is in every text is there once per block and never hot. Only the numbers of
words and bytes come to the driver.

Null and empty texts, and those of white space, have no words and null losses. A target without
texts leaves the background's words. Repeated rows count as often as they are there and score
alike, and equal rows go to different blocks; ids in the target list more than once count once,
null ids never. Long texts are hashed in segments; a block holds one as a whole. An empty table
gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespark.llm.batches import IS_SPACE, MIX, mixed, pieces, text_bytes, word_hashes
from cubespark.llm.fingerprints import SEGMENT, cuts
from cubespark.llm.steps import small

BLOCK_BYTES = 1 << 24
GAP = 6  # bytes of a gap between neighbours of a sorted list
RANGE_NAMES = 1 << 21
SMOOTHING = 8.0
START = np.uint64(0x5851F42D4C957F2D)


def words_of(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of texts in a row, and where each text's begin, with the end."""
    parts, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for low, high in pieces(offsets, SEGMENT):
        if offsets[high] - offsets[low] > 2 * SEGMENT:  # one long text
            raw = flat[offsets[low] : offsets[high]]
            found = [word_hashes(raw, np.array([a, b]))[0] for a, b in cuts(raw)]
            parts += found
            counts.append(np.array([sum(map(len, found))]))
        else:
            words, bounds = word_hashes(flat, offsets[low : high + 1])
            parts.append(words)
            counts.append(np.diff(bounds))
    return np.concatenate(parts), np.cumsum(np.concatenate(counts))


def names_of(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The history of each word, and the name of the two together."""
    before = np.empty(len(words), np.uint64)
    before[1:] = words[:-1]
    before[bounds[:-1][np.diff(bounds) > 0]] = START
    return before, mixed((before ^ MIX[1]) * MIX[0] + words)


class Block:
    """Sorted names of a block's words and bigrams, and where each of its words finds its own."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray) -> None:
        words, self.bounds = words_of(flat, offsets)
        before, pairs = names_of(words, self.bounds)
        single, own = np.unique(np.append(words, START), return_inverse=True)
        double, both = np.unique(pairs, return_inverse=True)
        del words, pairs
        every = np.concatenate([single, double])
        order = np.argsort(every, kind="stable")
        self.names = every[order]
        place = np.empty(len(every), np.int64)
        place[order] = np.arange(len(every))
        self.start = place[own[-1]]
        self.word = place[own[:-1]]
        self.pair = place[len(single) + both]
        self.history = np.empty(len(self.word), np.int64)
        self.history[1:] = self.word[:-1]
        self.history[before == START] = self.start

    def counts(self, of: np.ndarray) -> np.ndarray:
        """How often each name is there in the texts that are marked."""
        n = len(self.names)
        mine = np.repeat(of, np.diff(self.bounds))
        found = np.bincount(self.word[mine], minlength=n) + np.bincount(self.pair[mine], minlength=n)
        found[self.start] = (np.diff(self.bounds)[of] > 0).sum()
        return found

    def losses(self, counts: np.ndarray, total: int, shares: np.ndarray) -> np.ndarray:
        """-log p of each word in a model with these counts of the names."""
        alone = (counts[self.word] + SMOOTHING * shares) / (total + SMOOTHING)
        return -np.log((counts[self.pair] + SMOOTHING * alone) / (counts[self.history] + SMOOTHING))

    def means(self, values: np.ndarray) -> np.ndarray:
        """Of each text's words; nan for texts without words."""
        sizes = np.diff(self.bounds)
        text = np.repeat(np.arange(len(sizes)), sizes)
        with np.errstate(invalid="ignore"):
            return np.bincount(text, values, len(sizes)) / sizes


def _ranges(names: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of names begins among sorted ones, with the end."""
    edges = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(names, edges), [len(names)]])


def packed(names: np.ndarray) -> bytes:
    """Sorted names as the first one and gaps, of six bytes where all of them fit."""
    gaps = np.diff(names)
    if len(gaps) and gaps.max() >> np.uint64(8 * GAP):
        return names.astype("<u8").tobytes()
    return names[:1].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :GAP].tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    """The n sorted names."""
    if len(raw) == 8 * n:
        return np.frombuffer(raw, "<u8")
    wide = np.zeros((n - 1, 8), np.uint8)
    wide[:, :GAP] = np.frombuffer(raw, np.uint8, offset=8).reshape(-1, GAP)
    return np.cumsum(np.concatenate([np.frombuffer(raw, "<u8", 1), wide.view("<u8").ravel()]), dtype=np.uint64)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes and words of a task's texts, and words of its target texts."""
    total = np.zeros(3, np.int64)
    for batch in batches:
        flat, offsets = text_bytes(batch, "text")
        target = batch.column("in_target").to_numpy(zero_copy_only=False).astype(bool)
        for low, high in pieces(offsets, SEGMENT):
            raw = flat[offsets[low] : offsets[high]]
            begins = ~IS_SPACE[raw]
            begins[1:] &= ~begins[:-1] | IS_SPACE[raw[:-1]]
            first = offsets[low:high][np.diff(offsets[low : high + 1]) > 0] - offsets[low]
            begins[first] = ~IS_SPACE[raw[first]]
            words = np.concatenate([[0], np.cumsum(begins)])[offsets[low : high + 1] - offsets[low]]
            total += [len(raw), words[-1], np.diff(words)[target[low:high]].sum()]
    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=["bytes", "words", "target_words"])


def _lists(n_ranges: int):
    """Sorted names and counts of each block, whose texts come in a row, range by range."""

    def give(block: int, texts: list, targets: list) -> Iterator[pa.RecordBatch]:
        found = Block(*text_bytes(pa.RecordBatch.from_arrays([pa.concat_arrays(texts)], names=["text"]), "text"))
        target = np.array(targets, bool)
        background, wanted = found.counts(np.ones(len(target), bool)), found.counts(target)
        ends = _ranges(found.names, n_ranges)
        for r in np.flatnonzero(np.diff(ends) > 0):
            at = slice(ends[r], ends[r + 1])
            lists = [pa.array([c[at].astype(np.int32)], pa.list_(pa.int32())) for c in (background, wanted)]
            row = [pa.array([r], pa.int64()), pa.array([block], pa.int64()), pa.array([packed(found.names[at])], pa.binary()), *lists]
            yield pa.RecordBatch.from_arrays(row, names=["range", "block", "names", "background", "target"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, targets = None, [], []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]])
            for low, high in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if low == high:
                    continue
                if blocks[low] != now:
                    if texts:
                        yield from give(now, texts, targets)
                    now, texts, targets = int(blocks[low]), [], []
                texts.append(batch.column("text").slice(low, high - low))
                targets += batch.column("in_target").slice(low, high - low).to_pylist()
        if texts:
            yield from give(now, texts, targets)

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each list its names' counts over all blocks; the lists of a range come in a row."""
    schema = pa.schema([("block", pa.int64()), ("range", pa.int64()), ("background", pa.list_(pa.int32())), ("target", pa.list_(pa.int32()))])

    def give(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        at, inverse = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)
        sums = [np.bincount(inverse, np.concatenate([h[k] for h in held]), len(at)).astype(np.int32) for k in (3, 4)]
        end = 0
        for block, place, names, _, _ in held:
            mine = inverse[end : end + len(names)]
            end += len(names)
            lists = [pa.array([s[mine]], pa.list_(pa.int32())) for s in sums]
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([place]), *lists], schema=schema)

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("block", "range", "names", "background", "target"))):
            block, place = row[0].as_py(), row[1].as_py()
            if held and held[-1][1] != place:
                yield from give(held)
                held = []
            counts = [x.values.to_numpy(zero_copy_only=False) for x in row[3:]]
            held.append((block, place, unpacked(row[2].as_py(), len(counts[0])), *counts))
    if held:
        yield from give(held)


def _scores(words: int, target_words: int, id_type: str):
    """Losses of a block's texts from its names' totals."""
    names = ["id", "n_tokens", "target_loss", "background_loss", "score"]

    def run(texts: pa.Table, totals: pa.Table) -> pa.Table:
        batch = texts.combine_chunks().to_batches()[0]
        found = Block(*text_bytes(batch, "text"))
        totals = totals.sort_by("range")
        background, target = (
            np.concatenate([np.zeros(0, np.int32), *(x.values.to_numpy(zero_copy_only=False) for x in totals.column(c))]) for c in ("background", "target")
        )
        sizes = np.diff(found.bounds)
        if sizes.sum():
            shares = background[found.word] / words
            means = [found.means(found.losses(c, n, shares)) for c, n in ((target, target_words), (background, words))]
        else:
            means = [np.zeros(len(sizes))] * 2
        arrays = [pa.array(x, pa.float64(), mask=sizes == 0) for x in (*means, means[0] - means[1])]
        return pa.Table.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), *arrays], names=names)

    return run


def score(docs: DataFrame, target_ids: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score) of each row; ``target_ids`` has one column."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    ids = target_ids.toDF("_target").where("_target is not null").distinct().withColumn("in_target", F.lit(True))
    marked = rows.join(small(ids, ids.count()), F.col("id") == F.col("_target"), "left")
    marked = marked.select("id", "text", F.coalesce("in_target", F.lit(False)).alias("in_target"))
    sizes = marked.select("text", "in_target").mapInArrow(_sizes, "bytes bigint, words bigint, target_words bigint")
    n_bytes, words, target_words = (x or 0 for x in sizes.agg(F.sum("bytes"), F.sum("words"), F.sum("target_words")).first())
    blocks = max(1, -(-n_bytes // BLOCK_BYTES))
    ranges = max(1, words // RANGE_NAMES)
    # by where a row is read, so that equal rows are spread as well
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))
    dealt = marked.withColumn("block", block).repartition("block")
    lists = dealt.sortWithinPartitions("block").mapInArrow(
        _lists(ranges), "range bigint, block bigint, names binary, background array<int>, target array<int>"
    )
    totals = lists.repartition("range").sortWithinPartitions("range")
    totals = totals.mapInArrow(_totals, "block bigint, range bigint, background array<int>, target array<int>")
    scored = dealt.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(
        _scores(words, target_words, kind), f"id {kind}, n_tokens bigint, target_loss double, background_loss double, score double"
    )
    return scored.withColumnRenamed("id", id_column)
