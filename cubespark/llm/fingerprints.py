"""Document fingerprints by one-permutation MinHash.

A text's set is its distinct five-word shingles (A-Z lower-cased words without ASCII white
space; with fewer words, all of them as one). Each shingle is hashed once: the high bits
choose one of ``BINS`` bins, the rest is its value, and a bin keeps the least value. An empty
bin takes the value of the first filled bin in an order of its own, by optimal densification:
attempt t of bin i looks at a bin drawn by a hash of (i, t), the same for all texts. Of each
value the low ``BITS`` bits are kept and packed, and spelled as hexadecimal digits.

The share of equal bins estimates the Jaccard similarity J. Bins of different values agree by
chance in one of 2 ** BITS cases, so the share is J + (1 - J) / 2 ** BITS on average, which
``likeness`` corrects, within 0 and 1. With 512 bins of four bits the standard error is 0.025
at J = 0.5.

Null and empty texts, and those of white space, have no shingles: their fingerprint is the
empty string, as like as 1 to another one of these and as like as 0 to all others. Equal texts
have equal fingerprints. Very long texts are hashed in segments cut at white space. Repeated
rows and ids and null ids are rows like others; an empty table gives an empty one. Columns
besides id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubespark.llm.batches import IS_SPACE, mixed, pieces, shingle_hashes, text_bytes, word_hashes
from cubespark.llm.steps import Steps

BIN_BITS, BITS, WORDS = 9, 4, 5
BINS = 1 << BIN_BITS
BYTES = BINS * BITS // 8
CHANCE = 2.0**-BITS
NONE = np.iinfo(np.uint64).max
SEGMENT = 1 << 19


@cache
def attempts() -> np.ndarray:
    """At [i, j] the first attempt of bin i that looks at bin j."""
    first = np.full((BINS, BINS), -1, np.int32)
    own = np.arange(BINS)
    keys = mixed(np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    t, missing = 0, BINS * BINS
    while missing:
        t += 1
        drawn = (mixed(keys + np.array([t], np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - BIN_BITS)).astype(np.int64)
        new = first[own, drawn] < 0
        first[own[new], drawn[new]] = t
        missing -= int(new.sum())
    return first


def filled(bins: np.ndarray) -> np.ndarray:
    """Least values (texts x bins) with each empty bin as its first filled one in order; texts
    without any stay as they are."""
    order = attempts()
    for row in np.flatnonzero(((bins == NONE).any(1)) & ((bins != NONE).any(1))):
        values = bins[row]
        empty, some = np.flatnonzero(values == NONE), np.flatnonzero(values != NONE)
        values[empty] = values[some[order[np.ix_(empty, some)].argmin(1)]] if len(some) > 1 else values[some[0]]
    return bins


def put(bins: np.ndarray, hashes: np.ndarray, rows: np.ndarray) -> None:
    """Lower the bins of the rows to the values of the hashes."""
    at = rows * BINS + (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    np.minimum.at(bins.reshape(-1), at, hashes & np.uint64((1 << (64 - BIN_BITS)) - 1))


def cuts(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Segments that end at white space, near the limit unless a word is longer."""
    at = 0
    while at < len(raw):
        end = at + SEGMENT
        while end < len(raw):
            found = np.flatnonzero(IS_SPACE[raw[end : end + SEGMENT]])
            if len(found):
                end += int(found[0])
                break
            end += SEGMENT
        yield at, min(end, len(raw))
        at = end


def put_long(bins: np.ndarray, raw: np.ndarray) -> None:
    """Bins of one long text; a segment's last words go on to the next one."""
    carried, some = np.zeros(0, np.uint64), False
    for low, high in cuts(raw):
        words = np.concatenate([carried, word_hashes(raw, np.array([low, high]))[0]])
        carried = words
        if len(words) >= WORDS:
            put(bins, *shingle_hashes(words, np.array([0, len(words)]), WORDS))
            carried, some = words[1 - WORDS :], True
    if not some:
        put(bins, *shingle_hashes(carried, np.array([0, len(carried)]), WORDS))


def sketches(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits of each text (texts x bytes) and whether it has shingles."""
    n = len(offsets) - 1
    bits, some = np.zeros((n, BYTES), np.uint8), np.zeros(n, bool)
    for low, high in pieces(offsets, SEGMENT):
        bins = np.full((high - low, BINS), NONE, np.uint64)
        if offsets[high] - offsets[low] > 2 * SEGMENT:
            put_long(bins, flat[offsets[low] : offsets[high]])
        else:
            words, bounds = word_hashes(flat, offsets[low : high + 1])
            put(bins, *shingle_hashes(words, bounds, WORDS))
        some[low:high] = (bins != NONE).any(1)
        kept = (filled(bins) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
        bits[low:high] = kept[:, 0::2] << BITS | kept[:, 1::2]
    return bits, some


def _marks(bits: np.ndarray, some: np.ndarray) -> pa.Array:
    """Packed bits as binary values, empty ones for texts without shingles."""
    return pa.array([row.tobytes() if there else b"" for row, there in zip(bits, some)], pa.binary())


EQUAL = np.array([(x >> BITS == 0) + (x & (1 << BITS) - 1 == 0) for x in range(256)], np.int64)


def estimates(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Corrected similarity, row by row."""
    share = EQUAL[a ^ b].sum(1) / BINS
    found = np.clip((share - CHANCE) / (1 - CHANCE), 0, 1)
    return np.where(some_a & some_b, found, (~some_a & ~some_b).astype(float))


def _bits(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    empty = b"\0" * BYTES
    some = np.array([bool(x) for x in values], bool)
    raw = b"".join(x or empty for x in values)
    return np.frombuffer(raw, np.uint8).reshape(len(values), BYTES), some


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity, 0 to 1, of the texts of two fingerprints; null is like the empty one."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(estimates(*_bits(x), *_bits(y)))

    return of(F.unhex(a), F.unhex(b))


def fingerprints(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of each row."""
    docs = df.select(F.col(id_column).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(x.as_py() or "") for x in batch.column("text")]
            marks = _marks(*sketches(*text_bytes(batch, "text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), marks], names=["id", "n_chars", "fingerprint"])

    kind = docs.schema["id"].dataType.simpleString()
    found = docs.mapInArrow(run, f"id {kind}, n_chars bigint, fingerprint binary")
    return found.select(F.col("id").alias(id_column), "n_chars", F.lower(F.hex("fingerprint")).alias("fingerprint"))


def edited(text: str, following: str) -> str:
    """The text with its last third overwritten by the beginning of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compared(ids: list, texts: list[str], followers: list[str], id_type: pa.DataType) -> list[pa.Array]:
    """Results of texts with what follows each of them. Texts that follow one another are hashed once."""
    changed = [edited(t, f) for t, f in zip(texts, followers)]
    n = len(texts)
    chain = [*texts, *(followers[-1:] if all(map(str.__eq__, texts[1:], followers)) else followers), *changed]
    raw = [x.encode() for x in chain]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    bits, some = sketches(np.frombuffer(b"".join(raw), np.uint8), offsets)
    nexts = slice(1, n + 1) if len(chain) == 2 * n + 1 else slice(n, 2 * n)
    last = slice(len(chain) - n, len(chain))
    return [
        pa.array(ids, id_type),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in raw[last]], pa.string()),
        _marks(bits[:n], some[:n]),
        _marks(bits[last], some[last]),
        pa.array(estimates(bits[:n], some[:n], bits[last], some[last])),
        pa.array(estimates(bits[:n], some[:n], bits[nexts], some[nexts])),
    ]


RESULTS = "n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
NAMES = ["id", *(x.split()[0] for x in RESULTS.split(", "))]
CHUNK = 1 << 22


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows but a partition's last one, and its first and last row for the seams."""
    part = TaskContext.get().partitionId()
    names = ["part", "edge", "text", *NAMES]
    kind, ids, texts, size, first = None, [], [], 0, True

    def seam(edge: str, i, text: str) -> pa.RecordBatch:
        blank = (pa.nulls(1, t) for t in (pa.int64(), pa.string(), *[pa.binary()] * 2, *[pa.float64()] * 2))
        row = [pa.array([part], pa.int32()), pa.array([edge]), pa.array([text], pa.string()), pa.array([i], kind), *blank]
        return pa.RecordBatch.from_arrays(row, names=names)

    def results() -> pa.RecordBatch:
        n = len(ids) - 1
        inner = [pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())]
        return pa.RecordBatch.from_arrays([*inner, *_compared(ids[:-1], texts[:-1], texts[1:], kind)], names=names)

    for batch in batches:
        kind = batch.column("id").type
        for i, value in zip(batch.column("id").to_pylist(), batch.column("text")):
            text = value.as_py() or ""
            if first:
                yield seam("first", i, text)
                first = False
            ids.append(i)
            texts.append(text)
            size += len(text)
            if size > CHUNK and len(ids) > 1:
                yield results()
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
    if len(ids) > 1:
        yield results()
    if ids:
        yield seam("last", ids[-1], texts[-1])


def edited_fingerprints(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text's last floor(n_chars / 3) code points are replaced by the first as many of the
    next row, by descending id (nulls last; rows of one id by the digest of their text), after the
    last row by those of the first. Ranges of ids are sorted and streamed, so each text moves once;
    a range's last row meets the next range's first one in a second, small step.
    """
    spark = df.sparkSession
    steps = Steps(spark)
    docs = df.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    # equal rows are told apart by where they are read, so that a repeated id can be split
    docs = docs.withColumns({"digest": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    order = [F.col("id").desc_nulls_last(), "digest", "at"]
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    kind = docs.schema["id"].dataType.simpleString()
    found = ordered.mapInArrow(_in_order, f"part int, edge string, text string, id {kind}, {RESULTS}")
    found = steps.kept(found, "in-order")
    ends = found.where("edge is not null")
    # one number per task
    parts = sorted(r["part"] for r in ends.where("edge = 'first'").select("part").collect())
    turns = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, after int")
    last = ends.where("edge = 'last'").select("part", "id", "text").join(turns, "part")
    following = ends.where("edge = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following"))
    pairs = last.join(following, "after").select("id", "text", "following")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids, texts, after = (c.to_pylist() for c in row.columns)
                yield pa.RecordBatch.from_arrays(_compared(ids, texts, after, row.column("id").type), names=NAMES)

    seams = pairs.mapInArrow(run, f"id {kind}, {RESULTS}")
    every = found.where("edge is null").select(*NAMES).unionByName(seams)
    shown = {"id": F.col("id").alias(id_column)} | {c: F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")}
    return every.select(*[shown.get(c, F.col(c)) for c in NAMES])
