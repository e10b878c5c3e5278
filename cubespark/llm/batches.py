"""Arrow batches of texts as flat bytes for numpy, in pieces of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# numpy works on some ten arrays of eight bytes per byte of a piece
PIECE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A column of texts; null is the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def give_back() -> None:
    """What finished batches held goes back to the system.

    Workers outlive their tasks and stand by, with all they keep, while others work.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def text_bytes(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the n + 1 offsets; null is empty."""
    column = batch.column(name)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    # before this batch's arrays are made
    give_back()
    return flat, offsets


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes stay near the limit; a longer text is alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
BYTE_CODES = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; one to one."""
    x = (x ^ (x >> np.uint64(31))) * MIX[1]
    return x ^ (x >> np.uint64(29))


def word_hashes(
    flat: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_SPACE, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the words of texts (runs without ASCII white space, A-Z lower-cased),
    and where each text's words begin, with the end.

    ``between`` says which bytes separate words. For each length in ``prefixes`` the hashes of
    the words' first bytes follow.
    """
    low, high = int(offsets[0]), int(offsets[-1])
    raw = flat[low:high]
    at = offsets - low
    visible = ~between[raw]
    begins = visible.copy()
    begins[1:] &= ~visible[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = visible[first]  # a word does not reach into the next text
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds, *[np.zeros(0, np.uint64)] * len(prefixes)
    inside = _inside(starts, len(raw))
    scale = np.full(int(inside.max()) + 1, MIX[0], np.uint64)
    scale[0] = 1
    np.multiply.accumulate(scale, out=scale)
    codes = BYTE_CODES[LOWER[raw]] * scale[inside]
    codes[~visible] = 0
    whole = mixed(np.add.reduceat(codes, starts))
    return whole, bounds, *[mixed(np.add.reduceat(np.where(inside < n, codes, 0), starts) + np.uint64(n)) for n in prefixes]


def _inside(starts: np.ndarray, n: int) -> np.ndarray:
    """Distance of each byte from the start of its word; bytes before the first count from 0."""
    if len(starts) == 0 or starts[0] != 0:
        starts = np.concatenate([[0], starts])
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of each text (of all its words, if fewer), and each run's text."""
    counts = np.diff(bounds)
    total = len(words)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(counts)), counts)
    left = bounds[1:][rows] - np.arange(total)
    found = words.copy()
    for k in range(1, n):
        shifted = np.zeros(total, np.uint64)
        shifted[: total - k] = words[k:] if k < total else 0
        shifted[left <= k] = 0
        found = mixed(found * MIX[0] + shifted)
    first = np.zeros(total, bool)
    first[bounds[:-1][counts > 0]] = True
    keep = (left >= n) | (first & (counts[rows] < n))
    return found[keep], rows[keep]
