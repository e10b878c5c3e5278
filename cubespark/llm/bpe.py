"""Byte-level BPE with the tokenizers library, and the way back to bytes.

A vocabulary of ranks (token bytes, number) becomes a BPE model: each byte is
written as one printable character, and every way to split a token into two
others is a merge, ordered by the token's rank. With the pattern of the public
vocabularies texts are cut in front of a space that is followed by a visible
character, where a match of it always begins; each distinct cut is encoded once per
worker and kept in a bounded cache. The tokens of a text are the tokens of its cuts in
a row. With any other pattern a text is encoded as a whole.

Null and empty texts give no tokens. Rows are independent of each other, so
repeated rows give repeated results and empty tables empty ones; other columns
are left alone. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from cubespark.llm.batches import give_back, strings
from cubespark.llm.steps import Steps

CACHE_ENTRIES = 200_000
CACHE_CHARS = 40
# cuts are made only in front of characters that no library takes for white space
CUT = re.compile(r"(?= [\w!-~])")
ODD_SPACE = re.compile(r" (?![\w!-~])")
# letters, then marks that are neither letters, digits nor an apostrophe: the pattern
# takes each of the two as one match
WORD_AND_MARKS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")


def byte_characters() -> dict[int, str]:
    """One printable character per byte: itself if it prints, else one from 256 on.

    Fixed values of this format of vocabularies.
    """
    printable = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank; the vocabulary's size bounds the result."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def build(ranks: dict[bytes, int], pattern: str) -> str:
    """The tokenizer as JSON, to be sent to the workers."""
    names = byte_characters()

    def name(token: bytes) -> str:
        return "".join(names[b] for b in token)

    merges = [
        (name(token[:i]), name(token[i:]))
        for token in sorted(ranks, key=ranks.__getitem__)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    vocabulary = {name(token): rank for token, rank in ranks.items()}
    tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return tokenizer.to_str()


class Codec:
    """Encodes texts to ids and decodes ids to bytes; one per worker."""

    def __init__(self, model: str, cuts: bool = True) -> None:
        self.cuts = cuts
        self.tokenizer = Tokenizer.from_str(model)
        self.merger = self.tokenizer.model
        self.names = byte_characters()
        back = {c: b for b, c in byte_characters().items()}
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        tokens = [b""] * size
        for token, i in vocabulary.items():
            tokens[i] = bytes(back[c] for c in token)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.table = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache: dict[str, bytes] = {}
        self.matches: dict[str, bytes] = {}

    def _match(self, match: str) -> bytes:
        """Ids of one match of the pattern."""
        if (ids := self.matches.get(match)) is None:
            named = match.encode().decode("latin-1").translate(self.names)
            ids = array("I", [x.id for x in self.merger.tokenize(named)]).tobytes()
            if len(self.matches) >= CACHE_ENTRIES:
                self.matches.clear()
            if len(match) <= CACHE_CHARS:
                self.matches[match] = ids
        return ids

    def _cut(self, cut: str) -> bytes:
        """Ids of a cut with the space in front of it."""
        if simple := WORD_AND_MARKS.fullmatch(cut):
            word, marks = simple.groups()
            return self._match(" " + word) + (self._match(marks) if marks else b"")
        return self._any(" " + cut)

    def _any(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if not self.cuts:
            return np.frombuffer(self._any(text), np.uint32)
        if ODD_SPACE.search(text):
            first, *rest = CUT.split(text)
            rest = [x[1:] for x in rest]
        else:
            first, *rest = text.split(" ")
        cache = self.cache
        found = {x: cache.get(x) for x in set(rest)}
        new = [x for x, known in found.items() if known is None]
        found.update(zip(new, map(self._cut, new)))
        if len(cache) + len(new) > CACHE_ENTRIES:
            cache.clear()
        if len(new) <= CACHE_ENTRIES:
            cache.update((x, found[x]) for x in new if len(x) <= CACHE_CHARS)
        ids = [self._any(first)] + list(map(found.__getitem__, rest))
        return np.frombuffer(b"".join(ids), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids; a character may be split over ids."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.arange(int(ends[-1]) if len(ends) else 0)
        return self.table[at + np.repeat(self.starts[ids] - ends + lengths, lengths)].tobytes()

    def byte_ends(self, ids: np.ndarray) -> np.ndarray:
        """Where each token ends in the text's bytes."""
        return np.cumsum(self.lengths[ids])


_CODECS: dict[str, Codec] = {}


def _codec(model: str, cuts: bool) -> Codec:
    """The worker's codec; it outlives a task."""
    key = hashlib.sha256(model.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(model, cuts)
    return _CODECS[key]


def _can_cut(pattern: str) -> bool:
    """What cuts and simple words rely on is known of this pattern only."""
    return pattern == public_tokenizers.PATTERN


def character_ends(text: str, byte_ends: np.ndarray) -> np.ndarray:
    """Byte offsets as offsets of characters that are complete there."""
    raw = np.frombuffer(text.encode(), np.uint8)
    begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    complete = np.concatenate([(raw & 0xC0) != 0x80, [True]])
    return begins[byte_ends] - ~complete[byte_ends]


def encode(df: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of each text, and where each token ends in bytes and in characters."""
    model = df.sparkSession.sparkContext.broadcast(build(read_ranks(path), pattern))
    cuts = _can_cut(pattern)
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value, cuts)
        for batch in batches:
            texts = strings(batch, "text")
            for low in range(0, len(texts), 256):
                part = texts[low : low + 256]
                ids = [codec.encode(x) for x in part]
                ends = [codec.byte_ends(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(low, len(part)),
                        pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                        pa.array(ends, pa.list_(pa.int64())),
                        pa.array([character_ends(t, e) for t, e in zip(part, ends)], pa.list_(pa.int64())),
                    ],
                    names=["id", "ids", "byte_ends", "char_ends"],
                )

    rows = df.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, ids array<int>, byte_ends array<bigint>, char_ends array<bigint>")
    return out.withColumnRenamed("id", id_column)


def decode(df: DataFrame, path: str, pattern: str, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Bytes of each sequence of ids, and their text; null is the empty sequence."""
    model = df.sparkSession.sparkContext.broadcast(build(read_ranks(path), pattern))
    cuts = _can_cut(pattern)
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value, cuts)
        for batch in batches:
            raw = [codec.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            text = pa.array([x.decode(errors="replace") for x in raw], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary()), text], names=["id", "raw", "text"])

    rows = df.select(F.col(id_column).alias("id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, raw binary, text string").withColumnRenamed("id", id_column)


def digests(df: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Number of tokens, digest of the ids, and digest of what they decode to.

    These few bytes per text are written to the shared folder, so that the texts reach the workers
    in batches of the size that steps have.
    """
    spark: SparkSession = df.sparkSession
    model = spark.sparkContext.broadcast(build(read_ranks(path), pattern))
    cuts = _can_cut(pattern)
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value, cuts)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for value in batch.column("text"):
                ids = codec.encode(value.as_py() or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4")).hexdigest())
                of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            columns = [batch.column("id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
            give_back()

    rows = df.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return Steps(spark).kept(out, "digests").withColumnRenamed("id", id_column)
