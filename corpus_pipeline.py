"""The corpus pipeline: five stages on documents, each written and read again.

Every stage works on all rows that the one before it kept, and its decisions take effect. Nulls
in any column are allowed: a null text is scored and encoded as the empty one, is nobody's copy
and holds no benchmark item; rows without an id are judged by their text. Repeated rows leave
one of them. Long texts are worked on whole. Columns beside those of documents, whatever their
names, stay up to the last stage, which gives numbers and digests. An empty table passes all
stages. Ties: of similar documents that of the smallest id stays.
"""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cubespark.llm import bpe, decontaminate, near_dup, quality, suffix_dedup  # noqa: E402
from cubespark.llm.batches import table  # noqa: E402
from cubespark.llm.steps import Steps  # noqa: E402
from cubespark.session import new_dir  # noqa: E402


def in_steps(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows from the shared folder, written there with texts in batches of the size that steps have."""
    return Steps(spark).kept(rows, "texts")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return in_steps(spark, quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels"))))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, linked from a similarity of 0.8 on."""
    return near_dup.keep_one(docs, limit=(80, 100))


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words, or of 400 bytes, that are there more than once."""
    return in_steps(spark, suffix_dedup.rewrite(docs, length=250, words=50))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded bytes."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", good),
    ("MinHash near-dedup", distinct),
    ("suffix-array dedup", unrepeated),
    ("benchmark decontamination", uncontaminated),
    ("byte-level BPE encoding and decoding", encoded),
]

# training, components and doubling rounds are no SQL; tests hold the rows against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = new_dir(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
