"""Registered queries of the operators in this folder, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.llm import (
    bpe,
    conversations,
    decontaminate,
    fingerprints,
    html_text,
    lm_score,
    near_dup,
    periodic,
    quality,
    shards,
    suffix_dedup,
    topk,
    toxicity,
)
from cubespark.llm.batches import table


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and the bytes they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated 400-byte strings, as digests, and its repeated
    passages of over 50 words."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False, words=50)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def _judged(scores: DataFrame, limit: float) -> DataFrame:
    return scores.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted")
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a model of the labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    return _judged(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 0.5)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return shards.shard_by_size(table(spark, sf_dir, "documents"), 24)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of every document under a model of good texts less that under one of all texts."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_score.score(table(spark, sf_dir, "documents"), good)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, by a network trained on labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    return _judged(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 0.3)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with each benchmark item that it holds."""
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near duplicates."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def _crc(*parts: Column) -> Column:
    """Of values with a colon between them; null is one space."""
    return F.crc32(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit(" ")) for p in parts]).cast("binary"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by a rule, with its faults and its cheapest repair."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    damage = _crc(F.col("conv_id"), F.col("turn")) % 20
    damaged = rows.select(
        "conv_id",
        "turn",
        F.when(damage == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(damage == 1, "").when(damage == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(damage == 0, 0).when(damage == 3, 2).otherwise(1).alias("times"),
    )
    return conversations.repair(damaged, times="times")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, a tenth of them with a tail made periodic, with its runs as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    text = F.when(h % 10 == 0, periodic.periodic_tail(F.col("text"), g, 3 + g % 8)).otherwise(F.col("text"))
    found = periodic.periodic_runs(docs.withColumn("text", text)).withColumn("top", periodic.longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col("top")[c].alias(c) for c in ("start", "length", "period")],
        F.floor(F.col("top")["length"] * 1000 / F.col("top")["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how like they and its neighbour's are."""
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_suffix_dedup,
        op2_topk,
        op3_toxicity,
        op4_sharding,
        op5_byte_bpe,
        op6_html_text,
        op7_lm_score,
        op8_quality,
        op9_decontamination,
        op10_near_dup,
        op11_conversation_repair,
        op12_periodic_runs,
        op13_fingerprints,
    )
    return {f.__name__: f for f in operators}


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": topk.ORACLE_SQL, "op9_decontamination": decontaminate.ORACLE_SQL, "op10_near_dup": near_dup.ORACLE_SQL}
