"""What texts on their way to Python workers, and the workers themselves, may hold."""

import re
from pathlib import Path

import public_tokenizers
import pytest

import corpus_pipeline
from cubespark.llm import bpe
from cubespark.llm.batches import give_back
from cubespark.llm.steps import BATCH_ROWS


def test_texts_are_encoded_in_batches_of_the_size_of_steps(spark, monkeypatch):
    """The pipeline's last stage took batches of 10,000 texts and more than an executor's memory."""
    total, large = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    docs = spark.range(0, 2500, 1, 1).selectExpr("id as doc_id", "concat('word ', id) as text")
    plain = type(docs).mapInArrow

    def counted(df, run, schema, *args, **kwargs):
        def seen(batches):
            for batch in batches:
                total.add(batch.num_rows)
                large.add(int(batch.num_rows > BATCH_ROWS))
                yield batch

        return plain(df, lambda batches: run(seen(batches)), schema, *args, **kwargs)

    monkeypatch.setattr(type(docs), "mapInArrow", counted)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.digests(docs, path, public_tokenizers.PATTERN).collect()
    assert len(found) == 2500 and all(r["n_tokens"] > 0 for r in found)
    assert total.value == 2500
    assert large.value == 0


def test_what_finished_batches_held_goes_back():
    def anonymous() -> float:
        return int(re.search(r"Anonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()).group(1)) / 1e3

    if not Path("/proc/self/smaps_rollup").exists():
        pytest.skip("no /proc")
    held = [bytes(1000) + str(i).encode() for i in range(100_000)]
    last = [bytes(2000)]  # keeps the top of the heap
    full = anonymous()
    del held
    give_back()
    assert full - anonymous() > 60 and last


def test_stages_that_keep_texts_take_batches_of_the_size_of_steps(spark, documents, monkeypatch):
    large = spark.sparkContext.accumulator(0)
    docs = documents([(i, f"word {i}") for i in range(2500)]).coalesce(1)
    plain = type(docs).mapInArrow

    def counted(df, run, schema, *args, **kwargs):
        def seen(batches):
            for batch in batches:
                large.add(int(batch.num_rows > BATCH_ROWS))
                yield batch

        return plain(df, lambda batches: run(seen(batches)), schema, *args, **kwargs)

    monkeypatch.setattr(type(docs), "mapInArrow", counted)
    monkeypatch.setattr(corpus_pipeline.quality, "fit", lambda docs, labels: corpus_pipeline.quality.start())
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: None)
    for stage in (corpus_pipeline.good, corpus_pipeline.unrepeated):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and len(out.collect()) in (0, 2500)
        assert large.value == 0
