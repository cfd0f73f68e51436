"""What workers hold: no tokenizer beyond its task, short batches, freed memory."""

from __future__ import annotations

import gc
import weakref

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import packing, shared
from tallyloom.llm.queries import vocabulary


def test_tokens_go_with_their_last_name():
    gc.collect()
    gc.disable()
    try:
        tokens = packing.Tokens(*vocabulary())
        assert len(tokens("some words, and some words")) > 0
        gone = [weakref.ref(tokens), weakref.ref(tokens.known.encoded)]
        del tokens
        assert [g() for g in gone] == [None, None]
    finally:
        gc.enable()


def test_table_of_splits_is_bounded():
    tokens = packing.Tokens(*vocabulary(), keep=2)
    whole = packing.Tokens(*vocabulary())
    text = "one two three four two one"
    assert list(tokens(text)) == list(whole(text)) and len(tokens.known) == 2


@pytest.fixture
def sized(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    yield spark
    spark.conf.set(key, before)


def test_stages_send_short_batches(sized, tmp_path):
    docs = sized.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" word"), 500)).alias("text"))
    corpus_pipeline.pack_sequences(sized, docs.limit(1), str(tmp_path))

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "rows"])

    found = docs.coalesce(1).mapInArrow(sizes, "size long, rows long").collect()
    assert sum(r.rows for r in found) == 6000
    assert max(r.size for r in found) < 2 * shared.BATCH_BYTES
