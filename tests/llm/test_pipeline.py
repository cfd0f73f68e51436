"""The stages, each on its own input."""

from __future__ import annotations

import corpus_pipeline
from tallyloom.llm import simhash
from tallyloom.llm.shared import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), "stage")
        if name != "packing":
            assert out.columns == columns
        if name == "SimHash near-dedup":
            fps = [r.fp for r in simhash.fingerprints(out, words=5).collect()]
            assert len(fps) == len(set(fps))
        kept.append(out.count())
        docs = out
    assert kept[1] <= kept[0] and kept[2] <= kept[1] and kept[3] <= kept[2]
    per = {}
    for r in docs.collect():
        assert len(r.ids) == 4 * r.length
        per.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in per.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_clean_documents_stay(spark):
    rows = [(i, f"document {i} speaks of matter {i * 7} and road {i * 13} in town {i * 17} at length {i * 19}", "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100, rows[3][1], "en", "s0", 0), (3, rows[3][1], "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lines_kept = {r.doc_id for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    assert lines_kept == set(range(40))
    near = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert near == list(range(40))
