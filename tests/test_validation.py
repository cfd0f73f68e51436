"""Measures of an extraction, on rows by hand."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tallyloom.operators import validation as v

TEXT = "Page\nH:\\shared\\minutes.pdf\nCr Lee MOVED that  the report\nbe received. CARRIED 7/2.\nDEPUTATION by A. MOVED again"


def test_tiers_spans_and_gaps(spark):
    texts = spark.createDataFrame([(1, TEXT), (2, "nothing here")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, 1, "MOVED that the report be"), (1, 2, "there portbereceived.CARR"), (1, 3, "report b e"), (2, 1, "else")], "doc_id long, quote_id long, quote string")
    found = v.tiers(quotes, texts)
    norm = "Page Cr Lee MOVED that the report be received. CARRIED 7/2. DEPUTATION by A. MOVED again"
    got = {(r.doc_id, r.quote_id): (r.tier, r.a, r.z) for r in found.collect()}
    a, b = norm.index("MOVED that"), norm.index("the report")
    assert got == {(1, 1): ("full", a, a + 24), (1, 2): ("stripped", b, norm.index("CARR") + 4), (1, 3): ("paraphrase", None, None), (2, 1): ("paraphrase", None, None)}
    assert [tuple(r) for r in v.coverage(found).select("doc_id", "covered").collect()] == [(1, norm.index("CARR") + 4 - a)]
    assert [tuple(r) for r in v.keyword_gaps(found, texts, v.GAP_WORDS).collect()] == [(1, 3, 2)]


def test_status_and_agreement(spark):
    rows = [(0.0, 0.5, 0.0, 0, 1.0, False, "FAIL"), (0.0, 0.5, 0.0, 3, 0.4, False, "FAIL"), (0.9, 0.01, 0.0, 3, 1.0, False, "FAIL"), (0.9, 0.01, 0.0, 3, 1.0, True, "REVIEW"), (0.1, 0.02, 0.0, 3, 1.0, False, "REVIEW"), (0.1, 0.02, 0.0, 3, 1.0, True, "PASS"), (0.1, 0.5, 0.4, 3, 1.0, False, "REVIEW"), (0.1, 0.5, 0.1, 3, 0.7, False, "REVIEW"), (0.1, 0.5, 0.1, 3, 0.8, False, "PASS")]
    df = spark.createDataFrame(rows, "p double, c double, g double, q int, k double, a boolean, want string")
    assert all(r.s == r.want for r in df.withColumn("s", v.status(*(F.col(x) for x in "pcgqka"))).collect())
    pairs = spark.createDataFrame([(None, 0), (0, 2), (10, 4), (10, 3), (10, 26)], "l int, e int")
    got = [tuple(r.x) for r in pairs.select(v.agreement(F.col("l"), F.col("e")).alias("x")).collect()]
    assert got == [(1.0, False), (math.inf, True), (0.4, False), (0.3, True), (2.6, True)]
