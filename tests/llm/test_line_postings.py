"""The join of line dedup's second round: one exchange for both sides, of few columns."""

from __future__ import annotations

import re

import pytest

from tallyloom.llm import lines


def test_posting_holds_its_parts(spark):
    from pyspark.sql import functions as F

    parts = [(4, 0, 0), (5, 1, 1), (2_000_000_000, 400_000_000, 1), (72, 14, 0)]
    posted = spark.createDataFrame(parts, "n int, p int, s int").select(lines.posting(F.col("n"), F.col("p"), F.col("s")).alias("np"))
    assert not posted.schema["np"].nullable
    found = posted.select(lines.size_of(F.col("np")), lines.place_of(F.col("np")), lines.settled_of(F.col("np"))).collect()
    assert [tuple(r) for r in found] == parts


@pytest.mark.parametrize("repeats", [False, True])
def test_join_reads_one_exchange_of_few_columns(spark, monkeypatch, repeats):
    own = [(i, " ".join(f"w{(i * 7 + j * j) % 50}" for j in range(12)) + f"\nalso line {i} of the town hall here") for i in range(40)]
    docs = spark.createDataFrame(own + [(3, own[9][1] + " other")] * repeats, "doc_id long, text string")
    plans = []
    real = lines.verified

    def seen(docs, places, pairs):
        plans.append(pairs._jdf.queryExecution().executedPlan().toString())
        return real(docs, places, pairs)

    monkeypatch.setattr(lines, "verified", seen)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert lines.dedup(docs).count() == docs.count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    reused = re.findall(r"ReusedExchange \[([^\]]*)\]", plans[1])
    assert any("xk" in x or "yk" in x for x in reused)
    assert [len(x.split(", ")) for x in reused if "yk" in x or "xk" in x] == [7 if repeats else 6]
