"""Finding 1 of round 3: line dedup cuts texts into tokens once, for the counts and for the sets."""

from __future__ import annotations

import pytest

from tallyloom.llm import lines

TEXTS = ["one two three four five\nsix\tseven  eight ", "one two three four five six\n\n seven eight", "\r\nfive four three two one"]


def test_texts_are_cut_once(spark, monkeypatch):
    """The sets are made of the hashes that were counted, with one step a token; the cache goes."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    plans, real = {}, lines.stored

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(lines, "stored", seen)
    got = {r.doc_id: (r.text, r.lines_gone) for r in lines.dedup(docs).collect()}
    assert got == {0: (TEXTS[0], 0), 1: ("\n seven eight", 1), 2: ("\r", 1)}
    of_sets = plans["lines"].split("InMemoryRelation")[0]
    assert "InMemoryTableScan" in of_sets and "split(" not in of_sets.replace("split(0,", "")
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_cache_goes_after_a_failure(spark, monkeypatch):
    def fails(*_):
        raise RuntimeError("no sets")

    monkeypatch.setattr(lines, "line_sets", fails)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    with pytest.raises(RuntimeError, match="no sets"):
        lines.dedup(docs)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_keys_stand_in_the_order_of_counts(spark):
    """A rarer token has a smaller key, and different tokens have different keys."""
    from pyspark.sql import functions as F

    texts = [" ".join(f"w{i}" for i in range(n)) for n in range(1, 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashed = lines.hashed_lines(docs)
    turns = lines.rarity(hashed)
    words = spark.createDataFrame([(f"w{i}",) for i in range(29)], "w string")
    keys = {r.w: r.k for r in words.select("w", lines.keys_of(F.array(F.xxhash64("w")), turns)[0].alias("k")).collect()}
    assert sorted(keys, key=keys.get) == [f"w{i}" for i in reversed(range(29))]
    made = hashed.select(F.size("hashes").alias("n"), lines.keys_of(F.col("hashes"), turns).alias("k")).collect()
    assert sorted(r.n for r in made) == list(range(1, 30)) and all(list(r.k) == sorted(set(r.k)) and len(r.k) == r.n for r in made)
