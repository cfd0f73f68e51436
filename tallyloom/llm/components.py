"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored, tidy


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def stars(edges: DataFrame) -> DataFrame:
    """Of edges (u, v), both long: rows (u, v) with v the smallest node reachable from u, for each u above it.

    Each round hangs every node's larger neighbours, then its smaller ones,
    on the smallest it knows; minima are combined before the shuffle, and each
    round's edges are stored. Rounds grow with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    with tidy(spark):
        seen = _sum(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.select(F.col("u").alias("k"), "m"), F.col("u") == F.col("k")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before)
        with tidy(spark):
            now = _sum(e)
        if now == seen:
            break
        seen = now
    return e
