"""Column helpers that operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.when(b != 0, a / b)


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first k rows of each group; the order must end with a key."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_rows(df: DataFrame, order: list[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first k rows of all, with their place: a distributed top-k, then one small window."""
    w = Window.orderBy(*order)
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(w))


def tags_of(df: DataFrame) -> DataFrame:
    """A row for each tag of the comma list ``tags``."""
    return df.withColumn("tag", F.explode(F.split("tags", ","))).withColumn("tag", F.trim("tag")).filter("tag <> ''")
