"""Exact de-duplication with explicit order, and set comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in `order`; give descending columns to keep the last or the best."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def majority(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The most frequent value of each key, the smallest of equals. Counts are summed before they meet."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    best = F.max(F.struct("_n", F.lit(0)))  # the largest count alone; ties are settled by value below
    top = counts.groupBy(key).agg(best.alias("_best"))
    return counts.join(top, key).filter(F.col("_n") == F.col("_best._n")).groupBy(key).agg(F.min(value).alias(name))


def member_count(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many rows of `left` have a key of `right`; duplicates on the left count."""
    return left.join(right.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n"))
