"""The analysis history: pages, statistics, retention, deletion."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page(history: DataFrame, number: int, size: int = 10, label: str | None = None) -> DataFrame:
    """A page of the visible rows, latest first, ids settling ties."""
    rows = history.filter(~F.col("hidden"))
    if label is not None:
        rows = rows.filter(F.col("label") == label)
    return rows.orderBy(F.col("ts").desc(), F.col("id").desc()).offset(number * size).limit(size)


def page_state(history: DataFrame, wanted: int, size: int = 10) -> DataFrame:
    """Total, pages (1 at least), the page shown for the one wanted, and whether others stand beside it."""
    total = history.agg(F.count_if(~F.col("hidden")).alias("total"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long")
    shown = F.greatest(F.lit(0), F.least(F.lit(wanted).cast("long"), F.col("pages") - 1))
    state = total.withColumn("pages", pages).withColumn("page", shown)
    return state.withColumn("has_next", F.col("page") < F.col("pages") - 1).withColumn("has_previous", F.col("page") > 0)


def statistics(history: DataFrame) -> DataFrame:
    """Counts by score over all rows, hidden ones too, in one pass."""
    score = F.col("score")
    return history.agg(
        F.count("*").alias("total"),
        F.count_if(score < 40).alias("safe"),
        F.count_if((score >= 40) & (score < 70)).alias("suspicious"),
        F.count_if(score >= 70).alias("danger"),
    )


def shares(stats: DataFrame) -> DataFrame:
    """Percentages: two rounded half up, the third is the rest."""
    share = lambda c: F.when(F.col("total") > 0, F.floor(100.0 * F.col(c) / F.col("total") + 0.5)).otherwise(0).cast("long")
    two = stats.select(share("danger").alias("danger_pct"), share("suspicious").alias("suspicious_pct"))
    return two.withColumn("safe_pct", 100 - F.col("danger_pct") - F.col("suspicious_pct"))


def retain(history: DataFrame, now: datetime, days: int = 90) -> DataFrame:
    """Rows no older than so many days."""
    return history.filter(F.col("ts") >= F.lit(now) - F.make_dt_interval(F.lit(days)))


def soft_delete(history: DataFrame, ids: DataFrame) -> DataFrame:
    """Hides the rows of the ids; statistics still count them."""
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    return history.join(gone, "id", "left").withColumn("hidden", F.col("hidden") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def upsert(history: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` replace those of equal id."""
    return history.join(rows.select("id"), "id", "left_anti").unionByName(rows)
