"""Evaluation and audit aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value, nulls as one."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def per_class(pairs: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class of (label, predicted), null where undefined."""
    counts = pairs.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("told")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("told")),
    )).alias("s")).select("s.*")
    summed = sides.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("hit", "actual", "told")))
    ratio = lambda a, b: F.when(b > 0, a / b)
    return summed.select(
        "class",
        ratio(F.col("hit"), F.col("told")).alias("precision"),
        ratio(F.col("hit"), F.col("actual")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("told") + F.col("actual")).alias("f1"),
    )


def crosstab_with_margins(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Counts of pairs with totals named All."""
    cube = df.cube(rows, columns).agg(F.count("*").alias("n"), F.grouping(rows).alias("_r"), F.grouping(columns).alias("_c"))
    named = lambda c, g: F.when(F.col(g) == 1, "All").otherwise(F.col(c).cast("string"))
    return cube.select(named(rows, "_r").alias(rows), named(columns, "_c").alias(columns), "n")


def per_class_by(pairs: DataFrame, model: str, danger: str, safe: str) -> DataFrame:
    """For each model: recall of the dangerous class (null without such rows), safe rows told to be dangerous, and macro F1."""
    counts = pairs.groupBy(model, "label", "predicted").agg(F.count("*").alias("n"))
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("long")
    side = lambda c, h, a, t: F.struct(F.col(c).alias("class"), h.alias("hit"), a.alias("actual"), t.alias("told"))
    sides = counts.select(model, F.explode(F.array(side("label", hit, F.col("n"), none), side("predicted", none, none, F.col("n")))).alias("s")).select(model, "s.*")
    classes = sides.groupBy(model, "class").agg(*(F.sum(c).alias(c) for c in ("hit", "actual", "told")))
    scores = classes.groupBy(model).agg(
        F.avg(2 * F.col("hit") / (F.col("told") + F.col("actual"))).alias("macro_f1"),
        F.max(F.when((F.col("class") == danger) & (F.col("actual") > 0), F.col("hit") / F.col("actual"))).alias("recall"),
    )
    wrong = F.when((F.col("label") == safe) & (F.col("predicted") == danger), F.col("n")).otherwise(0)
    alarms = counts.groupBy(model).agg(F.sum(wrong).alias("false_alarms"))
    return scores.join(alarms, model).select(model, "recall", "false_alarms", "macro_f1")
