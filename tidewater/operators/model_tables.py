"""A linear text model that is data: its vocabulary, inverse document frequencies, weights and flags as tables, kept in files
that any reader opens, and classes told by joins on them."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.features import grams, known_counts, spread, tokens, vocabulary, weighted
from tidewater.session import settled

TERMS, FLAGS = "term string, idf double, weights array<double>", "flag string, scale double, weights array<double>"


@dataclass
class TextModel:
    """`labels` in the order of each array of weights; `terms` and `flags` as TERMS and FLAGS; an intercept a label."""

    labels: list[str]
    intercepts: list[float]
    longest: int
    n_terms: int
    terms: DataFrame
    flags: DataFrame

    def save(self, path: str) -> None:
        """Terms and flags as Parquet, the rest as one line of JSON."""
        spark = self.terms.sparkSession
        self.terms.write.parquet(f"{path}/terms")
        self.flags.coalesce(1).write.parquet(f"{path}/flags")
        about = {"labels": self.labels, "intercepts": self.intercepts, "longest": self.longest, "n_terms": self.n_terms}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> TextModel:
    """A model that `save` wrote."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return TextModel(**about, terms=spark.read.schema(TERMS).parquet(f"{path}/terms"), flags=spark.read.schema(FLAGS).parquet(f"{path}/flags"))


def probabilities(rows: DataFrame, model: TextModel, key: str, cleaned: Column | None = None, flags: dict[str, Column] | None = None) -> DataFrame:
    """`rows` with p, an array in the order of the model's labels, and `predicted`, the first label of the greatest.

    A label's margin is its intercept, the weighted values of the row's known terms (frequency times idf, of length 1 over
    all of them), and its weighted flags, divided by their scales. Null text has no terms; `key` tells each row. Terms are
    joined, never collected: only sums by row meet.
    """
    text = F.coalesce("text", F.lit("")) if cleaned is None else cleaned
    counts = known_counts(rows, grams(tokens(text), model.longest), key, model.terms, model.n_terms)
    values = counts.join(spread(model.terms, model.n_terms), "term").withColumn("_w", F.col("tf") * F.col("idf"))
    width = range(len(model.labels))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")))
    sums = values.groupBy(key).agg(*((F.sum(F.col("_w") * F.get("weights", F.lit(i))) / length).alias(f"_m{i}") for i in width))
    by_flag = {r["flag"]: r for r in model.flags.collect()} if flags else {}  # as many as there are flags
    margins = []
    for i in width:
        margin = F.coalesce(F.col(f"_m{i}"), F.lit(0.0)) + F.lit(model.intercepts[i])
        for name, value in (flags or {}).items():
            margin = margin + value / F.lit(by_flag[name]["scale"]) * F.lit(by_flag[name]["weights"][i])
        margins.append(margin)
    told = rows.join(sums, key, "left").withColumn("_margins", F.array(*margins)).drop(*(f"_m{i}" for i in width))
    grown = F.transform("_margins", lambda m: F.exp(m - F.array_max("_margins")))
    p = F.transform(grown, lambda g: g / F.aggregate(grown, F.lit(0.0), lambda s, x: s + x))
    best = F.get(F.array(*map(F.lit, model.labels)), (F.array_position("_margins", F.array_max("_margins")) - 1).cast("int"))
    return told.withColumn("p", p).withColumn("predicted", best).drop("_margins")


def bayes(train: DataFrame, key: str, label: str, size: int = 2_000, longest: int = 2, digits: int = 6) -> TextModel:
    """A naive Bayes model of weighted terms: weights are the logarithms of a term's share of a label's values, one added
    to each, and intercepts those of a label's share of rows. All in aggregates; rounded to so many digits."""
    rows = train.filter(F.col(label).isNotNull())
    n_rows = rows.count()
    found = grams(tokens(F.col("text")), longest)
    # Both are used several times and have `size` rows, or so many a label; texts are read for them once each.
    known = settled(vocabulary(rows, found, size), "vocabulary")
    values = weighted(rows, found, key, known, n_rows, size, label)
    sums = settled(values.groupBy("term", label).agg(F.sum("value").alias("v")), "sums")
    shares = rows.groupBy(label).agg(F.count("*").alias("n")).join(sums.groupBy(label).agg(F.sum("v").alias("all")), label, "left").orderBy(label).collect()
    n_terms = known.count()
    by_term = sums.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct(label, "v"))).alias("v"))
    weight = [F.round(F.log((F.coalesce(F.try_element_at("v", F.lit(s[label])), F.lit(0.0)) + 1.0) / F.lit((s["all"] or 0.0) + n_terms)), digits) for s in shares]
    idf = F.round(F.log((1.0 + n_rows) / (1.0 + F.col("df"))) + 1.0, digits)
    terms = known.join(by_term, "term").select("term", idf.alias("idf"), F.array(*weight).alias("weights"))
    spark = train.sparkSession
    intercepts = spark.range(1).select(F.array(*(F.round(F.log(F.lit(s["n"]) / F.lit(n_rows)), digits) for s in shares))).first()[0] if shares else []
    return TextModel([s[label] for s in shares], list(intercepts), longest, n_terms, terms, spark.createDataFrame([], FLAGS))
