"""Classifiers of texts on weighted words and scaled flags, with Spark ML."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import MaxAbsScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidewater.functions.text import URL_FLAG, clean_ml, spaced_ml
from tidewater.operators import boosting
from tidewater.operators import model_tables as T
from tidewater.operators import terms as W
from tidewater.operators.features import grams, tokens, vocabulary, weighing
from tidewater.session import scratch, settled

#: The strength that a coefficient's square is punished with (the inverse), and rounds of the fit.
C, ROUNDS = 10.0, 100
#: Rounds of boosting after which the scores are written.
SETTLED = 8


FLAG_NAMES = ("f_length", "f_url", "f_number")


def flags_of(text: Column) -> dict[str, Column]:
    """Length, whether there is a link, and whether there is a digit."""
    return {
        "f_length": F.char_length(text).cast("double"),
        "f_url": F.rlike(F.lower(text), F.lit(URL_FLAG)).cast("double"),
        "f_number": F.rlike(text, F.lit("[0-9]")).cast("double"),
    }


def cleaned(rows: DataFrame) -> DataFrame:
    """`rows` (text) with their words and the flags that the features are made of; null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return rows.withColumns({"_tokens": tokens(spaced_ml(F.col("text"))), **flags_of(text)})


def with_terms(rows: DataFrame, longest: int = 2) -> DataFrame:
    """`rows` (cleaned) with their terms, made at each use: runs of words are several times as long as the text."""
    return rows.withColumn("terms", grams(F.col("_tokens"), longest))


def prepared(rows: DataFrame, longest: int = 2) -> DataFrame:
    """`rows` (text) with the terms and the flags that the features are made of; null text is empty."""
    return with_terms(cleaned(rows), longest)


def feature_stages(rows: DataFrame, size: int = 15_000) -> list:
    """Terms weighted by smooth inverse document frequency and one, each row of length 1, beside the scaled flags.

    The vocabulary of `rows` (prepared) is at most `size` terms, the most frequent, ties to the smaller; it goes to the
    driver, which gives it to the model.
    """
    known = vocabulary(rows, F.col("terms"), size).select("term", "df").collect()
    n_rows = rows.count()
    idf = [math.log((1 + n_rows) / (1 + r["df"])) + 1 for r in known]
    return [
        *weighing([r["term"] for r in known], idf),
        VectorAssembler(inputCols=list(FLAG_NAMES), outputCol="flags"),
        MaxAbsScaler(inputCol="flags", outputCol="scaled"),
        VectorAssembler(inputCols=["words", "scaled"], outputCol="features"),
    ]


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """`rows` with `weight`: all rows over the number of labels and the rows of the label. Labels are few."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    totals = counts.agg((F.sum("_n") / F.count("*")).alias("_share")).scalar()
    return rows.join(F.broadcast(counts.withColumn("weight", totals / F.col("_n")).drop("_n")), label)


def learnable(train: DataFrame, label: str) -> DataFrame:
    """The labelled rows of `train`, cleaned and written once: label, words and flags."""
    return settled(cleaned(train.filter(F.col(label).isNotNull())).select(label, "_tokens", *FLAG_NAMES), "cleaned")


def logistic(train: DataFrame, label: str, size: int = 15_000, longest: int = 2, weighted: bool = True) -> PipelineModel:
    """A multinomial logistic regression of `label` on the texts of `train`; vocabulary and weights are those of `train` alone."""
    rows = with_terms(learnable(train, label), longest)
    return fitted(rows, label, feature_stages(rows, size), weighted)


def fitted(rows: DataFrame, label: str, stages: list, weighted: bool) -> PipelineModel:
    """The regression on `rows` (learnable, with terms) by the stages that make their features."""
    rows = balanced(rows, label) if weighted else rows.withColumn("weight", F.lit(1.0))
    index = StringIndexer(inputCol=label, outputCol="target", stringOrderType="alphabetAsc", handleInvalid="error")
    fit = LogisticRegression(
        labelCol="target", weightCol="weight", family="multinomial", maxIter=ROUNDS, regParam=1.0 / (C * max(1, rows.count())), standardization=False
    )
    return Pipeline(stages=[index, *stages, fit]).fit(rows)


@dataclass
class Boosted:
    """`features` (a fitted pipeline) and rounds of one tree a label; `losses` are those of the rows that judge, by round."""

    features: PipelineModel
    start: list[float]
    rate: float
    rounds: list[list[boosting.Tree]]
    losses: list[float]


def boosted(train: DataFrame, label: str, judge: Column, size: int = 2_000, rounds: int = 100, patience: int = 15, rate: float = 0.3, depth: int = 4, least: float = 1e-4) -> Boosted:
    """One boosting of all labels at once: each round fits a regression tree a label to what the probabilities of the rounds
    before lack, on the rows for which `judge` is false. The mean log loss of the others ends it: after `patience` rounds
    without an improvement by `least`, or after `rounds`; the rounds up to the best are kept.

    The trees of a round grow together, a level at a time: tasks count rows and sums by bins (see boosting), Spark adds
    them up, and the driver gets the sums. Features are binned and written once, scores every SETTLED rounds, so neither
    the plan nor the work of a round grows with the rounds.
    """
    labelled = train.filter(F.col(label).isNotNull()).withColumn("_judge", F.coalesce(judge, F.lit(False)))
    every = with_terms(settled(cleaned(labelled).select(label, "_judge", "_tokens", *FLAG_NAMES), "cleaned"))
    fitted_on = every.filter("NOT _judge")
    index = StringIndexer(inputCol=label, outputCol="target", stringOrderType="alphabetAsc", handleInvalid="skip")
    model = Pipeline(stages=[index, *feature_stages(fitted_on, size)]).fit(fitted_on)
    names = list(model.stages[0].labels)
    counts = {r[label]: r["count"] for r in fitted_on.groupBy(label).count().collect()}
    start = [math.log(counts[n] / sum(counts.values())) for n in names]
    n_rows, n_features = sum(counts.values()), len(model.stages[1].vocabulary) + len(FLAG_NAMES)
    told = model.transform(every).select(vector_to_array("features").alias("x"), F.col("target").cast("int").alias("target"), F.col("_judge").alias("judge"))
    places, values = boosting.sparse(F.col("x"), n_features)
    listed = settled(told.select("target", "judge", places.alias("places"), values.alias("values")), "listed")
    cuts = boosting.borders(listed.filter("NOT judge"), n_rows, n_features)
    rows, settled_at, kept, losses, best = settled(boosting.binned(listed, cuts, start), "scores"), 0, [], [], 0
    for turn in range(rounds):
        kept.append(boosting.grown(rows, cuts, kept[settled_at:], rate, len(names), depth))
        if turn % SETTLED == SETTLED - 1:
            rows, settled_at = settled(boosting.rescored(rows, cuts, kept[settled_at:], rate), "scores"), len(kept)
        losses.append(boosting.mean_loss(rows, cuts, kept[settled_at:], rate))
        if losses[-1] < losses[best] - least:
            best = turn
        if turn - best >= patience:
            break
    return Boosted(model, start, rate, kept[: best + 1], losses)


def labels_of(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def probabilities(rows: DataFrame, model: PipelineModel, longest: int = 2) -> DataFrame:
    """`rows` with p_<label> for each label (small letters) and `predicted`, of a logistic model."""
    told = told_of(prepared(rows, longest), model)
    return told.select(*rows.columns, *(f"p_{name.lower()}" for name in labels_of(model)), "predicted")


def told_of(scored: DataFrame, model: PipelineModel) -> DataFrame:
    """`scored` (prepared) with p_<label> and `predicted`."""
    names = labels_of(model)
    told = vector_to_array("probability")
    for stage in model.stages[1:]:
        scored = stage.transform(scored)
    picked = F.array(*map(F.lit, names))[F.col("prediction").cast("int")]
    return scored.withColumns({**{f"p_{name.lower()}": told[i] for i, name in enumerate(names)}, "predicted": picked})


def predictions(rows: DataFrame, model: Boosted) -> DataFrame:
    """`rows` with `predicted`, of boosted trees."""
    scored = prepared(rows)
    for stage in model.features.stages[1:]:
        scored = stage.transform(scored)
    scored = scored.select(*rows.columns, vector_to_array("features").alias("_x"))
    scored = scored.withColumn("scores", boosting.scores_of(F.col("_x"), model.start, model.rate, model.rounds))
    names = F.array(*map(F.lit, model.features.stages[0].labels))
    best = F.get(names, (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))
    return scored.select(*rows.columns, best.alias("predicted"))


def as_tables(model: PipelineModel, longest: int = 2) -> T.TextModel:
    """A logistic model as tables: vocabulary, idf, scales of flags and coefficients."""
    spark = SparkSession.active()
    terms, idf, scales = model.stages[1].vocabulary, model.stages[2].getScalingVec().toArray(), model.stages[5].maxAbs.toArray()
    matrix = model.stages[-1].coefficientMatrix.toArray().T.tolist()
    rows = [(t, float(i), w) for t, i, w in zip(terms, idf, matrix)]
    flags = [(f, float(s) or 1.0, w) for f, s, w in zip(FLAG_NAMES, scales, matrix[len(terms) :])]
    intercepts = model.stages[-1].interceptVector.toArray().tolist()
    return T.TextModel(labels_of(model), intercepts, longest, len(rows), spark.createDataFrame(rows, T.TERMS), spark.createDataFrame(flags, T.FLAGS))


def told_by_tables(rows: DataFrame, model: T.TextModel, key: str) -> DataFrame:
    """`rows` with p_<label> and `predicted` of a logistic model kept as tables."""
    text = F.coalesce("text", F.lit(""))
    told = T.probabilities(rows, model, key, clean_ml(F.col("text")), flags_of(text))
    return told.select(*rows.columns, *(F.get("p", F.lit(i)).alias(f"p_{name.lower()}") for i, name in enumerate(model.labels)), "predicted")


def coefficients(model: PipelineModel, n: int = 20) -> DataFrame:
    """label, term, weight and side: for each label the n terms that speak for it most and those against it. A vocabulary is
    bounded by its size, so its coefficients fit the driver."""
    terms = [*model.stages[1].vocabulary, "length", "url", "number"]
    matrix = model.stages[-1].coefficientMatrix.toArray()
    rows = []
    for label, weights in zip(labels_of(model), matrix):
        order = sorted(range(len(terms)), key=lambda i: (-weights[i], terms[i]))
        rows += [(label, terms[i], float(weights[i]), "for") for i in order[:n]] + [(label, terms[i], float(weights[i]), "against") for i in order[::-1][:n]]
    return SparkSession.active().createDataFrame(rows, "label string, term string, weight double, side string")


def term_features(rows: DataFrame, keep: list[str], terms: Sequence[str], idf: Sequence[float], scales: Sequence[float], longest: int) -> DataFrame:
    """`keep` and `features` of all `rows` (keep, group, words, flags), written once: what feature_stages makes, by batches."""
    size, weights, by = len(terms) + len(FLAG_NAMES), np.array(idf), np.array(scales)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            many = pc.list_value_length(batch["places"]).to_numpy().astype(np.int64)
            places, tf = (batch[c].flatten().to_numpy() for c in ("places", "tf"))
            row = np.repeat(np.arange(n), many)
            values = tf * weights[places]
            values /= np.sqrt(np.bincount(row, values * values, n))[row]
            flags = np.stack([batch[f].to_numpy() for f in FLAG_NAMES], axis=1) / by
            # The flags come after a row's terms.
            starts = np.append(0, np.cumsum(many + len(FLAG_NAMES)))
            at = np.arange(len(row)) + row * len(FLAG_NAMES)
            behind = (starts[1:, None] - len(FLAG_NAMES) + np.arange(len(FLAG_NAMES))).ravel()
            indices, filled = np.empty(starts[-1], np.int32), np.empty(starts[-1])
            indices[at], filled[at] = places, values
            indices[behind], filled[behind] = np.tile(np.arange(size - len(FLAG_NAMES), size), n), flags.ravel()
            offsets = pa.array(starts, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (indices, filled)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *lists], [*keep, "indices", "values"])

    known = W.known_terms(rows, [*keep, *FLAG_NAMES], "_all", {"": list(terms)}, longest, every=True)
    shape = StructType([*(rows.schema[c] for c in keep), *StructType.fromDDL("indices array<int>, values array<double>").fields])
    made = known.mapInArrow(vectors, shape)
    # A sparse vector as Spark keeps it.
    parts = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), "indices", "values")
    path = scratch(rows.sparkSession, "features")
    made.select(*keep, parts.alias("features")).write.parquet(path)
    return rows.sparkSession.read.schema(StructType([*(rows.schema[c] for c in keep), StructField("features", VectorUDT())])).parquet(path)


def grid(train: DataFrame, test: DataFrame, label: str, longest: Sequence[int] = (1, 2), weighted: Mapping[str, bool] = {"none": False, "balanced": True}, size: int = 5_000) -> DataFrame:
    """ngrams, weights, rows and right of each combination: how many test rows each model gets right.

    Words are cut once, terms counted in batches, and the features of a length of runs are written once for all fits on
    them, so that a fit reads numbers alone. The models of one length are fitted side by side.
    """
    worded = [W.joined(F.col("_tokens")).alias("words"), F.lit("").alias("_all"), *FLAG_NAMES]
    learnt = settled(cleaned(train.filter(F.col(label).isNotNull())).select(label, *worded), "cleaned")
    judged = settled(cleaned(test).select(label, *worded), "judged")
    counts = {r[label]: r["count"] for r in learnt.groupBy(label).count().collect()}
    names, n_rows = sorted(counts), sum(counts.values())
    scales = [x or 1.0 for x in learnt.agg(*(F.max(F.abs(F.col(f))) for f in FLAG_NAMES)).first()]

    def by_label(values: Sequence[float]) -> Column:
        return F.create_map(*(F.lit(x) for pair in zip(names, values) for x in pair))[F.col(label)]

    def judge(n: int, name: str, rows: DataFrame, seen: DataFrame) -> tuple[int, str, int, int]:
        weights = [n_rows / len(names) / counts[c] if weighted[name] else 1.0 for c in names]
        targets = by_label([float(i) for i in range(len(names))])
        fit = LogisticRegression(
            labelCol="target", weightCol="weight", family="multinomial", maxIter=ROUNDS, regParam=1.0 / (C * max(1, n_rows)), standardization=False
        )
        model = fit.fit(rows.select(targets.alias("target"), by_label(weights).alias("weight"), "features"))
        told = model.transform(seen.select(targets.alias("target"), "features"))
        return n, name, *told.agg(F.count("*"), F.count_if(F.col("prediction") == F.col("target"))).first()

    out = []
    for n in longest:
        known = W.frequent(learnt, "_all", size, n).get("", [])
        terms, idf = [t for t, _, _ in known], [math.log((1 + n_rows) / (1 + df)) + 1 for _, _, df in known]
        made = [term_features(rows, [label], terms, idf, scales, n) for rows in (learnt, judged)]
        with ThreadPoolExecutor(len(weighted)) as pool:
            out += list(pool.map(lambda f: f(), [inheritable_thread_target(train.sparkSession)(partial(judge, n, name, *made)) for name in weighted]))
    return train.sparkSession.createDataFrame(out, "ngrams int, weights string, rows long, right long")
