"""A corpus pipeline: five stages over documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bpe_trie, decontaminate, language_id, simhash_golay, suffix_dedup
from tidewater.llm.common import boxed, unboxed, written
from tidewater.session import load


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected. Learns from the labelled documents of `docs`; where none is
    labelled nothing can be rejected but texts without a letter, and all others stay."""
    params = language_id.LanguageParams()
    model = language_id.fit(language_id.learn_from(docs), params)
    judged = language_id.predict(boxed(docs, "text"), model, params.least_similarity)
    return unboxed(judged.filter("NOT rejected"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest doc_id."""
    return simhash_golay.keep_first(docs)


def measured(docs: DataFrame) -> DataFrame:
    """`docs` with n_chars as the texts now are."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes and more that documents with smaller ids have; none are left empty."""
    return measured(suffix_dedup.remove_repeats(docs)).filter(F.trim("text") != "")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of benchmark items; documents that are largely such windows go."""
    return measured(decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"))).filter(F.trim("text") != "")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, and whether they decode to the text, of each document."""
    return bpe_trie.encode(docs, bpe_trie.default_vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("decontamination", drop_benchmark),
    ("bpe", encode),
]

#: None: fingerprints, centroids and merges aren't SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below sf_dir, the last one's rows."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
