"""Vocabulary, weighted features and contributions of words over whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import features as X
from tidewater.plans.registry import Registry
from tidewater.session import load, settled

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

SIZE = 5000
COUNTS_SQL = f"""w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{X.TOKEN}') AS ws FROM documents),
  u AS (SELECT doc_id, unnest(ws) AS a, unnest(list_concat(ws[2:], [NULL])) AS b FROM w WHERE len(ws) > 0),
  g AS (SELECT doc_id, a AS term FROM u UNION ALL SELECT doc_id, a || ' ' || b FROM u WHERE b IS NOT NULL),
  c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2),
  v AS (SELECT term, sum(tf)::BIGINT AS freq, count(*) AS df FROM c GROUP BY 1 ORDER BY freq DESC, term LIMIT {SIZE})"""
VALUES_SQL = """x AS (SELECT doc_id, term, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1) AS w FROM c JOIN v USING (term)),
  y AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS value FROM x)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text")


def found() -> Column:
    return X.grams(X.tokens(F.col("text")))


@R.add("q_vocabulary", f"WITH {COUNTS_SQL} SELECT * FROM v")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.vocabulary(documents(spark, sf_dir), found(), SIZE)


@R.add("q_tfidf", f"WITH {COUNTS_SQL}, {VALUES_SQL} SELECT doc_id, term, round(value, 6) AS value FROM y")
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.tfidf(documents(spark, sf_dir), "doc_id", SIZE)
    return rows.withColumn("value", F.round("value", 6))


@R.add("q_scaled_flags", "SELECT doc_id, n_chars / (SELECT max(abs(n_chars)) FROM documents) AS n_chars, regexp_matches(text, '[0-9]')::INT::DOUBLE AS has_number FROM documents")
def scaled_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", "n_chars", F.rlike("text", F.lit("[0-9]")).cast("int").alias("has_number"))
    return X.scaled(rows, ["n_chars", "has_number"])


@R.add(
    "q_strongest_terms",
    f"""WITH {COUNTS_SQL}, {VALUES_SQL}, z AS (SELECT doc_id, term, round(value * length(term), 6) AS part FROM y WHERE value * length(term) > 0.1)
      SELECT doc_id, string_agg(term, '|' ORDER BY k) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part DESC, term) AS k FROM z) WHERE k <= 3 GROUP BY 1""",
)
def strongest_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term's length stands for its weight."""
    docs = documents(spark, sf_dir)
    # Read twice; SIZE rows.
    terms = settled(X.vocabulary(docs, found(), SIZE), "vocabulary")
    rows = X.weighted(docs, found(), "doc_id", terms, docs.count(), SIZE)
    weights = terms.select("term", F.char_length("term").cast("double").alias("weight"))
    return X.strongest(rows, X.spread(weights, SIZE), "doc_id").select("doc_id", F.array_join("terms", "|").alias("terms"))
