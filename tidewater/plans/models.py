"""Classifier queries: the language of documents, learnt from four fifths and told of the rest. SQL can't fit models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import classifier as K
from tidewater.operators import model_tables as T
from tidewater.operators.features import TOKEN
from tidewater.plans.registry import Registry
from tidewater.session import load, scratch

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows to learn from and rows to judge, by the digest of the id."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), 16, 10).cast("int") % 5 == 0
    return docs.filter(~held), docs.filter(held)


@R.add("q_class_probabilities")
def class_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic model, kept as tables and read again; classes are told by joins on these."""
    train, test = parts(spark, sf_dir)
    path = scratch(spark, "model")
    K.as_tables(K.logistic(train, "lang")).save(path)
    return K.told_by_tables(test, T.load_model(spark, path), "doc_id").drop("text")


SIZE = 2_000
HELD_SQL = "('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::INT % 5 = 0"


@R.add(
    "q_model_tables",
    f"""WITH d AS (SELECT doc_id, text, lang, {HELD_SQL} AS held FROM documents),
      w AS (SELECT doc_id, lang, held, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS ws FROM d),
      u AS (SELECT doc_id, lang, held, unnest(ws) AS a, unnest(list_concat(ws[2:], [NULL])) AS b FROM w WHERE len(ws) > 0),
      g AS (SELECT doc_id, lang, held, a AS term FROM u UNION ALL SELECT doc_id, lang, held, a || ' ' || b FROM u WHERE b IS NOT NULL),
      c AS (SELECT doc_id, lang, held, term, count(*) AS tf FROM g GROUP BY ALL),
      v AS (SELECT term, sum(tf) AS freq, count(*) AS df FROM c WHERE NOT held AND lang IS NOT NULL GROUP BY term ORDER BY freq DESC, term LIMIT {SIZE}),
      n AS (SELECT count(*) AS n FROM d WHERE NOT held AND lang IS NOT NULL),
      x AS (SELECT doc_id, lang, term, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS w FROM c JOIN v USING (term), n WHERE NOT held AND lang IS NOT NULL),
      y AS (SELECT doc_id, lang, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS v FROM x),
      s AS (SELECT lang, term, sum(v) AS v FROM y GROUP BY ALL), a AS (SELECT lang, sum(v) AS total FROM s GROUP BY lang),
      l AS (SELECT lang, round(ln(count(*)::DOUBLE / (SELECT n FROM n)), 6) AS intercept FROM d WHERE NOT held AND lang IS NOT NULL GROUP BY lang),
      t AS (SELECT term, l.lang AS lang, round(ln((coalesce(s.v, 0) + 1.0::DOUBLE) / (coalesce(a.total, 0) + (SELECT count(*) FROM v))), 6) AS weight
        FROM v CROSS JOIN l LEFT JOIN s USING (term, lang) LEFT JOIN a ON a.lang = l.lang),
      h AS (SELECT doc_id, term, tf * round(ln((1.0::DOUBLE + (SELECT n FROM n)) / (1.0::DOUBLE + df)) + 1, 6) AS w FROM c JOIN v USING (term) WHERE held),
      k AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS v FROM h),
      m AS (SELECT doc_id, t.lang AS lang, sum(v * weight) AS m FROM k JOIN t USING (term) GROUP BY ALL),
      q AS (SELECT d.doc_id, d.lang, l.lang AS label, coalesce(m, 0) + intercept AS margin FROM d CROSS JOIN l LEFT JOIN m ON m.doc_id = d.doc_id AND m.lang = l.lang WHERE held),
      p AS (SELECT *, exp(margin - max(margin) OVER o) AS grown FROM q WINDOW o AS (PARTITION BY doc_id))
      SELECT doc_id, lang, first(label ORDER BY margin DESC, label) AS predicted, round(max(grown) / sum(grown), 6) AS p FROM p GROUP BY doc_id, lang""",
)
def model_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Bayes model made by aggregates, kept as tables, read again, and scored by joins: the predicted label and its probability."""
    train, test = parts(spark, sf_dir)
    path = scratch(spark, "model")
    T.bayes(train, "doc_id", "lang", SIZE).save(path)
    told = T.probabilities(test, T.load_model(spark, path), "doc_id")
    return told.select("doc_id", "lang", "predicted", F.round(F.array_max("p"), 6).alias("p"))


@R.add("q_boosted_labels")
def boosted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees that end when the rows that judge get no better for 15 rounds."""
    train, test = parts(spark, sf_dir)
    judge = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 5, 4), 16, 10).cast("int") % 5 == 0
    return K.predictions(test, K.boosted(train, "lang", judge, size=300, rate=1.0, depth=3, least=0.05)).drop("text")


@R.add("q_top_coefficients")
def top_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.coefficients(K.logistic(parts(spark, sf_dir)[0], "lang", size=2_000))


@R.add("q_experiment_grid")
def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = parts(spark, sf_dir)
    return K.grid(train, test, "lang", size=2_000)
