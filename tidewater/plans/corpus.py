"""Corpus summary: the smallest end-to-end slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.dedup import keep_first, majority, member_count
from tidewater.operators.split import capped, ranked, share_capped, stratified
from tidewater.plans.registry import Registry
from tidewater.session import load

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add(
    "q_corpus_summary",
    r"""
WITH d AS (
  SELECT doc_id, lang, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS key
  FROM documents WHERE trim(text) <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, key ORDER BY doc_id) AS rn FROM d),
l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)
SELECT lang, count(*) AS n_rows, sum((rn = 1)::INT)::BIGINT AS n_kept, sum((rn > 1)::INT)::BIGINT AS n_removed,
       sum(CASE WHEN rn = 1 AND quality = 1 THEN 1 ELSE 0 END)::BIGINT AS n_good
FROM r LEFT JOIN l USING (doc_id) GROUP BY lang
""",
)
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    # The digest stands for the text from here on: only 32 hex digits go through the shuffle.
    docs = load(spark, sf_dir, "documents").filter(F.trim("text") != "").select("doc_id", "lang", F.md5(key).alias("key"))
    # Copies are summed up where they are; only the first of each key meets the labels.
    firsts = docs.groupBy("lang", "key").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    labels = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return (
        firsts.join(labels, "doc_id", "left")
        .groupBy("lang")
        .agg(
            F.sum("n").alias("n_rows"),
            F.count("*").alias("n_kept"),
            (F.sum("n") - F.count("*")).alias("n_removed"),
            F.count_if(F.col("quality") == 1).alias("n_good"),
        )
    )


KEY_SQL = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the key of de-duplication instead of the text."""
    key = F.md5(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")))
    return load(spark, sf_dir, "documents").select("doc_id", "lang", "source", key.alias("key"))


def kept_sql(keys: str, order: str) -> str:
    return f"""SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn
      FROM (SELECT doc_id, lang, source, {KEY_SQL} AS key FROM documents)) WHERE rn = 1"""


def kept(name: str, keys: list[str], order: list[str], latest: bool = False) -> None:
    """A keep-first (or keep-last) query; `order` holds SQL expressions that both engines read."""
    direction = " DESC" if latest else ""

    @R.add(name, kept_sql(", ".join(keys), ", ".join(o + direction for o in order)))
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        columns = [F.expr(o).desc() if latest else F.expr(o).asc() for o in order]
        return keep_first(keyed(spark, sf_dir), keys, columns).select("doc_id", "lang", "source")


PRIORITY = "CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END"
kept("q_dedup_first", ["key"], ["doc_id"])
kept("q_dedup_last", ["key"], ["doc_id"], latest=True)
kept("q_dedup_lang", ["lang", "key"], ["doc_id"])
kept("q_dedup_triple", ["key", "source", "lang"], ["doc_id"])
kept("q_dedup_best", ["key"], [PRIORITY, "doc_id"])


@R.add(
    "q_leakage_dedup",
    f"""WITH d AS (SELECT doc_id, lang, source, {KEY_SQL} AS key FROM documents),
      c AS (SELECT key, lang, count(*) AS n FROM d GROUP BY 1, 2),
      m AS (SELECT key, lang AS major FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, lang) AS rn FROM c) WHERE rn = 1)
      SELECT doc_id, lang, source FROM (SELECT d.*, row_number() OVER (PARTITION BY key
        ORDER BY (lang = major)::INT DESC, {PRIORITY}, doc_id) AS rn FROM d JOIN m USING (key)) WHERE rn = 1""",
)
def leakage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each key: the first of its most frequent language. Copies are summed up by key and language, and only
    these sums meet by key."""
    by_lang = keyed(spark, sf_dir).groupBy("key", "lang").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "source")).alias("best"))
    chosen = by_lang.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang", "best")).alias("top"))
    return chosen.select("top.best.doc_id", "top.lang", "top.best.source")


@R.add(
    "q_mode",
    """SELECT source, lang AS major FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rn
      FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)) WHERE rn = 1""",
)
def mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return majority(load(spark, sf_dir, "documents"), "source", "lang", "major")


@R.add("q_semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = load(spark, sf_dir, "labels").filter("quality = 1")
    return load(spark, sf_dir, "documents").select("doc_id", "lang").join(good, "doc_id", "left_semi")


@R.add("q_anti_join", "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels"), "doc_id", "left_anti")


@R.add(
    "q_member_count",
    f"""WITH d AS (SELECT source, {KEY_SQL} AS key FROM documents)
      SELECT count(*) AS n FROM d WHERE source <> 'src0' AND key IN (SELECT key FROM d WHERE source = 'src0')""",
)
def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed(spark, sf_dir)
    return member_count(docs.filter("source <> 'src0'"), docs.filter("source = 'src0'"), "key")


def set_query(name: str, operation: str, sql: str) -> None:
    @R.add(name, f"SELECT DISTINCT md5(key) AS key FROM (SELECT {KEY_SQL} AS key FROM documents WHERE source = 'src1' {sql} SELECT {KEY_SQL} FROM documents WHERE source = 'src2')")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = keyed(spark, sf_dir)
        a, b = (docs.filter(F.col("source") == s).select("key") for s in ("src1", "src2"))
        return getattr(a, operation)(b).distinct()


set_query("q_overlap", "intersect", "INTERSECT")
set_query("q_except", "subtract", "EXCEPT")
set_query("q_union_distinct", "union", "UNION")


@R.add(
    "q_coverage",
    f"""SELECT md5(key) AS key, max((lang = 'en')::INT)::INT AS in_en, max((lang = 'fr')::INT)::INT AS in_fr, max((lang = 'de')::INT)::INT AS in_de
      FROM (SELECT lang, {KEY_SQL} AS key FROM documents) GROUP BY key""",
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir).groupBy("key").agg(*(F.max((F.col("lang") == c).cast("int")).alias(f"in_{c}") for c in ("en", "fr", "de")))


SEEDED = "md5('42-' || doc_id::VARCHAR), doc_id"


@R.add(
    "q_stratified_split",
    f"""SELECT doc_id, lang, CASE WHEN n < 3 THEN 'train' WHEN k <= floor(n * 0.8) THEN 'train' WHEN k <= floor(n * (0.8 + 0.1)) THEN 'valid' ELSE 'test' END AS split
      FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, source ORDER BY {SEEDED}) AS k, count(*) OVER (PARTITION BY lang, source)::DOUBLE AS n FROM documents)""",
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified(load(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id").select("doc_id", "lang", "split")


@R.add(
    "q_balance",
    f"""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {SEEDED}) AS k FROM documents)
      WHERE k <= CASE lang WHEN 'en' THEN 100 WHEN 'fr' THEN 80 WHEN 'de' THEN 60 END""",
)
def balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capped(load(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", {"en": 100, "fr": 80, "de": 60}, "doc_id")


#: The most that each language may have of all rows, then each label of the rows left.
LANGUAGE_SHARES = {"en": 0.5, "fr": 0.3, "de": 0.2}
LABEL_SHARES = {"SAFE": 0.44, "SUSPICIOUS": 0.28, "DANGEROUS": 0.28}


def share_sql(column: str, shares: dict[str, float]) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {share}::DOUBLE" for name, share in shares.items())
    return f"k <= floor(n::DOUBLE * CASE {column} {cases} END)"


@R.add(
    "q_balance_shares",
    f"""WITH l AS (SELECT doc_id, CASE WHEN max(toxic) = 1 THEN 'DANGEROUS' WHEN max(quality) = 1 THEN 'SAFE' ELSE 'SUSPICIOUS' END AS label FROM labels GROUP BY doc_id),
      a AS (SELECT doc_id, lang, label, row_number() OVER (PARTITION BY lang ORDER BY {SEEDED}) AS k, count(*) OVER () AS n FROM documents JOIN l USING (doc_id)),
      b AS (SELECT doc_id, lang, label FROM a WHERE {share_sql("lang", LANGUAGE_SHARES)}),
      c AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {SEEDED}) AS k, count(*) OVER () AS n FROM b)
      SELECT doc_id, lang, label FROM c WHERE {share_sql("label", LABEL_SHARES)}""",
)
def balance_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.max("toxic") == 1, "DANGEROUS").when(F.max("quality") == 1, "SAFE").otherwise("SUSPICIOUS")
    labels = load(spark, sf_dir, "labels").groupBy("doc_id").agg(label.alias("label"))
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id")
    return share_capped(share_capped(docs, "lang", LANGUAGE_SHARES, "doc_id"), "label", LABEL_SHARES, "doc_id")


@R.add("q_union_all", "SELECT doc_id AS id, text, lang FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return docs.unionByName(items, allowMissingColumns=True)


@R.add("q_shuffled", "SELECT doc_id, row_number() OVER (ORDER BY md5('42-' || doc_id::VARCHAR), doc_id) AS place FROM documents")
def shuffled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's place in a seeded shuffle of the whole table, by counts of buckets of the digest: no task sorts all rows."""
    rows = ranked(load(spark, sf_dir, "documents").select("doc_id"), [], "doc_id")
    return rows.select("doc_id", F.col("_place").cast("long").alias("place"))
