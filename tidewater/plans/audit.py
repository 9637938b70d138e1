"""Audit, evaluation and history queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.results import norm_parts
from tidewater.operators import history as H
from tidewater.operators import metrics as M
from tidewater.plans.registry import Registry
from tidewater.session import load

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

HISTORY_SQL = """h AS (SELECT event_id AS id, ts, user_id, event_type, (floor(value)::BIGINT % 101) AS score, event_id % 7 = 0 AS hidden,
  CASE WHEN floor(value)::BIGINT % 101 >= 70 THEN 'DANGEROUS' WHEN floor(value)::BIGINT % 101 >= 40 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS label FROM events)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of an analysis history."""
    score = F.floor("value").cast("long") % 101
    label = F.when(score >= 70, "DANGEROUS").when(score >= 40, "SUSPICIOUS").otherwise("SAFE")
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "ts", "user_id", "event_type", score.alias("score"), (F.col("event_id") % 7 == 0).alias("hidden"), label.alias("label")
    )


@R.add("q_history_page", f"WITH {HISTORY_SQL} SELECT id, score, label FROM h WHERE NOT hidden ORDER BY ts DESC, id DESC LIMIT 10 OFFSET 20")
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.page(history(spark, sf_dir), 2).select("id", "score", "label")


@R.add("q_history_label_page", f"WITH {HISTORY_SQL} SELECT id, score, label FROM h WHERE NOT hidden AND label = 'SAFE' ORDER BY ts DESC, id DESC LIMIT 10")
def history_label_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.page(history(spark, sf_dir), 0, label="SAFE").select("id", "score", "label")


@R.add(
    "q_page_meta",
    f"""WITH {HISTORY_SQL}, t AS (SELECT count(*) FILTER (NOT hidden) AS total FROM h),
      p AS (SELECT total, greatest(1, ceil(total / 10))::BIGINT AS pages FROM t), q AS (SELECT *, greatest(0, least(1000000, pages - 1))::BIGINT AS page FROM p)
      SELECT *, page < pages - 1 AS has_next, page > 0 AS has_previous FROM q""",
)
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.page_state(history(spark, sf_dir), 1_000_000)


STATS_SQL = "s AS (SELECT count(*) AS total, count(*) FILTER (score < 40) AS safe, count(*) FILTER (score >= 40 AND score < 70) AS suspicious, count(*) FILTER (score >= 70) AS danger FROM h)"


@R.add("q_global_stats", f"WITH {HISTORY_SQL}, {STATS_SQL} SELECT * FROM s")
def global_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.statistics(history(spark, sf_dir))


@R.add(
    "q_risk_pct",
    f"""WITH {HISTORY_SQL}, {STATS_SQL}, p AS (SELECT floor(100.0 * danger / total + 0.5)::BIGINT AS danger_pct, floor(100.0 * suspicious / total + 0.5)::BIGINT AS suspicious_pct FROM s)
      SELECT *, 100 - danger_pct - suspicious_pct AS safe_pct FROM p""",
)
def risk_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.shares(H.statistics(history(spark, sf_dir)))


@R.add("q_latest", f"WITH {HISTORY_SQL} SELECT id, score FROM h WHERE NOT hidden ORDER BY ts DESC, id DESC LIMIT 1")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.page(history(spark, sf_dir), 0, 1).select("id", "score")


@R.add("q_retention", f"WITH {HISTORY_SQL} SELECT id FROM h WHERE ts >= TIMESTAMP '2024-01-21' - INTERVAL 10 DAY")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.retain(history(spark, sf_dir), datetime(2024, 1, 21), 10).select("id")


@R.add("q_soft_delete", f"WITH {HISTORY_SQL} SELECT id, hidden OR id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS hidden FROM h")
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = load(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return H.soft_delete(history(spark, sf_dir), ids).select("id", "hidden")


@R.add(
    "q_upsert",
    f"""WITH {HISTORY_SQL}, u AS (SELECT id, 0::BIGINT AS score FROM h WHERE id % 5 = 0)
      SELECT id, score FROM h WHERE id NOT IN (SELECT id FROM u) UNION ALL SELECT * FROM u""",
)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history(spark, sf_dir).select("id", "score")
    return H.upsert(rows, rows.filter("id % 5 = 0").withColumn("score", F.lit(0).cast("long")))


@R.add(
    "q_time_floors",
    f"""WITH {HISTORY_SQL} SELECT date_trunc('day', ts)::TIMESTAMP AS day, date_trunc('week', ts)::TIMESTAMP AS week, date_trunc('month', ts)::TIMESTAMP AS month,
      count(*) AS n FROM h GROUP BY 1, 2, 3""",
)
def time_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).groupBy(F.date_trunc("day", "ts").alias("day"), F.date_trunc("week", "ts").alias("week"), F.date_trunc("month", "ts").alias("month")).agg(F.count("*").alias("n"))


@R.add(
    "q_notifications",
    f"""WITH {HISTORY_SQL} SELECT id FROM (SELECT * FROM h ORDER BY ts DESC, id DESC LIMIT 50) WHERE event_type <> 'click'""",
)
def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The filter stays above the limit: fewer than 50 may be left.
    return history(spark, sf_dir).orderBy(F.desc("ts"), F.desc("id")).limit(50).filter("event_type <> 'click'").select("id")


@R.add("q_value_counts", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))


@R.add("q_value_share", "SELECT lang, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM documents GROUP BY 1")
def value_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.value_shares(load(spark, sf_dir, "documents"), "lang")


@R.add("q_null_counts", "SELECT quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left").groupBy("quality").agg(F.count("*").alias("n"))


@R.add("q_top_sources", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@R.add(
    "q_top_duplicates",
    """SELECT md5(text) AS key, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, key LIMIT 10""",
)
def top_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = load(spark, sf_dir, "documents").filter("text IS NOT NULL").groupBy(F.md5("text").alias("key")).agg(F.count("*").alias("n"))
    return counts.filter("n > 1").orderBy(F.desc("n"), "key").limit(10)


@R.add("q_dup_ratio", "SELECT lang, (count(*) - count(DISTINCT text)) / count(*) AS ratio FROM documents GROUP BY 1")
def dup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("lang", F.md5("text").alias("key"))
    return rows.groupBy("lang").agg(((F.count("*") - F.count_distinct("key")) / F.count("*")).alias("ratio"))


@R.add(
    "q_crosstab",
    """SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'All' ELSE o_orderstatus END AS o_orderstatus,
      CASE WHEN grouping(o_orderpriority) = 1 THEN 'All' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n
      FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
)
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.crosstab_with_margins(load(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


LANGS = ("en", "fr", "de", "es")


@R.add(
    "q_pivot_pct",
    "SELECT source, " + ", ".join(f"100.0 * count(*) FILTER (lang = '{c}') / count(*) AS {c}" for c in LANGS) + " FROM documents GROUP BY 1",
)
def pivot_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = load(spark, sf_dir, "documents").groupBy("source").pivot("lang", list(LANGS)).count().fillna(0)
    total = sum(F.col(c) for c in LANGS)
    return counts.select("source", *((100.0 * F.col(c) / total).alias(c) for c in LANGS))


@R.add("q_pass_rate", "SELECT lang, avg((quality = 1)::INT) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("lang").agg(F.avg((F.col("quality") == 1).cast("int")).alias("rate"))


PAIRS_SQL = "p AS (SELECT CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS label, CASE WHEN n_chars > 500 THEN 'good' ELSE 'bad' END AS predicted FROM documents JOIN labels USING (doc_id))"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", "n_chars").join(load(spark, sf_dir, "labels"), "doc_id")
    return rows.select(
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"), F.when(F.col("n_chars") > 500, "good").otherwise("bad").alias("predicted")
    )


@R.add("q_confusion", f"WITH {PAIRS_SQL} SELECT label, predicted, count(*) AS n FROM p GROUP BY 1, 2")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).groupBy("label", "predicted").agg(F.count("*").alias("n"))


@R.add(
    "q_prf",
    f"""WITH {PAIRS_SQL}, c AS (SELECT class, count(*) FILTER (label = class AND predicted = class) AS hit, count(*) FILTER (label = class) AS actual,
      count(*) FILTER (predicted = class) AS told FROM p, (VALUES ('good'), ('bad')) k(class) GROUP BY 1)
      SELECT class, CASE WHEN told > 0 THEN hit / told END AS precision, CASE WHEN actual > 0 THEN hit / actual END AS recall,
      CASE WHEN told + actual > 0 THEN 2 * hit / (told + actual) END AS f1 FROM c""",
)
def prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.per_class(pairs(spark, sf_dir))


@R.add(
    "q_tag_counts",
    "SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(lower(p_type), ' ')) AS tag FROM part) GROUP BY 1",
)
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@R.add(
    "q_imbalance",
    """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1)
      SELECT max(n) / min(n) > 3 AS uneven, min(n) / sum(n) < 0.15 AS scarce FROM c""",
)
def imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = load(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return counts.agg((F.max("n") / F.min("n") > 3).alias("uneven"), (F.min("n") / F.sum("n") < 0.15).alias("scarce"))


@R.add(
    "q_grouping_sets",
    """SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source, count(*) AS n
      FROM documents GROUP BY GROUPING SETS ((lang), (source), ())""",
)
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").groupingSets([["lang"], ["source"], []], "lang", "source")
    sets = rows.agg(F.count("*").alias("n"), F.grouping("lang").alias("_l"), F.grouping("source").alias("_s"))
    return sets.select(
        F.when(F.col("_l") == 1, "all").otherwise(F.col("lang")).alias("lang"), F.when(F.col("_s") == 1, "all").otherwise(F.col("source")).alias("source"), "n"
    )


@R.add(
    "q_latest_burst",
    """SELECT user_id, event_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS last FROM events) WHERE ts >= last - INTERVAL 1500 MILLISECOND""",
)
def latest_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max("ts").over(Window.partitionBy("user_id"))
    rows = load(spark, sf_dir, "events").withColumn("last", last)
    return rows.filter("ts >= last - INTERVAL '1.5' SECOND").select("user_id", "event_id")


@R.add(
    "q_payload",
    r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS part FROM conversations
        UNION ALL SELECT conv_id, turn + 1000, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) FROM conversations WHERE turn % 2 = 0),
      f AS (SELECT conv_id, part, min(turn) AS first FROM t WHERE part <> '' GROUP BY 1, 2),
      c AS (SELECT conv_id, arg_min(role, turn) AS caption FROM conversations GROUP BY 1)
      SELECT conv_id, max(caption) || coalesce(chr(10) || string_agg(part, chr(10) ORDER BY first) FILTER (part <> caption), '') AS payload
      FROM c LEFT JOIN f USING (conv_id) GROUP BY conv_id""",
)
def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A post's caption (here the first role), then its parts that differ from it, each once; every second part comes twice."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    twice = turns.unionByName(turns.filter("turn % 2 = 0").withColumn("turn", F.col("turn") + 1000))
    told = twice.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("p"), F.min_by("role", "turn").alias("caption"))
    parts = F.filter(norm_parts(F.transform("p", lambda x: x["text"])), lambda x: x != F.col("caption"))
    return told.select("conv_id", F.array_join(F.concat(F.array("caption"), parts), "\n").alias("payload"))


@R.add(
    "q_pricing_summary",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
      FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n")
    )
