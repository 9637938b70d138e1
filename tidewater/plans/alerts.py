"""Alert queries over events: a score of 40 and more of an event's value raises an alert on a user's device."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans.registry import Registry
from tidewater.session import load
from tidewater.sources.files import checksum
from tidewater.streaming import alerts

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
SCORE_SQL = "(floor(value) % 101)::INT"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = (F.floor("value") % 101).cast("int")
    return load(spark, sf_dir, "events").withColumn("score", score).withColumn("channel", F.when(F.col("event_type") == "click", "sms").otherwise("chat"))


@R.add(
    "q_alert_route",
    f"""SELECT event_id, CASE WHEN event_type = 'click' AND s >= 20 AND s < 40 THEN 'rejected' WHEN s >= 70 THEN 'security' WHEN s >= 40 THEN 'persistent' END AS route
      FROM (SELECT event_id, event_type, {SCORE_SQL} AS s FROM events)""",
)
def alert_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("event_id", alerts.route(F.col("score"), F.col("channel"), F.lit(20)).alias("route"))


@R.add(
    "q_live_counts",
    f"""SELECT count(*) AS total, count(*) FILTER (s < 40) AS safe, count(*) FILTER (s >= 40 AND s < 70) AS suspicious, count(*) FILTER (s >= 70) AS danger
      FROM (SELECT {SCORE_SQL} AS s FROM events)""",
)
def live_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.live_counts(scored(spark, sf_dir))


@R.add(
    "q_chat_enrichment",
    f"""SELECT event_id, greatest(0, least(100, s + CASE WHEN event_type = 'view' THEN 40 ELSE 0 END + CASE WHEN value > 30 THEN 30 ELSE 0 END
        + CASE WHEN event_type IN ('view', 'click') THEN CASE WHEN event_type = 'view' THEN 50 ELSE 40 END ELSE 0 END))::INT AS score
      FROM (SELECT *, {SCORE_SQL} AS s FROM events)""",
)
def chat_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    score = alerts.enrich_chat(F.col("score"), kind == "view", F.col("value") > 30, kind.isin("view", "click"), kind == "click")
    return scored(spark, sf_dir).select("event_id", score.cast("int").alias("score"))


@R.add(
    "q_checksum",
    """WITH d AS (SELECT md5(coalesce(length(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || ',' || coalesce(length(text) || ':' || text, '-')) AS h FROM documents)
      SELECT count(*) AS n_rows, md5(coalesce(sum(('0x' || substr(h, 1, 8))::BIGINT), 0)::VARCHAR || ',' || coalesce(sum(('0x' || substr(h, 9, 8))::BIGINT), 0)::VARCHAR
        || ',' || coalesce(sum(('0x' || substr(h, 17, 8))::BIGINT), 0)::VARCHAR || ',' || coalesce(sum(('0x' || substr(h, 25, 8))::BIGINT), 0)::VARCHAR) AS digest FROM d""",
)
def corpus_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checksum(load(spark, sf_dir, "documents"), "doc_id", "text")
