"""Streams as queries: events are replayed in slices of time, each query stopped and taken up again between them.

Devices are groups of twenty users. Events lie minutes apart, the rules look at seconds: each query divides the time since
the first day by a number that brings both together; ids, order and values stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewater.plans.registry import Registry
from tidewater.session import load, scratch
from tidewater.streaming import alerts, debounce, limits
from tidewater.streaming.replay import replay, replayed
from tidewater.streaming.store import HistoryStore

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
#: Milliseconds of the first day.
START = 1_704_067_200_000


def ms_sql(faster: int) -> str:
    return f"((epoch_us(ts) // 1000 - {START}) // {faster} + {START})"


def events(spark: SparkSession, sf_dir: str, faster: int) -> DataFrame:
    """Events with device, score and `at`, the time of a clock that runs so many times faster."""
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    at = F.timestamp_millis(F.lit(START) + F.floor(ms / faster))
    device = F.floor(F.col("user_id") / 20).cast("string")
    return load(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id", device.alias("device"), at.alias("at"), (F.floor("value") % 101).cast("int").alias("score"))


def events_sql(faster: int, columns: str, where: str = "true", by: str = "device") -> str:
    """e: the rows of each key in order of time."""
    return f"""x AS (SELECT *, (user_id // 20)::VARCHAR AS device, {ms_sql(faster)} AS ms, (floor(value) % 101)::INT AS score FROM events),
      y AS (SELECT device, event_id AS id, ms, {columns} FROM x WHERE {where}),
      e AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ms, id) AS rn FROM y)"""


def of_device(row: Column | str = "event_id") -> dict[str, Column]:
    return {"device": F.col("device"), "row_id": F.col(row), "ts": "at"}


@R.add(
    "q_id_registry",
    f"""WITH RECURSIVE {events_sql(6, "(event_id * 7919 + user_id) % 700 AS item, CASE WHEN event_type = 'purchase' AND value > 60 THEN 'remove' ELSE 'add' END AS action")},
      step AS (
        SELECT DISTINCT device, 0::BIGINT AS rn, NULL::BIGINT AS id, NULL::BIGINT AS number, 0::BIGINT AS counter, []::STRUCT(ms BIGINT, n BIGINT, item BIGINT)[] AS held FROM e
        UNION ALL
        SELECT device, rn, id, number, counter + fresh, CASE WHEN len(added) > 200 THEN list_sort(added)[len(added) - 199:] ELSE added END FROM (
          SELECT *, CASE WHEN action = 'remove' THEN others ELSE list_append(others, {{'ms': ms, 'n': number, 'item': item}}) END AS added FROM (
            SELECT *, CASE WHEN len(mine) > 0 THEN mine[1].n WHEN action = 'add' THEN 10000 + counter END AS number, (len(mine) = 0 AND action = 'add')::BIGINT AS fresh FROM (
              SELECT *, list_filter(now, lambda h: h.item = item) AS mine, list_filter(now, lambda h: h.item <> item) AS others FROM (
                SELECT e.*, s.counter, list_filter(s.held, lambda h: e.ms - h.ms <= 86400000) AS now FROM step s JOIN e ON e.device = s.device AND e.rn = s.rn + 1)))))
      SELECT id AS event_id, number FROM step WHERE rn > 0""",
)
def id_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of items: kept while registered, a day at most, 200 items a device."""
    item = (F.col("event_id") * 7919 + F.col("user_id")) % 700
    action = F.when((F.col("event_type") == "purchase") & (F.col("value") > 60), "remove").otherwise("add")
    made = replayed(events(spark, sf_dir, 6), "at", lambda s: limits.judged(limits.stream_rows(s, **of_device(), item=item, action=action), limits.IdRegistry(), "long"), 2)
    return made.select(F.col("id").alias("event_id"), "number")


@R.add(
    "q_persistent_alerts",
    f"""WITH RECURSIVE {events_sql(1000, "event_id % 5 AS item, score, event_type IN ('purchase', 'signup') AS removal")},
      step AS (
        SELECT DISTINCT device, 0::BIGINT AS rn, NULL::BIGINT AS id, NULL::VARCHAR AS verdict, NULL::BIGINT AS last, []::BIGINT[] AS active FROM e
        UNION ALL
        SELECT device, rn, id, verdict, CASE WHEN verdict IN ('full', 'duplicate', 'shown') THEN ms ELSE last END,
          CASE verdict WHEN 'shown' THEN list_append(active, item) WHEN 'removed' THEN list_filter(active, lambda a: a <> item) ELSE active END FROM (
          SELECT e.*, s.last, s.active, CASE WHEN e.removal THEN CASE WHEN list_contains(s.active, e.item) THEN 'removed' ELSE 'unknown' END
            WHEN e.score < 40 OR e.score >= 70 THEN 'band' WHEN e.ms - s.last < 3000 THEN 'spacing' WHEN len(s.active) >= 3 THEN 'full'
            WHEN list_contains(s.active, e.item) THEN 'duplicate' ELSE 'shown' END AS verdict FROM step s JOIN e ON e.device = s.device AND e.rn = s.rn + 1))
      SELECT id AS event_id, verdict FROM step WHERE rn > 0""",
)
def persistent_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the middle band: 3 s apart, three active at most, none twice; purchases and signups take one away."""
    action = F.when(F.col("event_type").isin("purchase", "signup"), "remove").otherwise("alert")
    rows = lambda s: limits.stream_rows(s, **of_device(), item=F.col("event_id") % 5, action=action, score=F.col("score"))
    made = replayed(events(spark, sf_dir, 1000), "at", lambda s: limits.judged(rows(s), limits.PersistentLimiter(), "string"), 2)
    return made.select(F.col("id").alias("event_id"), "verdict")


def seen_sql(prune: str, by: str) -> str:
    return f"""step AS (
        SELECT DISTINCT {by}, 0::BIGINT AS rn, NULL::BIGINT AS id, NULL::BOOLEAN AS repeated, []::STRUCT(ms BIGINT, item VARCHAR)[] AS held FROM e
        UNION ALL
        SELECT {by}, rn, id, repeated, CASE WHEN repeated THEN pruned ELSE list_append(pruned, {{'ms': ms, 'item': item}}) END FROM (
          SELECT *, len(list_filter(pruned, lambda h: h.item = item)) > 0 AS repeated FROM (
            SELECT *, {prune} AS pruned FROM (
              SELECT e.*, list_filter(s.held, lambda h: e.ms - h.ms <= 900000) AS now FROM step s JOIN e ON e.{by} = s.{by} AND e.rn = s.rn + 1))))
      SELECT id AS event_id, repeated FROM step WHERE rn > 0"""


@R.add(
    "q_seen_cache",
    f"""WITH RECURSIVE {events_sql(1000, "((event_id * 7919) % 600)::VARCHAR AS item")},
      {seen_sql("CASE WHEN len(now) > 200 THEN list_sort(now)[51:] ELSE now END", "device")}""",
)
def seen_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats within 15 minutes on a device whose cache loses its oldest 50 beyond 200."""
    rows = lambda s: limits.stream_rows(s, **of_device(), item=(F.col("event_id") * 7919) % 600)
    made = replayed(events(spark, sf_dir, 1000), "at", lambda s: limits.judged(rows(s), limits.SeenCache(), "boolean"), 2)
    return made.select(F.col("id").alias("event_id"), "repeated")


@R.add(
    "q_message_repeats",
    f"""WITH RECURSIVE {events_sql(1000, "((event_id * 7919) % 600)::VARCHAR AS item, device || '|' || ((event_id * 7919) % 600)::VARCHAR AS message", by="device || '|' || item")},
      {seen_sql("now", "message")}""",
)
def message_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats within 15 minutes of a message's first time: state by groups of messages, so no device's messages meet in one task."""
    item = (F.col("event_id") * 7919) % 600
    message = F.concat_ws("|", "device", item.cast("string"))
    rows = lambda s: limits.stream_rows(s, message, F.col("event_id"), "at", item)
    made = replayed(events(spark, sf_dir, 1000), "at", lambda s: limits.repeats(rows(s)), 2)
    return made.select(F.col("id").alias("event_id"), "repeated")


def limited_sql(most: int, span: int, edge: str, where: str) -> str:
    return f"""WITH RECURSIVE {events_sql(1000, "score", where)},
      step AS (
        SELECT DISTINCT device, 0::BIGINT AS rn, NULL::BIGINT AS id, NULL::BOOLEAN AS accepted, []::BIGINT[] AS last FROM e
        UNION ALL
        SELECT device, rn, id, len(now) < {most}, CASE WHEN len(now) < {most} THEN list_append(now, ms) ELSE now END FROM (
          SELECT e.*, list_filter(s.last, lambda t: e.ms - t {edge} {span}) AS now FROM step s JOIN e ON e.device = s.device AND e.rn = s.rn + 1))
      SELECT id AS event_id, accepted FROM step WHERE rn > 0"""


def limited(spark: SparkSession, sf_dir: str, where: str, limit: tuple[int, int], edge: bool) -> DataFrame:
    made = replayed(events(spark, sf_dir, 1000).filter(where), "at", lambda s: alerts.limit_alerts(s, "device", "event_id", limit, "at", edge), 2)
    return made.select(F.col("id").alias("event_id"), "accepted")


@R.add("q_burst_limit", limited_sql(10, 60_000, "<=", "score >= 40"))
def burst_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts from 40 on: ten a minute and device."""
    return limited(spark, sf_dir, "score >= 40", alerts.BURST, True)


@R.add("q_full_screen", limited_sql(1, 10_000, "<", "score >= 70"))
def full_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-screen alerts, from 70 on: 10 s apart on a device."""
    return limited(spark, sf_dir, "score >= 70", alerts.FULL_SCREEN, False)


#: Mixes event ids, so that neighbours differ.
MIXED_SQL = "(event_id * 7919 % 101)"
POST_SQL = f"""CASE WHEN {MIXED_SQL} % 4 = 0 THEN 'note' || {MIXED_SQL} % 3 END AS nkey, 'chat' || {MIXED_SQL} % 2 AS title,
  CASE WHEN event_type = 'view' THEN 'Bill' || {MIXED_SQL} % 2 || '.PDF' END AS file, CASE WHEN event_type = 'click' THEN ' See ' || {MIXED_SQL} % 3 || ' ' END AS caption,
  CASE WHEN event_type IN ('error', 'click') THEN ['see ' || {MIXED_SQL} % 3, 'part ' || {MIXED_SQL} % 2] ELSE []::VARCHAR[] END AS parts,
  CASE WHEN value > 50 THEN ['https://x.example/' || {MIXED_SQL} % 2] ELSE []::VARCHAR[] END AS urls"""


def comparable_sql(row: str) -> str:
    return f"lower(array_to_string(list_filter(list_concat([{row}.caption], {row}.parts, [{row}.file], {row}.urls), lambda t: t IS NOT NULL), ' | '))"


def distinct_sql(texts: str) -> str:
    """Trimmed texts, each once, in order of first appearance; blank ones go."""
    trimmed = f"list_filter(list_transform({texts}, lambda t: trim(t)), lambda t: t <> '')"
    return f"list_filter({trimmed}, lambda t, i: list_position({trimmed}, t) = i)"


@R.add(
    "q_merged_posts",
    f"""WITH RECURSIVE {events_sql(2000, POST_SQL)},
      step AS (
        SELECT device, rn, 1::BIGINT AS entry, ms AS opened, ms AS post_ms, 1::BIGINT AS n, nkey, title, file, caption, parts, urls FROM e WHERE rn = 1
        UNION ALL
        SELECT device, rn, CASE WHEN same THEN entry ELSE entry + 1 END, CASE WHEN same THEN opened ELSE ms END, CASE WHEN same THEN greatest(old_ms, ms) ELSE ms END,
          CASE WHEN same THEN n + 1 ELSE 1 END, CASE WHEN same THEN coalesce(nkey, old_nkey) ELSE nkey END, title, CASE WHEN same THEN coalesce(file, old_file) ELSE file END,
          CASE WHEN same THEN coalesce(caption, old_caption) ELSE caption END,
          CASE WHEN same THEN {distinct_sql("list_concat([old_caption], old_parts, [caption], parts)")} ELSE parts END,
          CASE WHEN same THEN {distinct_sql("list_concat(old_urls, urls)")} ELSE urls END FROM (
          SELECT *, ms - opened < 1500 AND abs(old_ms - ms) <= 3500 AND coalesce(old_nkey = nkey OR (old_title = title AND
            (coalesce(lower(old_file) = lower(file), false) OR (a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a))))),
            old_title = title AND (coalesce(lower(old_file) = lower(file), false) OR (a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a))))) AS same FROM (
            SELECT e.*, s.entry, s.opened, s.post_ms AS old_ms, s.n, s.nkey AS old_nkey, s.title AS old_title, s.file AS old_file, s.caption AS old_caption, s.parts AS old_parts, s.urls AS old_urls,
              {comparable_sql("s")} AS a, {comparable_sql("e")} AS b FROM step s JOIN e ON e.device = s.device AND e.rn = s.rn + 1)))
      SELECT device, opened AS opened_ms, n AS n_posts, post_ms, nkey AS notification_key, title, file, caption, array_to_string(parts, '|') AS parts, array_to_string(urls, '|') AS urls
      FROM (SELECT *, row_number() OVER (PARTITION BY device, entry ORDER BY rn DESC) AS back FROM step) WHERE back = 1""",
)
def merged_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of each device merged within 1.5 s; a last row, of no device, far later lets the watermark close what is open."""
    rows = events(spark, sf_dir, 2000)
    k = F.col("event_id") * 7919 % 101
    texts = lambda *parts: F.array(*parts).cast("array<string>")
    posts = rows.select(
        F.col("event_id").alias("id"), F.col("at").alias("arrived"), F.unix_millis("at").alias("post_ms"), F.lit("app").alias("package"), F.col("device").alias("sender"),
        F.concat(F.lit("chat"), k % 2).alias("title"), F.when(k % 4 == 0, F.concat(F.lit("note"), k % 3)).alias("notification_key"),
        F.when(F.col("event_type").isin("error", "click"), texts(F.concat(F.lit("see "), k % 3), F.concat(F.lit("part "), k % 2))).alias("parts"),
        F.when(F.col("event_type") == "click", F.concat(F.lit(" See "), k % 3, F.lit(" "))).alias("caption"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("Bill"), k % 2, F.lit(".PDF"))).alias("file"),
        F.when(F.col("value") > 50, texts(F.concat(F.lit("https://x.example/"), k % 2))).alias("urls"),
    )
    later = F.timestamp_millis(F.lit(START + 10**10))
    end = spark.range(1).select(*((later if f.name == "arrived" else F.lit(None)).cast(f.dataType).alias(f.name) for f in posts.schema))
    made = replayed(posts, "arrived", debounce.merge_stream, 2, [end, end.withColumn("arrived", F.timestamp_millis(F.lit(START + 2 * 10**10)))])
    joined = (F.array_join(c, "|").alias(c) for c in ("parts", "urls"))
    return made.filter("key <> ''").select(F.col("key").alias("device"), "opened_ms", "n_posts", "post_ms", "notification_key", "title", "file", "caption", *joined)


@R.add(
    "q_stored_history",
    f"""WITH x AS (SELECT event_id AS id, {ms_sql(1)} AS ms, value FROM events), t AS (SELECT max(ms) AS last FROM x)
      SELECT id, CASE WHEN id % 7 = 0 AND NOT (id % 14 = 0) THEN -1.0::DOUBLE ELSE value END AS value FROM x, t WHERE ms >= last - 10 * 86400000""",
)
def stored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert and trim in one act a batch: every seventh row comes again later with another value, half of these once
    more with the old one; each batch is given to the store twice, of which the second changes nothing."""
    rows = events(spark, sf_dir, 1).select(F.col("event_id").alias("id"), "at", "value", F.col("at").alias("arrived"))
    hours = lambda n: (F.col("at") + F.make_dt_interval(hours=F.lit(n))).alias("arrived")
    second = rows.filter("id % 7 = 0").select("id", "at", F.lit(-1.0).alias("value"), hours(100))
    third = rows.filter("id % 14 = 0").select("id", "at", "value", hours(240))
    every = rows.unionByName(second).unionByName(third)
    store = HistoryStore(spark, scratch(spark, "history"), "id", "at", 10, fold_every=2)

    def put(batch: DataFrame, batch_id: int) -> None:
        # In a batch the row that arrived last counts.
        last = batch.groupBy("id").agg(F.max_by(F.struct("at", "value"), "arrived").alias("row")).select("id", "row.at", "row.value")
        if store.apply(last, batch_id) and store.apply(last, batch_id):
            raise RuntimeError("a repeated batch was taken")

    def start(stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)

    replay(every, "arrived", start, 3)
    columns = rows.select("id", "at", "value")
    return store.rows(columns.columns, columns.schema).select("id", "value")


@R.add("q_stream_posts", "SELECT event_id, user_id FROM events WHERE event_type IN ('view', 'click')")
def stream_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of two packages, as they come."""
    rows = events(spark, sf_dir, 1)
    return replayed(rows, "at", lambda s: s.filter(F.col("event_type").isin("view", "click")).select("event_id", "user_id"), 2)


@R.add(
    "q_stream_messages",
    f"""WITH x AS (SELECT event_id // 3 AS message_id, event_id % 3 AS part, CASE WHEN event_id % 5 > 0 THEN event_type || ' ' END AS body,
        CASE WHEN event_id % 2 = 0 THEN (user_id // 20)::VARCHAR END AS sender FROM events)
      SELECT message_id, trim(string_agg(coalesce(body, ''), '' ORDER BY part)) AS text, coalesce(nullif(trim(min(sender)), ''), 'Unknown') AS sender
      FROM x GROUP BY message_id HAVING trim(string_agg(coalesce(body, ''), '' ORDER BY part)) <> ''""",
)
def stream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages joined from their parts, each once no part can come any more; a last part far later closes all."""
    k = F.col("event_id")
    rows = events(spark, sf_dir, 1000).select(
        F.floor(k / 3).alias("message_id"), (k % 3).alias("part"), F.when(k % 5 > 0, F.concat("event_type", F.lit(" "))).alias("body"), F.when(k % 2 == 0, F.col("device")).alias("sender"), "at"
    )
    later = [F.timestamp_millis(F.lit(START + n * 10**10)) for n in (1, 2)]
    ends = [spark.range(1).select(*((t if f.name == "at" else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema)) for t in later]
    made = replayed(rows, "at", lambda s: alerts.joined_parts(s, "at", "1 minute"), 2, ends)
    return made.filter("message_id IS NOT NULL").select("message_id", "text", "sender")


SLICES = 3


@R.add(
    "q_stream_counts",
    f"""WITH x AS (SELECT {ms_sql(1)} AS ms, (floor(value) % 101)::INT AS s FROM events), b AS (SELECT min(ms) AS lo, max(ms) AS hi FROM x),
      k AS (SELECT k, CASE WHEN k = {SLICES} THEN hi + 1 ELSE lo + (hi - lo) * k // {SLICES} END AS until FROM b, (SELECT unnest(range(1, {SLICES + 1})) AS k))
      SELECT k AS emission, count(*) AS total, count(*) FILTER (s < 40) AS safe, count(*) FILTER (s >= 40 AND s < 70) AS suspicious, count(*) FILTER (s >= 70) AS danger
      FROM k JOIN x ON x.ms < k.until GROUP BY k""",
)
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live counts as they are emitted again after each change of the table."""
    rows = events(spark, sf_dir, 1)
    out = scratch(spark, "counts")

    def put(batch: DataFrame, batch_id: int) -> None:
        # A repeated batch writes its folder again.
        batch.coalesce(1).write.mode("overwrite").parquet(f"{out}/emission={batch_id}")

    def start(stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        return alerts.live_counts(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)

    replay(rows, "at", start, SLICES)
    emitted = spark.read.schema("total long, safe long, suspicious long, danger long, emission long").parquet(out)
    return emitted.withColumn("emission", F.col("emission") + 1)
