"""Validation, comparison, candidate and log queries over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.operators import checks as C
from tidewater.operators.dedup import keep_first
from tidewater.operators.features import TOKEN
from tidewater.operators.near import all_pairs, drop_near
from tidewater.plans.messages import MESSAGES_SQL, any_sql, messages
from tidewater.plans.registry import Registry
from tidewater.session import load, settled

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

KEY_SQL = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
LABELS_SQL = """lab AS (SELECT doc_id, CASE WHEN max(toxic) = 1 THEN 'DANGEROUS' WHEN max(quality) = 1 THEN 'SAFE' ELSE 'SUSPICIOUS' END AS label FROM labels GROUP BY doc_id),
  d AS (SELECT doc_id, text, lang, source, coalesce(label, 'unknown') AS label FROM documents LEFT JOIN lab USING (doc_id))"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label made of their quality and toxicity; `unknown` without any."""
    label = F.when(F.max("toxic") == 1, "DANGEROUS").when(F.max("quality") == 1, "SAFE").otherwise("SUSPICIOUS")
    labels = load(spark, sf_dir, "labels").groupBy("doc_id").agg(label.alias("label"))
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").join(labels, "doc_id", "left")
    return docs.withColumn("label", F.coalesce("label", F.lit("unknown")))


def key():
    return T.collapse(F.lower("text"))


@R.add("q_drop_blank", "SELECT id, trim(text) AS text FROM (WITH " + MESSAGES_SQL + " SELECT * FROM m) WHERE text IS NOT NULL AND trim(text) <> ''")
def drop_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).withColumn("text", F.trim("text")).filter("text <> ''")


@R.add("q_label_whitelist", f"WITH {LABELS_SQL} SELECT doc_id, label FROM d WHERE label IN ('SAFE', 'SUSPICIOUS', 'DANGEROUS')")
def label_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).filter(F.col("label").isin("SAFE", "SUSPICIOUS", "DANGEROUS")).select("doc_id", "label")


@R.add(
    "q_validate",
    f"""WITH {LABELS_SQL}, v AS (SELECT 'value not allowed' AS problem, 'label' AS "column", count(*) FILTER (label NOT IN ('SAFE', 'SUSPICIOUS', 'DANGEROUS')) AS n FROM d
        UNION ALL SELECT 'value not allowed', 'source', count(*) FILTER (source NOT IN ('src0', 'src1', 'src2', 'src3')) FROM d)
      SELECT * FROM v WHERE n > 0 UNION ALL SELECT 'missing column', 'language', NULL""",
)
def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = {"label": ("SAFE", "SUSPICIOUS", "DANGEROUS"), "source": ("src0", "src1", "src2", "src3")}
    return C.violations(labelled(spark, sf_dir), ("text", "label", "language"), allowed)


CANDIDATE_SQL = f"""low AS (SELECT *, label = 'DANGEROUS' AS scam, lower(coalesce(text, '')) AS t FROM d),
  c AS (SELECT *, CASE WHEN regexp_matches(t, '[а-яё]') THEN 'ru' WHEN {any_sql('t', C.UZBEK_WORDS)} THEN 'uz' ELSE 'en' END AS hint, {any_sql('t', C.SCAM_WORDS)} AS strong,
    len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) < {C.FEW_WORDS} AS short FROM low),
  p AS (SELECT doc_id, text, hint, CASE WHEN scam THEN CASE WHEN strong THEN 'high' ELSE 'medium' END WHEN short AND hint = 'uz' THEN 'high' WHEN short THEN 'medium' ELSE 'low' END AS priority,
    CASE WHEN scam AND strong THEN CASE {' '.join(f"WHEN {any_sql('t', words)} THEN '{reason}'" for words, reason in C.SCAM_REASONS)}
        WHEN source = 'src1' THEN '{C.CHAT_REASON}' ELSE '{C.OTHER_REASON}' END
      WHEN scam THEN '{C.MEDIUM_REASON}' WHEN short AND hint = 'uz' THEN '{C.SEED_REASON}' WHEN short THEN '{C.BALANCE_REASON}' ELSE '{C.WEAK_REASON}' END AS reason FROM c)"""


@R.add(
    "q_candidates",
    f"""WITH {LABELS_SQL}, {CANDIDATE_SQL} SELECT doc_id, hint, priority, reason FROM p
      WHERE priority = 'high' OR (priority = 'medium' AND ('0x' || substr(md5(coalesce(text, '')), 1, 8))::BIGINT % 5 = 0)""",
)
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source stands for the chat; a fifth of medium priority is chosen by digest."""
    hint, priority, reason = C.candidate(F.col("label") == "DANGEROUS", F.coalesce(F.col("source") == "src1", F.lit(False)), F.col("text"))
    rows = labelled(spark, sf_dir).withColumns({"hint": hint, "priority": priority, "reason": reason})
    return rows.filter(C.chosen(F.col("priority"), F.col("text"))).select("doc_id", "hint", "priority", "reason")


@R.add("q_candidate_table", f"WITH {MESSAGES_SQL}, d AS (SELECT id AS doc_id, text, CASE WHEN id % 2 = 0 THEN 'DANGEROUS' ELSE 'SAFE' END AS label, CASE WHEN id % 3 = 0 THEN 'src1' END AS source FROM m), {CANDIDATE_SQL} SELECT doc_id AS id, hint, priority, reason FROM p")
def candidate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole decision table over messages."""
    hint, priority, reason = C.candidate(F.col("id") % 2 == 0, F.col("id") % 3 == 0, F.col("text"))
    return messages(spark, sf_dir).select("id", hint.alias("hint"), priority.alias("priority"), reason.alias("reason"))


HINTS = (" EN ", "mixed", "unknown", None, "", "fr")
HINT_SQL = "[' EN ', 'mixed', 'unknown', NULL, '', 'fr'][id % 6 + 1]"


@R.add(
    "q_settled_language",
    f"""WITH {MESSAGES_SQL}, h AS (SELECT id, lower(trim({HINT_SQL})) AS hint, CASE WHEN regexp_matches(text, '[А-Яа-я]') THEN 'ru' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS found FROM m),
      v AS (SELECT *, coalesce(hint IN ('', 'mixed', 'unknown'), true) AS vague FROM h)
      SELECT id, CASE WHEN NOT vague THEN hint WHEN found <> 'unknown' THEN found ELSE coalesce(nullif(hint, ''), 'unknown') END AS language,
        CASE WHEN NOT vague THEN 'label' WHEN found <> 'unknown' THEN 'detected' ELSE 'none' END AS origin FROM v""",
)
def settled_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = F.array(*map(F.lit, HINTS))[F.pmod("id", F.lit(6)).cast("int")]
    found = F.when(F.rlike("text", F.lit("[А-Яа-я]")), "ru").when(F.rlike("text", F.lit("[A-Za-z]")), "en").otherwise("unknown")
    language, origin = C.settled_language(hint, found)
    return messages(spark, sf_dir).select("id", language.alias("language"), origin.alias("origin"))


@R.add(
    "q_positional_diff",
    r"""WITH a AS (SELECT doc_id, text FROM documents), b AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents WHERE doc_id % 50 <> 7)
      SELECT doc_id, md5(a.text) AS "left", md5(b.text) AS "right" FROM a FULL JOIN b USING (doc_id) WHERE b.doc_id IS NULL OR a.text IS DISTINCT FROM b.text""",
)
def positional_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = docs.filter("doc_id % 50 <> 7").withColumn("text", T.collapse(F.col("text")))
    return C.positional_differences(docs, cleaned, "doc_id", "text").select("doc_id", F.md5("left").alias("left"), F.md5("right").alias("right"))


@R.add(
    "q_overlap_examples",
    f"""WITH d AS (SELECT doc_id, lang, source, {KEY_SQL} AS key FROM documents),
      a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS k FROM d WHERE doc_id % 2 = 0) WHERE k = 1),
      b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS k FROM d WHERE doc_id % 2 = 1) WHERE k = 1)
      SELECT md5(key) AS key, a.doc_id AS left_doc_id, a.lang AS left_lang, b.doc_id AS right_doc_id, b.lang AS right_lang FROM a JOIN b USING (key)""",
)
def overlap_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.md5(key()).alias("key"))
    return C.overlap_examples(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), "key", "doc_id", "lang")


@R.add(
    "q_overlap_sizes",
    f"""WITH d AS (SELECT doc_id % 3 AS part, {KEY_SQL} AS key FROM documents), k AS (SELECT key, bool_or(part = 0) AS a, bool_or(part = 1) AS b, bool_or(part = 2) AS c FROM d GROUP BY key)
      SELECT count(*) FILTER (a AND b) AS ab, count(*) FILTER (a AND c) AS ac, count(*) FILTER (b AND c) AS bc, count(*) FILTER (a AND b AND c) AS abc FROM k""",
)
def overlap_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that two and three parts of the documents share, from one grouping by key."""
    docs = load(spark, sf_dir, "documents").select((F.col("doc_id") % 3).alias("part"), F.md5(key()).alias("key"))
    has = {n: F.bool_or(F.col("part") == k) for k, n in enumerate("abc")}
    keys = docs.groupBy("key").agg(*(c.alias(n) for n, c in has.items()))
    both = {"ab": "a AND b", "ac": "a AND c", "bc": "b AND c", "abc": "a AND b AND c"}
    return keys.agg(*(F.count_if(F.expr(when)).alias(n) for n, when in both.items()))


@R.add(
    "q_dedup_raw_last",
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS k FROM documents) WHERE k = 1",
)
def dedup_raw_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each text as it stands: largest ids are found before the shuffle, texts are told apart by digest."""
    docs = load(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), F.col("text").isNull().alias("none")).agg(F.max("doc_id").alias("doc_id")).select("doc_id")


@R.add(
    "q_dedup_label",
    f"""WITH {LABELS_SQL} SELECT doc_id, source, label FROM (SELECT *, row_number() OVER (PARTITION BY text, source, label ORDER BY doc_id) AS k FROM d) WHERE k = 1""",
)
def dedup_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).withColumn("h", F.sha2("text", 256))
    return keep_first(rows.drop("text"), ["h", "source", "label"], ["doc_id"]).select("doc_id", "source", "label")


LEVEL_SQL = "CASE WHEN length(text) % 3 = 0 THEN 'high' WHEN length(text) % 3 = 1 THEN 'medium' ELSE 'low' END"
PRIORITY_SQL = "CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END"


@R.add(
    "q_leakage_levels",
    f"""WITH d AS (SELECT doc_id, lang, {LEVEL_SQL} AS level, {KEY_SQL} AS key FROM documents), c AS (SELECT key, lang, count(*) AS n FROM d GROUP BY 1, 2),
      m AS (SELECT key, lang AS major FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, lang) AS k FROM c) WHERE k = 1)
      SELECT doc_id, lang, level FROM (SELECT d.*, row_number() OVER (PARTITION BY key ORDER BY (lang = major)::INT DESC,
        CASE level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, {PRIORITY_SQL}, doc_id) AS k FROM d JOIN m USING (key)) WHERE k = 1""",
)
def leakage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each key: of its most frequent language, then of the surest level, then by language and id. One grouping
    by key and language, whose best rows are then compared by key: copies are summed up before they meet."""
    length = F.char_length("text") % 3
    level = F.when(length == 0, "high").when(length == 1, "medium").otherwise("low")
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", level.alias("level"), F.md5(key()).alias("key"))
    rank = F.when(F.col("level") == "high", 0).when(F.col("level") == "medium", 1).otherwise(2)
    by_lang = docs.groupBy("key", "lang").agg(F.count("*").alias("n"), F.min(F.struct(rank.alias("rank"), "doc_id", "level")).alias("best"))
    chosen = by_lang.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang", "best")).alias("top"))
    return chosen.select(F.col("top.best.doc_id").alias("doc_id"), F.col("top.lang").alias("lang"), F.col("top.best.level").alias("level"))


@R.add("q_first_last", "(SELECT doc_id, lang, 'first' AS place FROM documents ORDER BY doc_id LIMIT 5) UNION ALL (SELECT doc_id, lang, 'last' FROM documents ORDER BY doc_id DESC LIMIT 5)")
def first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ends(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 5)


@R.add(
    "q_distinct_by",
    """WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations)
      SELECT conv_id, string_agg(role || ':' || turn, ',' ORDER BY turn) AS firsts FROM t WHERE k = 1 GROUP BY conv_id""",
)
def distinct_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    first = F.transform(C.distinct_by(F.col("t"), "role"), lambda x: F.concat(x["role"], F.lit(":"), x["turn"].cast("string")))
    return turns.select("conv_id", F.array_join(first, ",").alias("firsts"))


SLOTS = {"sum": ("100", "2 500"), "link": ("a.example.org", "b.example.org")}
TEMPLATES = ("{bank}: pay {sum} now", "open {link}", "no slot at all", "{bank} sends {sum} over {link}")


@R.add(
    "q_templates",
    f"""SELECT s_suppkey, t.k AS template, replace(replace(replace(t.text, '{{bank}}', s_name), '{{sum}}', s.v), '{{link}}', l.v) AS text
      FROM supplier, (SELECT unnest(range({len(TEMPLATES)})) AS k, unnest({list(TEMPLATES)}) AS text) t, (SELECT unnest({list(SLOTS['sum'])}) AS v) s,
        (SELECT unnest({list(SLOTS['link'])}) AS v) l GROUP BY ALL""",
)
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every template for every supplier, whose name is one slot's value, with all values of the other slots."""
    suppliers = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.posexplode(F.array(*map(F.lit, TEMPLATES))).alias("k", "text"))
    named = suppliers.select("s_suppkey", F.col("k").cast("long").alias("template"), F.replace("text", F.lit("{bank}"), F.col("s_name")).alias("text"))
    return C.filled_templates(named, SLOTS)


@R.add(
    "q_side_logs",
    f"""WITH {LABELS_SQL}, k AS (SELECT doc_id, lang, label, {KEY_SQL} AS key FROM d), f AS (SELECT key, min(doc_id) AS first, count(DISTINCT label) AS n FROM k GROUP BY key)
      SELECT 'conflicts' AS log, count(*) AS n FROM f WHERE n > 1 UNION ALL SELECT 'mixed', count(*) FROM k WHERE lang IS NULL OR lang IN ('mixed', 'unknown')
      UNION ALL SELECT 'removed', count(*) FROM k JOIN f USING (key) WHERE doc_id > first""",
)
def side_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select("doc_id", "lang", "label", F.md5(key()).alias("key"))
    logs = C.side_logs(rows, "key", "label", "lang", "doc_id")
    counts = [log.agg(F.count("*").alias("n")).select(F.lit(name).alias("log"), "n") for name, log in logs.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@R.add(
    "q_removed_rows",
    f"""WITH k AS (SELECT doc_id, lang, {KEY_SQL} AS key FROM documents) SELECT doc_id, lang FROM k JOIN (SELECT key, min(doc_id) AS first FROM k GROUP BY key) USING (key) WHERE doc_id > first""",
)
def removed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", "lang", F.lit("").alias("label"), F.md5(key()).alias("key"))
    return C.side_logs(rows, "key", "label", "lang", "doc_id")["removed"].select("doc_id", "lang")


@R.add(
    "q_insert_and_trim",
    """WITH h AS (SELECT event_id AS id, ts, value FROM events), n AS (SELECT id, ts, -1.0::DOUBLE AS value FROM h WHERE id % 7 = 0), t AS (SELECT max(ts) AS last FROM h)
      SELECT id, ts, value FROM (SELECT * FROM n UNION ALL SELECT * FROM h WHERE id % 7 <> 0), t WHERE ts >= last - INTERVAL 10 DAYS""",
)
def insert_and_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", "value")
    fresh = rows.filter("id % 7 = 0").withColumn("value", F.lit(-1.0))
    return C.keep_trimmed(rows, fresh, "id", "ts", 10, rows.agg(F.max("ts")).scalar())


@R.add("q_point_lookup", "SELECT event_id, user_id, value FROM events WHERE event_id = 77")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter reaches the scan, whose row groups without the id aren't read."""
    return load(spark, sf_dir, "events").filter("event_id = 77").limit(1).select("event_id", "user_id", "value")


@R.add("q_watched_posts", "SELECT event_id, user_id FROM events WHERE event_type IN ('view', 'click')")
def watched_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click")).select("event_id", "user_id")


@R.add(
    "q_build_report",
    f"""WITH {LABELS_SQL} SELECT 'rows' AS section, 'all' AS name, count(*) AS n FROM d UNION ALL SELECT 'language', coalesce(lang, 'none'), count(*) FROM d GROUP BY 2
      UNION ALL SELECT 'label', label, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, 'none'), count(*) FROM d GROUP BY 2""",
)
def build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of a build's report in one pass: grouping sets by language, label, source and nothing."""
    rows = labelled(spark, sf_dir).select(F.coalesce("lang", F.lit("none")).alias("lang"), "label", F.coalesce("source", F.lit("none")).alias("source"))
    sets = rows.groupingSets([["lang"], ["label"], ["source"], []], "lang", "label", "source").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    section = F.when(F.col("g") == 3, "language").when(F.col("g") == 5, "label").when(F.col("g") == 6, "source").otherwise("rows")
    return sets.select(section.alias("section"), F.coalesce("lang", "label", "source", F.lit("all")).alias("name"), "n")


NEAR_SQL = f"""{LABELS_SQL}, w AS (SELECT doc_id, label, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS ws FROM d),
  u AS (SELECT doc_id, label, unnest(ws) AS a, unnest(list_concat(ws[2:], [NULL])) AS b FROM w WHERE len(ws) > 0),
  g AS (SELECT doc_id, label, a AS term FROM u UNION ALL SELECT doc_id, label, a || ' ' || b FROM u WHERE b IS NOT NULL),
  c AS (SELECT doc_id, label, term, count(*) AS tf FROM g GROUP BY ALL), f AS (SELECT label, term, sum(tf) AS freq, count(*) AS df FROM c GROUP BY ALL),
  v AS (SELECT label, term, df FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY freq DESC, term) AS k FROM f) WHERE k <= 5000),
  n AS (SELECT label, count(*) AS n FROM d GROUP BY label),
  x AS (SELECT doc_id, label, term, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS w FROM c JOIN v USING (label, term) JOIN n USING (label)),
  y AS (SELECT doc_id, label, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS v FROM x),
  p AS (SELECT l.doc_id AS a, r.doc_id AS b FROM y l JOIN y r ON l.label = r.label AND l.term = r.term AND l.doc_id < r.doc_id GROUP BY ALL HAVING round(sum(l.v * r.v), 9) > 0.95)"""


@R.add(
    "q_near_dedup",
    f"""WITH RECURSIVE {NEAR_SQL}, e AS (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS k FROM p GROUP BY b),
      step AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL
        SELECT e.k, CASE WHEN len(list_filter(e.earlier, lambda a: NOT list_contains(gone, a))) > 0 THEN list_append(gone, e.b) ELSE gone END FROM step JOIN e ON e.k = step.k + 1),
      last AS (SELECT gone FROM step ORDER BY k DESC LIMIT 1)
      SELECT doc_id, label FROM d, last WHERE NOT list_contains(gone, doc_id)""",
)
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within each label, rows whose words are not nearly those of an earlier kept row."""
    return drop_near(labelled(spark, sf_dir).select("doc_id", "label", "text"), "doc_id", "label").select("doc_id", "label")


@R.add("q_near_pairs", f"WITH {NEAR_SQL} SELECT a, b FROM p")
def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one label whose weighted words have a cosine beyond 0.95."""
    docs = labelled(spark, sf_dir).select("doc_id", "label", "text")
    return all_pairs(docs, "doc_id", "label")
