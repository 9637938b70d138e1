"""Text, extraction, label and fusion queries over a view of short messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import fusion, text as T
from tidewater.plans.registry import Registry
from tidewater.session import load

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

#: Phrases that make each branch of the text functions fire; our own.
PHRASES = (
    "see https://pay.example.com/login?a=1, now!!!",
    "open win-big.xyz today",
    "photo.jpg.apk attached",
    "take report.zip and setup.exe",
    "call +998 90 123-45-67 or mail a.b@example.org",
    "o‘zbek so`z va g'alaba",
    "ПРИВЕТ мир, счёт 12",
    "Ўзбек тили ҳақида",
    "zero​width “quoted” «text»",
    "t.me/channel and www.site.uz",
    "plain words only",
    "kodni yuboring",
    "hech kimga bermang",
    "verification code: 1234",
    "go http://a.top.example.com/x",
    "your bank card is kept secure",
    "please confirm the login code",
    "you won a prize, congratulations",
    "click this link http://x.uz/a now",
    "urgent: transfer the money",
    "hello, we have an offer",
    "free download of the account book",
)
#: Added to the id of a document for the id of a message of blanks alone.
BLANK_ID = 1_000_000_000_000


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and text: each whole document with a phrase chosen by its id; and for every sixteenth one more message, of blanks."""
    phrase = F.array(*map(F.lit, PHRASES))[F.pmod("doc_id", F.lit(len(PHRASES))).cast("int")]
    docs = load(spark, sf_dir, "documents")
    blank = docs.filter("doc_id % 16 = 15").select((F.col("doc_id") + BLANK_ID).alias("id"), F.lit("   ").alias("text"))
    return docs.select(F.col("doc_id").alias("id"), F.concat("text", F.lit(" "), phrase).alias("text")).unionByName(blank)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


MESSAGES_SQL = f"""m AS (
  SELECT doc_id AS id, text || ' ' || [{', '.join(map(quoted, PHRASES))}][doc_id % {len(PHRASES)} + 1] AS text FROM documents
  UNION ALL SELECT doc_id + {BLANK_ID}, '   ' FROM documents WHERE doc_id % 16 = 15)"""
WORD = r"\p{L}\p{N}_"
COLLAPSE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def padded(sql: str) -> str:
    for word in T.EXTENSIONS:
        sql = f"replace({sql}, '{word}', ' {word} ')"
    return sql


def scalar(name: str, function, sql: str) -> None:
    """A query of one text function over all messages."""

    @R.add(name, f"WITH {MESSAGES_SQL} SELECT id, {sql} AS out FROM m")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return messages(spark, sf_dir).select("id", function(F.col("text")).alias("out"))


LOWERED = "lower(coalesce(text, ''))"
LINKS = rf"regexp_replace({{}}, '(https?://\S+)', ' \1 ', 'g')"
scalar(
    "q_clean_ml",
    T.clean_ml,
    COLLAPSE.format(
        "regexp_replace(regexp_replace("
        + padded(LINKS.format(f"translate({LOWERED}, '‘’`ʼ', '''''''''')"))
        + rf", '!!+', ' ! ', 'g'), '[^{WORD}\s./:'']', ' ', 'g')"
    ),
)
scalar(
    "q_clean_v1",
    T.clean_v1,
    COLLAPSE.format(
        rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({LOWERED}, 'https?://\S+|www\.\S+', '', 'g'), "
        rf"'\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}\b', '', 'g'), '\+?\d[\d\-\s()]{{6,}}\d', '', 'g'), '[^{WORD}\s]', ' ', 'g')"
    ),
)
scalar("q_clean_v7", T.clean_v7, COLLAPSE.format(f"regexp_replace({padded(LINKS.format(LOWERED))}, '[^{WORD}\\s./:]', ' ', 'g')"))
scalar("q_norm_dedup", T.norm_dedup, f"translate({COLLAPSE.format(LOWERED)}, '“”«»‘’`', '\"\"\"\"''''''')")
scalar("q_norm_foundation", T.norm_foundation, COLLAPSE.format(f"translate({LOWERED}, '“”«»„‟‘’', '\"\"\"\"\"\"''''')"))
scalar("q_norm_audit", T.norm_audit, f"translate({COLLAPSE.format(LOWERED)}, '“”‘’', '\"\"''''')")
scalar(
    "q_norm_rules",
    T.norm_rules,
    COLLAPSE.format(f"translate(lower(translate(translate(coalesce(text, ''), '{T.INVISIBLE}', ''), 'аоесрху', 'aoecpxy')), '''`’', '‘‘‘')"),
)
RULES_SQL = COLLAPSE.format(f"translate(lower(translate(translate(coalesce(text, ''), '{T.INVISIBLE}', ''), 'аоесрху', 'aoecpxy')), '''`’', '‘‘‘')")


def any_sql(text: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(p)})" for p in phrases) + ")"


scalar(
    "q_intent",
    lambda c: T.intent(T.norm_rules(c)),
    "CASE " + " ".join(f"WHEN {any_sql(RULES_SQL, phrases)} THEN '{name}'" for name, phrases in T.INTENTS.items()) + " ELSE 'UNKNOWN' END",
)
scalar(
    "q_extract_links",
    lambda c: F.array_join(T.extract_links(F.coalesce(c, F.lit(""))), "|"),
    rf"""array_to_string(list_reduce(list_concat([[]::VARCHAR[]], list_transform(list_concat(
      regexp_extract_all(coalesce(text, ''), '(?:https?://|www\.|(?:{T.SHORTENERS})/)[A-Za-z0-9./?=&_%#:~-]*[A-Za-z0-9_/]'),
      list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_-]+\.(?:{'|'.join(T.LINK_TLDS)})(?:[^A-Za-z0-9_]|$)'),
        lambda s: regexp_replace(s, '[^A-Za-z0-9_]$', ''))), lambda s: [s])),
      lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END), '|')""",
)
LINKS_SQL = rf"""list_concat(regexp_extract_all(coalesce(text, ''), '(?:https?://|www\.|(?:{T.SHORTENERS})/)[A-Za-z0-9./?=&_%#:~-]*[A-Za-z0-9_/]'),
  list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_-]+\.(?:{'|'.join(T.LINK_TLDS)})(?:[^A-Za-z0-9_]|$)'), lambda s: regexp_replace(s, '[^A-Za-z0-9_]$', '')))"""
TLD_SQL = "|".join(t[1:] for t in T.SUSPICIOUS_TLDS)
for _name, _test, _tail in (("q_tld_host", T.tld_at_host_end, "(/|$)"), ("q_tld_anywhere", T.tld_anywhere, "")):
    scalar(
        _name,
        lambda c, test=_test: test(T.extract_links(F.coalesce(c, F.lit("")))),
        rf"len(list_filter({LINKS_SQL}, lambda u: regexp_matches(lower(u), '\.({TLD_SQL}){_tail}'))) > 0",
    )
scalar("q_url_flag", lambda c: F.rlike(F.lower(F.coalesce(c, F.lit(""))), F.lit(T.URL_FLAG)), f"regexp_matches({LOWERED}, '{T.URL_FLAG}')")
scalar(
    "q_url_flag_device",
    lambda c: F.rlike(F.lower(F.coalesce(c, F.lit(""))), F.lit(T.DEVICE_URL_FLAG)),
    f"regexp_matches({LOWERED}, '{T.DEVICE_URL_FLAG}')",
)
scalar("q_double_extension", lambda c: F.rlike(F.lower(F.coalesce(F.element_at(F.split(c, " "), -2), F.lit(""))), F.lit(T.DOUBLE_EXTENSION)),
       f"regexp_matches(lower(coalesce(string_split(text, ' ')[-2], '')), '{T.DOUBLE_EXTENSION}')")
scalar(
    "q_script_language",
    lambda c: T.script_language(F.coalesce(c, F.lit(""))),
    """CASE WHEN trim(coalesce(text, '')) = '' THEN 'unknown'
      WHEN len(regexp_extract_all(text, '[А-Яа-яЁёЎўҚқҒғҲҳA-Za-z]')) = 0 THEN 'unknown'
      WHEN len(regexp_extract_all(text, '[А-Яа-яЁёЎўҚқҒғҲҳ]')) / len(regexp_extract_all(text, '[А-Яа-яЁёЎўҚқҒғҲҳA-Za-z]')) >= 0.7
        THEN CASE WHEN regexp_matches(text, '[ЎўҚқҒғҲҳ]') THEN 'uz' ELSE 'ru' END
      WHEN len(regexp_extract_all(text, '[A-Za-z]')) / len(regexp_extract_all(text, '[А-Яа-яЁёЎўҚқҒғҲҳA-Za-z]')) >= 0.7
        THEN CASE WHEN regexp_matches(lower(text), 'o[''‘ʻ]|g[''‘ʻ]') THEN 'uz' ELSE 'en' END
      ELSE 'mixed' END""",
)
LABEL_SQL = "[' Ham', 'safe ', 'spam', 'SUSPICIOUS', 'scam', 'Dangerous', 'legit', 'Phishing-kit', 'other', NULL][doc_id % 10 + 1]"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (" Ham", "safe ", "spam", "SUSPICIOUS", "scam", "Dangerous", "legit", "Phishing-kit", "other", None)
    return load(spark, sf_dir, "documents").select("doc_id", F.array(*map(F.lit, names))[(F.col("doc_id") % 10).cast("int")].alias("name"))


@R.add(
    "q_label_map",
    f"""SELECT * FROM (SELECT doc_id, CASE WHEN n IN ('ham', 'safe') THEN 'SAFE' WHEN n IN ('spam', 'suspicious') THEN 'SUSPICIOUS'
      WHEN n IN ('scam', 'dangerous') THEN 'DANGEROUS' END AS label FROM (SELECT doc_id, lower(trim({LABEL_SQL})) AS n FROM documents))
      WHERE label IS NOT NULL""",
)
def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("doc_id", T.label_by_name(F.col("name")).alias("label")).filter("label IS NOT NULL")


@R.add(
    "q_label_substr",
    f"""SELECT doc_id, CASE WHEN n IS NULL THEN 'SUSPICIOUS' WHEN regexp_matches(n, 'phishing|fraud|scam|malware|dangerous') THEN 'DANGEROUS'
      WHEN regexp_matches(n, 'ham|legit|normal|safe') THEN 'SAFE' ELSE 'SUSPICIOUS' END AS label
      FROM (SELECT doc_id, lower({LABEL_SQL}) AS n FROM documents)""",
)
def label_substr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("doc_id", T.label_by_part(F.col("name")).alias("label"))


SHARES_SQL = """p AS (SELECT user_id, ts::DATE AS day, count(*) FILTER (event_type = 'error') / count(*)::DOUBLE AS d,
        count(*) FILTER (event_type = 'click') / count(*)::DOUBLE AS s, count(*) FILTER (event_type NOT IN ('error', 'click')) / count(*)::DOUBLE AS safe
      FROM events WHERE event_type IS NOT NULL GROUP BY ALL)"""


def shares(events: DataFrame) -> DataFrame:
    """user_id, day, and the shares of a user's events of a day that are errors (d), clicks (s) and others (safe): the
    probabilities of a model by frequencies. Counted where the events are before users meet."""
    kind = F.col("event_type")
    counts = events.filter(kind.isNotNull()).groupBy("user_id", F.to_date("ts").alias("day"))
    told = {"d": kind == "error", "s": kind == "click", "safe": ~kind.isin("error", "click")}
    return counts.agg(*((F.count_if(is_it) / F.count("*")).alias(name) for name, is_it in told.items()))


@R.add(
    "q_fusion",
    f"""WITH {SHARES_SQL}, g AS (SELECT event_id, (floor(value) % 101)::INT AS rule, CASE event_type WHEN 'purchase' THEN 60 WHEN 'signup' THEN 40 WHEN 'error' THEN 5 ELSE 0 END AS "floor",
        event_id % 2 = 0 AS hard, p.d, p.s FROM events e JOIN p ON p.user_id = e.user_id AND p.day = e.ts::DATE WHERE event_type IS NOT NULL),
      x AS (SELECT *, least(greatest(d::FLOAT * 100::FLOAT + s::FLOAT * 50::FLOAT, 0::FLOAT), 100::FLOAT) AS ml, greatest(rule, "floor")::FLOAT AS b FROM g),
      y AS (SELECT *, CASE WHEN d >= 0.9 THEN greatest(b, 90::FLOAT) WHEN (d >= 0.5 OR s >= 0.7) AND ml > b
        THEN greatest(b, b * 0.4::FLOAT + ml * 0.6::FLOAT) ELSE b END AS l FROM x),
      z AS (SELECT *, CASE WHEN NOT hard AND l > 60 THEN 60::FLOAT ELSE l END AS c FROM y),
      w AS (SELECT *, CASE WHEN c >= 55 AND c < 70 AND (d >= 0.5 OR ml >= 65) THEN 70::FLOAT ELSE c END AS r FROM z),
      v AS (SELECT *, trunc(least(greatest(CASE WHEN s > 0.5 AND NOT hard AND r < 40 THEN 40::FLOAT ELSE r END, 0::FLOAT), 100::FLOAT))::INT AS risk FROM w)
      SELECT event_id, risk, CASE WHEN risk >= 70 THEN 'DANGEROUS' WHEN risk >= 40 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS band FROM v""",
)
def fused_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's score by rule, the floor of its type, and its user's probabilities of the day, fused."""
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    floor = F.when(F.col("event_type") == "purchase", 60).when(F.col("event_type") == "signup", 40).when(F.col("event_type") == "error", 5).otherwise(0)
    rows = events.filter("event_type IS NOT NULL").select(
        "event_id", "user_id", F.to_date("ts").alias("day"), (F.floor("value") % 101).cast("int").alias("rule"), floor.alias("floor"), (F.col("event_id") % 2 == 0).alias("hard")
    )
    risk = fusion.fuse(*(F.col(c) for c in ("rule", "floor", "d", "s", "hard")))["risk"]
    told = rows.join(shares(events), ["user_id", "day"]).select("event_id", risk.alias("risk"))
    return told.withColumn("band", T.risk_band(F.col("risk")))


@R.add(
    "q_model_label",
    f"""WITH {SHARES_SQL} SELECT user_id, day::VARCHAR AS day,
      CASE WHEN d >= 0.6 THEN 'DANGEROUS' WHEN d >= s AND d >= safe THEN 'DANGEROUS' WHEN s >= safe THEN 'SUSPICIOUS' ELSE 'SAFE' END AS label FROM p""",
)
def model_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of each user's day by its three probabilities."""
    label = fusion.model_label(F.col("d"), F.col("s"), F.col("safe"))
    return shares(load(spark, sf_dir, "events")).select("user_id", F.col("day").cast("string").alias("day"), label.alias("label"))


@R.add(
    "q_metadata_flags",
    f"""WITH {MESSAGES_SQL} SELECT id, coalesce(length(text), 0)::BIGINT AS length, regexp_matches({LOWERED}, '{T.URL_FLAG}') AS has_url,
      regexp_matches(coalesce(text, ''), '[0-9]') AS has_number FROM m""",
)
def metadata_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return messages(spark, sf_dir).select(
        "id",
        F.char_length(text).cast("long").alias("length"),
        F.rlike(F.lower(text), F.lit(T.URL_FLAG)).alias("has_url"),
        F.rlike(text, F.lit("[0-9]")).alias("has_number"),
    )
