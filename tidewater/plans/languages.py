"""Language detectors, hints, relabelling and tags over whole messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import language as L
from tidewater.functions.text import WORD
from tidewater.plans.messages import MESSAGES_SQL, any_sql, messages, quoted
from tidewater.operators.checks import looked_up
from tidewater.operators.rules import settled
from tidewater.plans.registry import Registry
from tidewater.session import load

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def count_sql(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {quoted(pattern)}))"


def like_sql(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quoted(pattern)})"


def known_sql(tokens: str, words: Sequence[str]) -> str:
    return f"len(list_intersect({tokens}, [{', '.join(map(quoted, dict.fromkeys(words)))}]))"


SHARES_SQL = f"""{MESSAGES_SQL}, s AS (SELECT id, text, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low,
  {count_sql("coalesce(text, '')", L.CYRILLIC)} AS c, {count_sql("coalesce(text, '')", L.LATIN)} AS l FROM m)"""
MARKERS = f"{'|'.join(L.UZBEK_APOSTROPHES)}|{L.whole(L.UZBEK_MARKERS)}"
LETTERS = f"[{L.UZBEK_CYRILLIC}]"


@R.add(
    "q_language_markers",
    f"""WITH {SHARES_SQL}, f AS (SELECT *, {like_sql('low', LETTERS)} AS ul, {like_sql('low', MARKERS)} AS uw, {like_sql('low', L.whole(L.RUSSIAN_MARKERS))} AS rw FROM s),
      r AS (SELECT id, CASE WHEN c + l = 0 THEN 1.0::DOUBLE ELSE greatest(c, l) / (c + l) END AS share, CASE
        WHEN NOT {like_sql('t', '[^ ]')} THEN 'en empty_default' WHEN c + l = 0 THEN 'en no_alpha_default'
        WHEN c / (c + l) >= 0.7 THEN CASE WHEN ul THEN 'uz cyrillic_uz_chars' WHEN rw THEN 'ru cyrillic_ru_words' ELSE 'ru cyrillic_default' END
        WHEN l / (c + l) >= 0.7 THEN CASE WHEN uw THEN 'uz latin_uz_markers' ELSE 'en latin_default' END
        WHEN c > l THEN CASE WHEN ul THEN 'uz mixed_uz_cyrillic' ELSE 'ru mixed_cyrillic_dominant' END
        WHEN uw THEN 'uz mixed_uz_latin' ELSE 'en mixed_latin_dominant' END AS r FROM f)
      SELECT id, string_split(r, ' ')[1] AS language, string_split(r, ' ')[2] AS method, share FROM r""",
)
def language_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.by_markers(messages(spark, sf_dir)).select("id", "language", "method", "share")


TOKENS_SQL = f"""{SHARES_SQL}, k AS (SELECT *, regexp_extract_all(low, {quoted(L.TOKEN)}) AS ts FROM s),
  n AS (SELECT *, {known_sql('ts', L.UZBEK_WORDS)} AS uz, {known_sql('ts', L.RUSSIAN_WORDS)} AS ru,
    {known_sql('ts', L.ENGLISH_WORDS)} AS en, {known_sql('ts', L.ENGLISH_FEW)} AS few FROM k),
  p AS (SELECT *, 2 * uz + CASE WHEN {any_sql('low', ("o'", "g'", "o`", "g`"))} THEN 3 ELSE 0 END + CASE WHEN {any_sql('low', ("oʻ", "gʻ"))} THEN 3 ELSE 0 END
    + CASE WHEN contains(low, 'sh') THEN 0.5 ELSE 0 END + CASE WHEN contains(low, 'ch') THEN 0.5 ELSE 0 END AS pts, {like_sql('t', LETTERS)} AS ul FROM n),
  d AS (SELECT id, CASE WHEN NOT {like_sql('t', '[^ ]')} THEN 'en low empty_text' WHEN len(ts) = 0 THEN 'en low no_tokens' WHEN c + l = 0 THEN 'en low no_alpha_chars'
    WHEN c / (c + l) >= 0.7 THEN CASE WHEN ul AND uz > ru THEN 'uz high cyrillic_uz_chars_and_words' WHEN ul AND uz > 0 THEN 'uz medium cyrillic_uz_chars'
      WHEN ru > 0 THEN 'ru high cyrillic_ru_words' ELSE 'ru medium cyrillic_default' END
    WHEN l / (c + l) >= 0.7 THEN CASE WHEN pts >= 3 AND uz > en THEN 'uz high latin_uz_markers_and_words' WHEN pts >= 2 THEN 'uz medium latin_uz_markers'
      WHEN en >= 2 THEN 'en high latin_en_words' WHEN en = 1 THEN 'en medium latin_en_default' ELSE 'en low latin_default' END
    WHEN uz + ru + few = 0 THEN CASE WHEN c > l THEN 'ru low mixed_cyrillic_dominant' ELSE 'en low mixed_latin_dominant' END
    WHEN uz = greatest(uz, ru, few) THEN 'uz low mixed_script_uz_words' WHEN ru = greatest(ru, few) THEN 'ru low mixed_script_ru_words'
    ELSE 'en low mixed_script_en_words' END AS r FROM p),
  det AS (SELECT id, string_split(r, ' ')[1] AS language, string_split(r, ' ')[2] AS confidence, string_split(r, ' ')[3] AS method FROM d)"""


@R.add("q_language_tokens", f"WITH {TOKENS_SQL} SELECT * FROM det")
def language_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.by_tokens(messages(spark, sf_dir)).select("id", "language", "confidence", "method")


#: Names that data sets give languages, for the hint queries; our own choice by id.
HINTS = ("English", "uzb", " RU ", "mixed", "fr", "")


def hinted(rows: DataFrame) -> DataFrame:
    hint = F.array(*map(F.lit, HINTS))[F.pmod("id", F.lit(len(HINTS))).cast("int")]
    return rows.withColumn("hint", hint)


HINT_SQL = f"[{', '.join(map(quoted, HINTS))}][id % {len(HINTS)} + 1]"
CODE_SQL = "CASE {0} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in L.LANGUAGE_NAMES.items()) + " END"


@R.add(
    "q_language_hint",
    f"""WITH {TOKENS_SQL}, h AS (SELECT *, {HINT_SQL} AS hint FROM det), g AS (SELECT *, nullif({CODE_SQL.format('lower(trim(hint))')}, 'mixed') AS code FROM h)
      SELECT id, hint, language AS detected,
        CASE WHEN code IS NULL OR code = language OR confidence IN ('high', 'medium') THEN language ELSE code END AS language,
        CASE WHEN code IS NULL THEN confidence WHEN code = language THEN 'high' WHEN confidence = 'high' THEN 'medium' ELSE 'low' END AS confidence,
        CASE WHEN trim(hint) = '' THEN 'detected_only' WHEN code IS NULL THEN 'hint_unknown_using_detected' WHEN code = language THEN 'hint_and_detected_agree'
          WHEN confidence = 'high' THEN 'detected_overrides_hint_' || code WHEN confidence = 'medium' THEN 'detected_vs_hint_' || code
          ELSE 'hint_used_low_detection' END AS method FROM g""",
)
def language_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hinted(L.by_tokens(messages(spark, sf_dir)).select("id", "language", "confidence"))
    told = rows.withColumn("_r", L.resolve_hint(F.col("language"), F.col("confidence"), F.col("hint")))
    return told.select(
        "id", "hint", F.col("language").alias("detected"), *(F.col("_r")[i].alias(n) for i, n in enumerate(("language", "confidence", "method")))
    )


@R.add(
    "q_uncertain_log",
    f"""WITH {TOKENS_SQL}, h AS (SELECT *, {HINT_SQL} AS hint FROM det), g AS (SELECT *, nullif({CODE_SQL.format('lower(trim(hint))')}, 'mixed') AS code FROM h),
      r AS (SELECT id, hint, language AS detected, confidence AS detected_confidence,
        CASE WHEN code IS NULL OR code = language OR confidence IN ('high', 'medium') THEN language ELSE code END AS language,
        CASE WHEN code IS NULL THEN confidence WHEN code = language THEN 'high' WHEN confidence = 'high' THEN 'medium' ELSE 'low' END AS confidence,
        CASE WHEN trim(hint) = '' THEN 'detected_only' WHEN code IS NULL THEN 'hint_unknown_using_detected' WHEN code = language THEN 'hint_and_detected_agree'
          WHEN confidence = 'high' THEN 'detected_overrides_hint_' || code WHEN confidence = 'medium' THEN 'detected_vs_hint_' || code ELSE 'hint_used_low_detection' END AS method FROM g)
      SELECT * FROM r WHERE confidence = 'low' OR contains(method, 'overrides') OR contains(method, 'mixed')""",
)
def uncertain_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the side log of uncertain languages: low confidence in the end, or a hint that was overridden."""
    rows = hinted(L.by_tokens(messages(spark, sf_dir)).select("id", "language", "confidence"))
    told = rows.withColumn("_r", L.resolve_hint(F.col("language"), F.col("confidence"), F.col("hint")))
    # Computed once: the filter reads it three times.
    told = settled(told, "language", "confidence", "_r")
    log = told.select(
        "id", "hint", F.col("language").alias("detected"), F.col("confidence").alias("detected_confidence"), *(F.col("_r")[i].alias(n) for i, n in enumerate(("language", "confidence", "method")))
    )
    return log.filter((F.col("confidence") == "low") | F.contains("method", F.lit("overrides")) | F.contains("method", F.lit("mixed")))


@R.add(
    "q_dictionary_lookup",
    f"""WITH m AS (SELECT unnest({[*L.LANGUAGE_NAMES]!r}) AS name, unnest({[*L.LANGUAGE_NAMES.values()]!r}) AS code)
      SELECT doc_id AS id, coalesce(m.code, 'unknown') AS language FROM documents LEFT JOIN m ON lower(trim(lang)) = m.name""",
)
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by a join with the table of their names; each name is there once, so no row is doubled."""
    names = spark.createDataFrame(list(L.LANGUAGE_NAMES.items()), "name string, code string")
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower(F.trim("lang")).alias("name"))
    return looked_up(docs, names, "name", "code", "unknown").select("id", F.col("code").alias("language"))


SHARE_SQL = f"""CASE WHEN c + l = 0 THEN 'en' WHEN {like_sql('low', f'{LETTERS}|{L.whole(L.SHARE_MARKERS)}')} THEN 'uz' WHEN c > l THEN 'ru' ELSE 'en' END"""


@R.add(
    "q_language_share",
    f"""WITH {SHARES_SQL}, d AS (SELECT id, {HINT_SQL} AS hint, {SHARE_SQL} AS language FROM s)
      SELECT id, language, CASE WHEN lower(trim(hint)) = language THEN 'high' WHEN lower(trim(hint)) NOT IN ('uz', 'en', 'ru') THEN 'medium' ELSE 'low' END AS confidence FROM d""",
)
def language_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hinted(messages(spark, sf_dir)).withColumn("language", L.by_share(F.col("text")))
    return rows.select("id", "language", L.agreement(F.col("hint"), F.col("language")).alias("confidence"))


def share_sql(text: str) -> str:
    return f"{count_sql(text, '[а-яё]')} / {count_sql(text, '[\\p{L}\\p{N}]')}"


AUDIT_SQL = f"""CASE WHEN NOT {like_sql('t', '[^ ]')} THEN 'unknown'
  WHEN {count_sql('low', '[\\p{L}\\p{N}]')} > 0 AND {share_sql('low')} > 0.4 THEN 'ru'
  WHEN u > e THEN 'uz' WHEN e > u THEN 'en' WHEN {like_sql('t', "['‘’]")} THEN 'uz' ELSE 'mixed' END"""


@R.add(
    "q_language_audit",
    f"""WITH {SHARES_SQL}, w AS (SELECT *, regexp_extract_all(low, '[{WORD}]+') AS ws FROM s),
      k AS (SELECT *, {known_sql('ws', L.AUDIT_UZBEK)} AS u, {known_sql('ws', L.AUDIT_ENGLISH)} AS e FROM w) SELECT id, {AUDIT_SQL} AS language FROM k""",
)
def language_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", L.by_audit(F.col("text")).alias("language"))


@R.add(
    "q_language_keywords",
    f"WITH {SHARES_SQL} SELECT id, CASE WHEN {any_sql('low', L.KEYWORD_UZBEK)} THEN 'uz' WHEN {like_sql('low', '[а-яё]')} THEN 'ru' ELSE 'en' END AS language FROM s",
)
def language_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", L.by_keywords(F.col("text")).alias("language"))


@R.add(
    "q_language_letters",
    f"""WITH {SHARES_SQL}, b AS (SELECT id, low, {like_sql('low', '[а-яё]')} AS cy, {like_sql('low', '[a-z]')} AS la FROM s)
      SELECT id, CASE WHEN cy AND la THEN 'Mixed' WHEN cy THEN CASE WHEN {like_sql('low', LETTERS)} THEN 'Uzbek (Cyrillic)' WHEN {like_sql('low', '[ыщъё]')} THEN 'Russian'
        ELSE 'Cyrillic (Probable RU/UZ)' END WHEN la THEN CASE WHEN {any_sql('low', L.LETTER_UZBEK)} THEN 'Uzbek (Latin)' ELSE 'English' END ELSE 'Unknown' END AS language FROM b""",
)
def language_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", L.by_letters(F.col("text")).alias("language"))


@R.add("q_lang_norm", f"SELECT doc_id AS id, coalesce({CODE_SQL.format('lower(trim(lang))')}, 'unknown') AS language FROM documents")
def lang_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), L.language_code(F.col("lang"), "unknown").alias("language"))


@R.add("q_composite_label", """SELECT doc_id, CASE WHEN quality IS NULL AND toxic IS NULL THEN NULL ELSE concat_ws('|', quality::VARCHAR, toxic::VARCHAR) END AS label FROM labels""")
def composite_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality, toxic = (F.col(c).cast("string") for c in ("quality", "toxic"))
    return load(spark, sf_dir, "labels").select("doc_id", L.composite_label(quality, toxic).alias("label"))


def flag_sql(words: Sequence[str]) -> str:
    return any_sql("low", tuple(words))


@R.add(
    "q_relabel",
    f"""WITH {SHARES_SQL}, b AS (SELECT id, id % 2 = 0 AS scam, low, {flag_sql(L.ASKS)} AS asks, {flag_sql(L.SECRETS)} AS secret, {flag_sql(L.PAYLOADS)} AS payload,
        {flag_sql(L.OTP_INFO)} AS info, {flag_sql(L.OTP_WARNING)} AS warning FROM s)
      SELECT id, CASE WHEN NOT scam THEN 'SAFE' WHEN asks AND secret OR payload THEN 'DANGEROUS' ELSE 'SUSPICIOUS' END AS risk_label,
        CASE WHEN scam THEN CASE WHEN asks OR payload THEN 'REQUEST' ELSE 'UNKNOWN' END WHEN info THEN 'INFO' WHEN warning THEN 'WARNING' ELSE 'UNKNOWN' END AS intent_label,
        concat_ws(',', CASE WHEN scam AND payload THEN 'malware' END, CASE WHEN scam AND {flag_sql(('http', 'www'))} THEN 'link' END,
          CASE WHEN scam AND {flag_sql(L.PRIZES)} THEN 'prize_bait' END, CASE WHEN NOT scam AND info THEN 'otp' END,
          CASE WHEN NOT scam AND NOT info AND warning THEN 'otp_warning' END) AS tags FROM b""",
)
def relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old labels are by id: even ids are scams."""
    names = ("risk_label", "intent_label", "tags")
    return messages(spark, sf_dir).select("id", *(c.alias(n) for c, n in zip(L.relabel(F.pmod("id", F.lit(2)) == 0, F.col("text")), names)))


RISKS = ("SAFE", "SUSPICIOUS", "DANGEROUS")


def tag_sql() -> str:
    parts = [f"CASE WHEN risk = '{label}' AND {flag_sql(words)} THEN '{tag}' END" for label, tag, words in L.HARD_TAGS]
    login = f"CASE WHEN risk = 'DANGEROUS' AND contains(low, 'login') AND {flag_sql(('parol', 'verify', 'password', 'auth'))} THEN 'DANG:phishing_login' END"
    code = "CASE WHEN risk = 'DANGEROUS' AND contains(low, 'kod') AND contains(low, 'yuboring') THEN 'DANG:otp_harvesting' END"
    return ", ".join([*parts[:9], login, parts[9], code, *parts[10:]])


@R.add("q_hard_tags", f"WITH {SHARES_SQL}, b AS (SELECT id, low, [{', '.join(map(quoted, RISKS))}][id % 3 + 1] AS risk FROM s) SELECT id, risk, concat_ws(',', {tag_sql()}) AS tags FROM b")
def hard_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are by id."""
    risk = F.array(*map(F.lit, RISKS))[F.pmod("id", F.lit(3)).cast("int")]
    rows = messages(spark, sf_dir).withColumn("risk", risk)
    return rows.select("id", "risk", F.array_join(L.hard_tags(F.col("risk"), F.col("text")), ",").alias("tags"))
