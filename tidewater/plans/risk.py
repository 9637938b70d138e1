"""Rule engine queries: each document's whole text with two phrases of our own, through signals, floors, score and result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import lexicon, results as X, text as T
from tidewater.operators import analyze as A, rules
from tidewater.plans.curation import files_sql
from tidewater.plans.messages import LINKS_SQL, RULES_SQL, any_sql, quoted
from tidewater.plans.registry import Registry
from tidewater.session import load

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

#: Phrases of our own, so that each rule holds for some messages, alone and beside others.
FIRST = (
    "", "kodni yuboring", "bu kodni hech kimga bermang", "tasdiqlash kodi: 12", "darhol", "aks holda hisobingiz bloklandi", "siz yutdingiz, bonus",
    "see my video", "telegram premium sizga", "payment pay now", "cvv va visa", "download photo.jpg.apk", "hisobga kiring", "pasport seriyasi", "yangilang",
    "hoziroq aksiya", "open report.zip", "javob bering yuboring", "tushum: 5000", "do not share", "СРОЧНО",
)
SECOND = (
    "", "https://pay.example.org/login?x=1", "win.xyz", "t.me/some", "zudlik bilan", "setup.exe", "bonus", "bank karta", "otp", "jarima",
    "yuboring", "profilingizni yangilang", "my.gov.uz",
)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and message: each document with a pair of phrases; blank messages beside them."""
    first = F.array(*map(F.lit, FIRST))[F.pmod("doc_id", F.lit(len(FIRST))).cast("int")]
    second = F.array(*map(F.lit, SECOND))[F.pmod("doc_id", F.lit(len(SECOND))).cast("int")]
    docs = load(spark, sf_dir, "documents")
    both = docs.select(F.col("doc_id").alias("id"), F.concat_ws(" ", "text", first, second).alias("message"))
    short = docs.select((F.col("doc_id") + SHORT_ID).alias("id"), F.concat_ws(" ", first, second).alias("message"))
    return both.unionByName(short)


#: Added to the id of a document for the id of the message of its phrases alone.
SHORT_ID = 1_000_000_000_000


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def occurs_sql(word: str) -> str:
    tight = word.replace(" ", "")
    return f"contains(t, {quoted(word)}) OR contains(tight, {quoted(tight)}) OR contains(bare, {quoted(tight.replace('.', ''))})"


def kept_sql(cases_: list[tuple[str, str]]) -> str:
    """A list of the values whose conditions hold."""
    each = ", ".join(f"CASE WHEN {when} THEN {quoted(value)} END" for value, when in cases_)
    return f"list_filter([{each}], lambda x: x IS NOT NULL)"


FOUND_SQL = kept_sql([(name, " OR ".join(map(occurs_sql, s.keywords))) for name, s in lexicon.SIGNALS.items() if s.keywords])
ENDS_SQL = "regexp_matches(lower({}), '\\.(" + "|".join(e[1:] for e in X.DANGEROUS_ENDINGS) + ")$')"
TLD_LIST = "|".join(t[1:] for t in T.SUSPICIOUS_TLDS)
INTENT_SQL = "CASE " + " ".join(f"WHEN {any_sql('t', phrases)} THEN '{name}'" for name, phrases in T.INTENTS.items()) + " ELSE 'UNKNOWN' END"
EXTRA_SQL = kept_sql(
    [
        ("suspicious_link", "len(links) > 0"),
        ("suspicious_tld_match", f"len(list_filter(links, lambda u: regexp_matches(lower(u), '\\.({TLD_LIST})(/|$)'))) > 0"),
        ("phishing_login", f"len(list_filter(links, lambda u: {' OR '.join(f'contains(lower(u), {quoted(w)})' for w in X.PHISHING_WORDS)})) > 0"),
        ("double_extension_trick", f"coalesce(regexp_matches(lower(file), '{T.DOUBLE_EXTENSION}'), false)"),
        ("dangerous_file_extension", f"coalesce({ENDS_SQL.format('file')}, false)"),
    ]
)
EVIDENCE_SQL = f"""q AS (SELECT doc_id, text AS body, {listed(FIRST)}[doc_id % {len(FIRST)} + 1] AS p1, {listed(SECOND)}[doc_id % {len(SECOND)} + 1] AS p2 FROM documents),
  m AS (SELECT doc_id AS id, concat_ws(' ', body, p1, p2) AS message FROM q UNION ALL SELECT doc_id + {SHORT_ID}, concat_ws(' ', p1, p2) FROM q),
  n0 AS (SELECT id, message, trim(message) AS text FROM m),
  n1 AS (SELECT *, {RULES_SQL} AS t, {LINKS_SQL} AS all_links, list_transform(flatten([{files_sql()}]), lambda f: trim(f))[1] AS file FROM n0),
  n2 AS (SELECT *, replace(t, ' ', '') AS tight, replace(replace(t, ' ', ''), '.', '') AS bare,
    list_filter(all_links, lambda u, i: list_position(all_links, u) = i) AS links, {INTENT_SQL} AS intent FROM n1),
  n3 AS (SELECT *, {FOUND_SQL} AS found, {EXTRA_SQL} AS extra FROM n2),
  n4 AS (SELECT * EXCLUDE (found, extra), list_concat(found, list_filter(extra, lambda x: NOT list_contains(found, x))) AS s FROM n3),
  c AS (SELECT *, len(links) > 0 AS link, len(list_filter(links, lambda u: regexp_matches(lower(u), '\\.({TLD_LIST})'))) > 0 AS tld,
    list_contains(s, 'dangerous_file_extension') OR coalesce({ENDS_SQL.format('file')}, false) AS bad,
    coalesce(regexp_matches(lower(file), '{T.DOUBLE_EXTENSION}'), false) OR list_contains(s, 'double_extension_trick') AS twice, file IS NOT NULL AS filed FROM n4)"""


def has_sql(*names: str) -> str:
    return "(" + " OR ".join(f"list_contains(s, '{n}')" for n in names) + ")"


#: Each rule's key, floor and condition in SQL: before the cap, and after it.
EARLY_SQL = (
    ("request_otp_danger", 85, f"intent = 'REQUEST' AND {has_sql('otp_request')}"),
    ("request_card_scam", 90, f"intent = 'REQUEST' AND {has_sql('card_phishing_bait', 'financial_data_request')}"),
    ("request_link_phishing", 70, "intent = 'REQUEST' AND link"),
    ("safe_override_applied", 5, f"intent IN ('WARNING', 'INFO') AND {any_sql('t', lexicon.SAFE_PHRASES)} AND NOT tld AND NOT bad"),
    ("mixed_content_danger", 90, f"link AND (bad OR filed) AND {has_sql('urgency_pressure', 'prize_bait')}"),
    ("phishing_giveaway", 75, f"{has_sql('prize_bait')} AND link"),
    ("scam_promo", 80, f"{has_sql('prize_bait')} AND tld"),
    ("financial_phishing", 85, f"{has_sql('financial_data_request')} AND link"),
    ("credential_theft", 80, f"{has_sql('otp_request', 'personal_info_request')} AND {has_sql('urgency_pressure')}"),
    ("tg_premium_scam", 80, f"{has_sql('phishing_auth_bait')} AND link"),
    ("tg_phishing_extreme", 85, f"{has_sql('phishing_auth_bait')} AND tld"),
    ("malware_delivery", 90, "bad"),
    ("hidden_malware", 95, "twice AND (bad OR filed)"),
    ("social_malware", 90, f"{has_sql('prize_bait', 'curiosity_lure')} AND bad"),
    ("phishing_login_match", 90, f"{has_sql('phishing_login')} AND tld"),
    ("banking_alert_scam", 85, f"{has_sql('financial_data_request')} AND link"),
    ("fear_phishing", 75, f"{has_sql('fear_threat')} AND link"),
)
LATE_SQL = (
    ("intent_link_login", 70, f"link AND {has_sql('login_intent')}"),
    ("intent_link_payment", 65, f"link AND {has_sql('payment_intent')}"),
    ("intent_download_malware", 90, f"{has_sql('download_intent')} AND bad"),
    ("intent_urgent_account_threat", 80, f"{has_sql('urgency_intent')} AND {has_sql('fear_threat')} AND {has_sql('login_intent')}"),
    ("intent_bait_click", 55, f"{has_sql('prize_bait', 'curiosity_lure')} AND {has_sql('click_intent')}"),
    ("intent_payment_urgency", 70, f"{has_sql('payment_intent')} AND {has_sql('urgency_intent')}"),
    ("intent_submit_scam", 75, f"{has_sql('submit_intent')} AND (link OR {has_sql('login_intent')})"),
)


def floor_sql(table: tuple[tuple[str, int, str], ...]) -> str:
    return "greatest(" + ", ".join(f"CASE WHEN {when} THEN {floor} ELSE 0 END" for _, floor, when in table) + ")"


SOFT_SQL = " + ".join(f"list_contains(s, '{n}')::INT" for n in rules.SOFT_SIGNALS)
SEND_SQL = f"contains(t, '{rules.SEND_WORD}')"
KEPT_SQL = "list_filter(s, lambda n: NOT (" + " OR ".join(f"(n = '{weak}' AND list_contains(s, '{strong}'))" for strong, weak in rules.SUPPRESSION) + "))"


def category_sql(category: str) -> str:
    part = " + ".join(f"CASE WHEN list_contains(kept, '{n}') THEN {s.weight} ELSE 0 END" for n, s in lexicon.SIGNALS.items() if s.category == category)
    cap = {"SOCIAL_ENGINEERING": 30, "FINANCIAL": 40}.get(category)
    return f"least({part}, {cap})" if cap else f"({part})"


JUDGED_SQL = f"""WITH {EVIDENCE_SQL},
  g AS (SELECT *, {KEPT_SQL} AS kept, {SOFT_SQL} AS soft, {any_sql('t', rules.STRONG_PHRASES)} AS strong,
    link OR bad OR {has_sql('otp_request', 'card_phishing_bait')} OR ({has_sql('payment_intent')} AND ({has_sql('urgency_pressure')} OR {SEND_SQL}))
      OR ({has_sql('submit_intent')} AND {SEND_SQL}) AS hard FROM c),
  k AS (SELECT *, NOT hard AND (soft >= 2 OR strong) AS pressed, least(100, {' + '.join(category_sql(c) for c in sorted({s.category for s in lexicon.SIGNALS.values()}))}) AS base FROM g),
  r AS (SELECT *, greatest({floor_sql(EARLY_SQL)}, CASE WHEN pressed AND (soft >= 3 OR strong) THEN 50 WHEN pressed THEN 40 ELSE 0 END) AS early,
    {kept_sql([(key, when) for key, _, when in EARLY_SQL] + [('soft_manipulation_floor', 'pressed')] + [(key, when) for key, _, when in LATE_SQL])} AS keys FROM k),
  j AS (SELECT *, greatest(CASE WHEN hard THEN early ELSE least(early, 60) END, {floor_sql(LATE_SQL)},
    CASE WHEN hard AND (len(s) >= 5 OR (len(s) = 4 AND (link OR bad))) THEN 95 ELSE 0 END) AS pattern_floor FROM r),
  v AS (SELECT *, greatest(base, pattern_floor) AS top FROM j),
  w AS (SELECT *, CASE WHEN NOT hard AND top > 60 THEN 60 ELSE top END AS fused FROM v),
  z AS (SELECT *, trim(message) = '' AND NOT link AND NOT filed AS nothing,
    CASE WHEN list_contains(keys, 'safe_override_applied') AND NOT hard AND fused >= 40 THEN 39 ELSE fused END AS guarded FROM w),
  a AS (SELECT *, CASE WHEN nothing THEN 0 ELSE guarded END AS risk FROM z),
  l AS (SELECT *, CASE WHEN risk >= 70 THEN 'XAVFLI' WHEN risk >= 40 THEN 'SHUBHALI' ELSE 'XAVFSIZ' END AS level FROM a)"""


@R.add("q_signals", f"WITH {EVIDENCE_SQL} SELECT id, intent, array_to_string(s, '|') AS signals FROM c")
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.evidence(cases(spark, sf_dir)).select("id", "intent", F.array_join("signals", "|").alias("signals"))


@R.add("q_signal_suppression", f"{JUDGED_SQL} SELECT id, array_to_string(kept, '|') AS kept FROM l")
def signal_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.evidence(cases(spark, sf_dir)).select("id", F.array_join(rules.suppress(F.col("signals")), "|").alias("kept"))


@R.add("q_base_score", f"{JUDGED_SQL} SELECT id, base::INT AS base_score FROM l")
def base_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.suppress(F.col("signals"))
    return A.evidence(cases(spark, sf_dir)).select("id", rules.base_score(found, lexicon.WEIGHTS).cast("int").alias("base_score"))


@R.add("q_pattern_floor", f"{JUDGED_SQL} SELECT id, hard AS hard_threat, pattern_floor::INT AS pattern_floor, array_to_string(keys, '|') AS pattern_keys FROM l")
def pattern_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.judged(cases(spark, sf_dir))
    return rows.select("id", "hard_threat", F.col("pattern_floor").cast("int").alias("pattern_floor"), F.array_join("pattern_keys", "|").alias("pattern_keys"))


@R.add(
    "q_analyze",
    f"""{JUDGED_SQL} SELECT id, risk::INT AS risk, level, CASE WHEN nothing OR risk < 40 THEN 'past' WHEN risk >= 70 THEN 'yuqori' ELSE 'o‘rta' END AS confidence,
      {any_sql('t', lexicon.FINANCIAL_ALERTS)} AS financial_alert, links[1] AS first_link FROM l""",
)
def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.analyze(cases(spark, sf_dir))
    return rows.select("id", F.col("risk").cast("int").alias("risk"), "level", "confidence", "financial_alert", "first_link")


@R.add(
    "q_failed_analysis",
    f"""{JUDGED_SQL}, y AS (SELECT *, id % 10 = 0 OR id % 10 = 5 AS failed FROM l)
      SELECT id, failed, CASE WHEN failed THEN 15 ELSE risk END::INT AS risk, CASE WHEN failed THEN 'XAVFSIZ' ELSE level END AS level,
      CASE WHEN failed THEN {quoted(A.FAILED_CONFIDENCE)} WHEN nothing THEN 'past' ELSE 'yuqori' END AS confidence,
      CASE WHEN failed THEN {quoted(A.FAILED_ADVICE)} END AS advice, CASE WHEN NOT failed THEN links[1] END AS first_link FROM y""",
)
def failed_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth payload is no UTF-8, and every tenth has a model's probability that is no number; of the others the
    model is sure that they are safe, and so is the confidence of their results."""
    rows = cases(spark, sf_dir)
    data = F.col("message").cast("binary")
    payload = F.when(F.col("id") % 10 == 0, F.concat(data, F.lit(b"\xc3"))).otherwise(data)
    model = F.when(F.col("id") % 10 == 5, F.lit(float("nan"))).otherwise(F.lit(0.0))
    told = A.analyze_checked(rows.select("id", payload.alias("payload"), model.alias("p")), F.col("p"), F.lit(0.0))
    advice = F.when(F.col("failed"), F.array_join("advice", "|"))
    return told.select("id", "failed", F.col("risk").cast("int").alias("risk"), "level", "confidence", advice.alias("advice"), "first_link")


@R.add("q_safe_override", f"{JUDGED_SQL} SELECT id, fused::INT AS score, guarded::INT AS kept FROM l WHERE list_contains(keys, 'safe_override_applied')")
def safe_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.judged(cases(spark, sf_dir)).filter(F.array_contains("pattern_keys", "safe_override_applied"))
    base = rules.base_score(rules.suppress(F.col("signals")), lexicon.WEIGHTS)
    top = F.greatest(base, F.col("pattern_floor"))
    score = F.when(~F.col("hard_threat") & (top > 60), 60).otherwise(top).cast("int")
    return rows.select("id", score.alias("score"), rules.apply_safe_override(score, F.col("pattern_keys"), F.col("hard_threat")).cast("int").alias("kept"))


def overlap_sql(names: tuple[str, ...]) -> str:
    return f"list_has_any(told, {listed(names)})"


def picked_sql(value: str, names: tuple[str, ...], yes: str, no: str) -> str:
    return f"CASE WHEN {overlap_sql(names)} THEN {quoted(yes)} ELSE {quoted(no)} END" if value == "told" else ""


ADVICE_SQL = kept_sql(
    [(text, f"filed OR {has_sql('dangerous_file_extension')}") for text in X.ADVICE_FILE]
    + [(text, f"link OR {has_sql('suspicious_link', 'suspicious_tld_match')}") for text in X.ADVICE_LINK]
    + [(text, has_sql("phishing_auth_bait", "prize_bait")) for text in X.ADVICE_PRIZE]
    + [(text, f"intent = 'REQUEST' AND {has_sql('otp_request', 'financial_data_request')}") for text in X.ADVICE_CODE]
    + [(text, has_sql("personal_info_request", "financial_data_request", "otp_request")) for text in X.ADVICE_DATA]
)
LINKED = overlap_sql(X.LINK_KEYS)


@R.add(
    "q_result_texts",
    f"""{JUDGED_SQL},
  t1 AS (SELECT *, list_concat(s, keys) AS told, {ADVICE_SQL} AS adv FROM l),
  t2 AS (SELECT *, {kept_sql([(group, overlap_sql(names)) for group, names in X.GROUPS.items()])} AS gs FROM t1),
  t3 AS (SELECT *, CASE gs[1] WHEN 'DOWNLOAD' THEN 'zararli APK ilova yoki faylni yuklab olishga '
      WHEN 'FINANCIAL' THEN CASE WHEN {LINKED} THEN 'shubhali havola orqali ' ELSE '' END
        || {picked_sql('told', ('card_phishing_bait', 'payment_intent'), 'to‘lov qilishga yoki karta ma’lumotlarini kiritishga ', 'shubhali moliyaviy amallarni bajarishga ')}
      WHEN 'ACCOUNT' THEN CASE WHEN {LINKED} THEN 'shubhali havola yordamida ' ELSE '' END
        || {picked_sql('told', ('phishing_login', 'otp_request'), 'shaxsiy akkauntingizni egallashga yoki hisobni tasdiqlashga ', 'akkaunt ma’lumotlarini yangilash niqobi ostida manipulyatsiyaga ')}
      WHEN 'ACTION' THEN CASE WHEN {LINKED} THEN 'shubhali havolani ochishga va ' ELSE '' END || 'noaniq harakatlarni bajarishga '
      WHEN 'PRESSURE' THEN 'ruhiy bosim o‘tkazish va shoshiltirish orqali chalg‘itishga '
      ELSE 'turli sovg‘alar yoki qiziqarli va’dalar bilan sizni jalb qilishga ' END AS main,
    CASE gs[2] {' '.join(f"WHEN '{g}' THEN {quoted(x)}" for g, x in X.SECOND.items())} END AS also FROM t2)
  SELECT id, CASE WHEN nothing THEN {quoted(A.EMPTY_ADVICE)} WHEN len(adv) = 0 THEN {quoted(X.ADVICE_NONE)} ELSE array_to_string(adv[1:3], '|') END AS advice,
    CASE WHEN nothing THEN '' ELSE concat_ws('|', CASE WHEN level = 'XAVFSIZ' THEN {quoted(X.SAFE_REASON)} WHEN len(gs) = 0 THEN {quoted(X.VAGUE_REASON)}
      ELSE 'Xabar ' || main || CASE WHEN gs[2] IS NOT NULL THEN 'va ' || also ELSE '' END || 'urinmoqda.' END,
      CASE WHEN level <> 'XAVFSIZ' AND len(gs) > 0 THEN CASE level WHEN 'XAVFLI' THEN {quoted(X.WARNINGS['XAVFLI'])} ELSE {quoted(X.WARNINGS['SHUBHALI'])} END END,
      'Fayl nomi: ' || file) END AS reasons FROM t3""",
)
def result_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.analyze(cases(spark, sf_dir)).select("id", F.array_join("advice", "|").alias("advice"), F.array_join("reasons", "|").alias("reasons"))


@R.add(
    "q_risk_bands",
    f"""{JUDGED_SQL} SELECT id, CASE WHEN risk >= 70 THEN 'DANGEROUS' WHEN risk >= 40 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS live,
      CASE WHEN risk >= 60 THEN 'DANGEROUS' WHEN risk >= 30 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS fifth,
      CASE WHEN risk <= 19.99 THEN 'SAFE' WHEN risk <= 54.99 THEN 'SUSPICIOUS' ELSE 'DANGEROUS' END AS sixth FROM l""",
)
def risk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands of today and of two older models, whose borders are 30 and 60, and 20 and 55."""
    risk = F.col("risk")
    bands = {"live": T.risk_band(risk), "fifth": T.risk_band(risk, 30, 60), "sixth": T.risk_band(risk, 20, 55)}
    return A.analyze(cases(spark, sf_dir)).select("id", *(c.alias(n) for n, c in bands.items()))
