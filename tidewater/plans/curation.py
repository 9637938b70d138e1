"""Flags, balancing, edge cases, patterns, model choice, files and result texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import results as X
from tidewater.functions import text as T
from tidewater.operators import split as S
from tidewater.operators.metrics import per_class_by
from tidewater.plans.messages import COLLAPSE, LINKS, LINKS_SQL, LOWERED, MESSAGES_SQL, any_sql, messages, quoted
from tidewater.plans.registry import Registry
from tidewater.session import load

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

#: Parts of source names that mark made data, and endings of the prepared schema's links.
MADE = "synthetic|generated|augmentation|ai_generated|suspicious_v1"
PREPARED_LINK = r"https?://\S+|www\.\S+|[a-z0-9_-]+\.(?:com|org|net|uz|ru|xyz|top|click|online|site|store)(?:[^a-z0-9_]|$)"
RISKS = ("SAFE", "SUSPICIOUS", "DANGEROUS")
RISK_SQL = "['SAFE', 'SUSPICIOUS', 'DANGEROUS'][doc_id % 3 + 1]"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a risk label by id."""
    risk = F.array(*map(F.lit, RISKS))[F.pmod("doc_id", F.lit(3)).cast("int")]
    return load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", risk.alias("label"))


PREPARED_SQL = f"""p AS (SELECT doc_id, {RISK_SQL} AS label, lang AS language, regexp_matches(lower(coalesce(source, '')), '{MADE}') AS is_synthetic,
  length(coalesce(text, ''))::BIGINT AS length, regexp_matches(lower(coalesce(text, '')), '{PREPARED_LINK}') AS has_url,
  regexp_matches(coalesce(text, ''), '[0-9]') AS has_number FROM documents),
  e AS (SELECT *, coalesce(language = 'mixed' OR length < 30 AND label = 'SUSPICIOUS' OR label = 'SAFE' AND has_url
    OR label = 'SUSPICIOUS' AND NOT has_url AND NOT has_number, false) AS edge FROM p)"""


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared schema's flags and whether a row is an edge case."""
    text = F.coalesce("text", F.lit(""))
    rows = labelled(spark, sf_dir).select(
        "doc_id",
        "label",
        F.col("lang").alias("language"),
        F.rlike(F.lower(F.coalesce("source", F.lit(""))), F.lit(MADE)).alias("is_synthetic"),
        F.char_length(text).cast("long").alias("length"),
        F.rlike(F.lower(text), F.lit(PREPARED_LINK)).alias("has_url"),
        F.rlike(text, F.lit("[0-9]")).alias("has_number"),
    )
    edge = F.expr(
        "language = 'mixed' OR (length < 30 AND label = 'SUSPICIOUS') OR (label = 'SAFE' AND has_url) OR (label = 'SUSPICIOUS' AND NOT has_url AND NOT has_number)"
    )
    return rows.withColumn("edge", F.coalesce(edge, F.lit(False)))


@R.add("q_prepared_flags", f"WITH {PREPARED_SQL} SELECT * FROM e")
def prepared_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir)


RANKED = "row_number() OVER (PARTITION BY {0} ORDER BY md5('42-' || doc_id::VARCHAR), doc_id) AS k, count(*) OVER (PARTITION BY {0}) AS n, count(*) OVER () AS total"


@R.add(
    "q_edge_split",
    f"""WITH {PREPARED_SQL}, r AS (SELECT *, {RANKED.format('edge')} FROM e),
      c AS (SELECT *, CASE WHEN n > total * 0.15::DOUBLE THEN floor(total * 0.1::DOUBLE) ELSE n END AS kept FROM r)
      SELECT doc_id, CASE WHEN edge AND k <= kept AND k > floor(kept * 0.2::DOUBLE) THEN 'edge' ELSE 'main' END AS part FROM c""",
)
def edge_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.edge_part(prepared(spark, sf_dir), F.col("edge"), "doc_id").select("doc_id", "part")


@R.add(
    "q_synthetic_cap",
    f"""WITH r AS (SELECT doc_id, lang, lang <> 'en' AS made, {RANKED.format("lang <> 'en'")} FROM documents)
      SELECT doc_id, lang FROM r WHERE made IS NOT TRUE OR n::DOUBLE / total <= 0.3::DOUBLE OR k <= floor((total - n) * {0.3 / (1.0 - 0.3)!r}::DOUBLE)""",
)
def synthetic_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other languages stand for made ones."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return S.limit_share(docs, F.col("lang") != "en", 0.3, "doc_id")


@R.add(
    "q_raise_share",
    f"""WITH r AS (SELECT doc_id, source, coalesce(source = 'src0', false) AS flag, {RANKED.format("coalesce(source = 'src0', false)")} FROM documents)
      SELECT doc_id, source FROM r WHERE flag OR total <= (total - n) / 0.08::DOUBLE OR k <= floor((total - n) / 0.08::DOUBLE * {1.0 - 0.08!r}::DOUBLE)""",
)
def raise_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source stands for the rare class."""
    return S.raise_share(load(spark, sf_dir, "documents").select("doc_id", "source"), F.col("source") == "src0", 0.08, "doc_id")


SAFE_ENGLISH = "coalesce(lang = 'en' AND doc_id % 3 = 0, false)"


@R.add("q_ham_cap", f"WITH r AS (SELECT doc_id, lang, {SAFE_ENGLISH} AS flag, {RANKED.format(SAFE_ENGLISH)} FROM documents) SELECT doc_id, lang FROM r WHERE NOT flag OR k <= 100")
def ham_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return S.limit_flagged(docs, F.expr("lang = 'en' AND doc_id % 3 = 0"), 100, "doc_id")


#: Fixed value: the most safe English rows.
MOST_ENGLISH_HAM = 2_500


@R.add("q_english_ham", f"WITH r AS (SELECT doc_id, lang, {SAFE_ENGLISH} AS flag, {RANKED.format(SAFE_ENGLISH)} FROM documents) SELECT doc_id, lang FROM r WHERE NOT flag OR k <= {MOST_ENGLISH_HAM}")
def english_ham(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return S.limit_flagged(docs, F.expr("lang = 'en' AND doc_id % 3 = 0"), MOST_ENGLISH_HAM, "doc_id")


#: Named patterns of scam and safe messages, and patterns that are ambiguous.
PATTERNS = {
    "CVV/Card Request": "(cvv|karta raqam|card number|номер карт)",
    "Code/OTP Request": "(kod.{0,10}(yubor|ber|ayting|send)|otp|одноразов)",
    "Account Blocked": "(bloklan|block|заблокир|hisobingiz.{0,10}xavf)",
    "Prize/Lottery": "(yutuq|yutib|prize|won|lottery|розыгрыш|aksiya)",
    "Financial Transfer": "(pul.{0,10}(o.tkazish|yubor)|transfer|перевод)",
    "Fake Login/Verify": "(tasdiqlang|verify|confirm|подтверд).{0,15}(link|havola|ссылк|http)",
    "Urgency Pressure": "(shoshilinch|urgent|tezkor|срочн|hoziroq|immediately)",
    "Impersonation": "(bank xodim|bank officer|сотрудник банк|administrat)",
    "Job Scam": "(ish taklif|job offer|работа.{0,10}предлаг|vakansiya)",
    "Investment Scam": "(investitsiya|invest|dividend|крипт|crypto|bitcoin|доход)",
    "URL/Link Pattern": r"(https?://|www\.|\.com/|\.net/|\.uz/|\.click|\.link)",
    "Safe Greeting": "^(salom|hello|hi |hey|privet|привет|assalom)",
    "Safe Daily Chat": "(ko.rishamiz|see you|bugun|today|maroqli|yaxshi)",
}
#: Parts of which each match of the pattern has at least one: texts without them are not searched for it.
NEEDED = {
    "CVV/Card Request": ("cvv", "karta raqam", "card number", "номер карт"),
    "Code/OTP Request": ("kod", "otp", "одноразов"),
    "Account Blocked": ("block", "bloklan", "заблокир", "hisobingiz"),
    "Prize/Lottery": ("yutuq", "yutib", "prize", "won", "lottery", "розыгрыш", "aksiya"),
    "Financial Transfer": ("pul", "transfer", "перевод"),
    "Fake Login/Verify": ("tasdiqlang", "verify", "confirm", "подтверд"),
    "Urgency Pressure": ("shoshilinch", "urgent", "tezkor", "срочн", "hoziroq", "immediately"),
    "Impersonation": ("bank xodim", "bank officer", "сотрудник банк", "administrat"),
    "Job Scam": ("ish taklif", "job offer", "работа", "vakansiya"),
    "Investment Scam": ("invest", "dividend", "крипт", "crypto", "bitcoin", "доход"),
    "URL/Link Pattern": ("http", "www.", ".com/", ".net/", ".uz/", ".click", ".link"),
    "Safe Daily Chat": ("rishamiz", "see you", "bugun", "today", "maroqli", "yaxshi"),
}
AMBIGUOUS = (
    ("(bank|karta|card|hisobingiz|account).{0,30}(xavfsiz|secure|safe|himoya|protect)", "mentions security but could be phishing or legit"),
    ("(tasdiqlang|confirm|verify).{0,20}(kod|code|parol|password)", "verification request - could be real or scam"),
    ("(yutuq|prize|won|bonus|aksiya).{0,30}(tabrik|congrat)", "prize notification - classic scam pattern but could be legit"),
    (r"(click|bosing|tugmani|link|havola|url).{0,30}(http|www|\.com|\.net|\.uz)", "contains link with action verb"),
    ("(urgent|shoshilinch|tezkor|срочн).{0,40}(transfer|o.tkazish|yuborish|перевод)", "urgency + transfer - classic pressure tactic"),
    ("(salom|hello|hi|privet|привет).{0,30}(offer|taklif|предлож)", "greeting + offer - could be spam or friendly"),
    ("(free|bepul|бесплатн).{0,20}(download|yuklab|скачать)", "free download - could be legit or malware"),
)


def matches(low: Column, name: str) -> Column:
    """Whether a text has the pattern; few texts have one of the parts that it needs."""
    found = F.rlike(low, F.lit(PATTERNS[name]))
    return T.contains_any(low, NEEDED[name]) & found if name in NEEDED else found


@R.add(
    "q_pattern_counts",
    f"""WITH {MESSAGES_SQL} """
    + " UNION ALL ".join(
        f"SELECT {quoted(name)} AS pattern, id % 3 AS part, count(*) FILTER (regexp_matches(lower(text), {quoted(p)})) AS n FROM m GROUP BY id % 3" for name, p in PATTERNS.items()
    ),
)
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the texts; three parts by id stand for the languages' data sets."""
    rows = messages(spark, sf_dir).select("id", F.lower("text").alias("low")).groupBy(F.pmod("id", F.lit(3)).alias("part"))
    wide = rows.agg(*(F.count_if(matches(F.col("low"), name)).alias(name) for name in PATTERNS))
    return wide.unpivot("part", list(PATTERNS), "pattern", "n").select("pattern", "part", "n")


@R.add(
    "q_ambiguous",
    f"WITH {MESSAGES_SQL}, a AS ("
    + " UNION ALL ".join(f"SELECT id, {quoted(reason)} AS reason FROM m WHERE regexp_matches(lower(text), {quoted(p)})" for p, reason in AMBIGUOUS)
    + ") SELECT id, reason FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY id) AS k FROM a) WHERE k <= 5",
)
def ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five messages of each ambiguous pattern: a report, small whatever the input."""
    low = F.lower("text")
    found = F.array_compact(F.array(*(F.when(F.rlike(low, F.lit(p)), reason) for p, reason in AMBIGUOUS)))
    rows = messages(spark, sf_dir).select("id", F.explode(found).alias("reason"))
    place = F.row_number().over(Window.partitionBy("reason").orderBy("id"))
    return rows.withColumn("k", place).filter("k <= 5").drop("k")


@R.add("q_short_texts", "SELECT doc_id FROM documents WHERE length(text) BETWEEN 10 AND 40")
def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").filter(F.char_length("text").between(10, 40)).select("doc_id")


@R.add("q_min_length", "SELECT doc_id FROM documents WHERE length(text) >= 3")
def min_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").filter(F.char_length("text") >= 3).select("doc_id")


@R.add("q_regex_filter", rf"WITH {MESSAGES_SQL} SELECT id FROM m WHERE regexp_matches(text, '(?i)\b(account|bank|code)\b')")
def regex_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).filter(F.rlike("text", F.lit(r"(?i)\b(account|bank|code)\b"))).select("id")


@R.add("q_project", "SELECT doc_id AS id, text AS message, lang AS language, 'documents' AS source_dataset FROM documents")
def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("message"), F.col("lang").alias("language"), F.lit("documents").alias("source_dataset"))


KEY_SQL = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@R.add(
    "q_leak_check",
    f"""WITH d AS (SELECT doc_id, {KEY_SQL} AS key FROM documents)
      SELECT doc_id FROM d WHERE doc_id % 10 >= 8 AND key IN (SELECT key FROM d WHERE doc_id % 10 < 8)""",
)
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the test part (by id) whose text the training part has too."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.sha2(T.collapse(F.lower("text")), 256).alias("key"))
    part = F.pmod("doc_id", F.lit(10))
    return docs.filter(part >= 8).join(docs.filter(part < 8).select("key"), "key", "left_semi").select("doc_id")


@R.add("q_conflict_pairs", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@R.add("q_split_dist", f"SELECT {RISK_SQL} AS label, count(*) AS n, avg((lang <> 'en')::INT) AS made_share FROM documents GROUP BY 1")
def split_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).groupBy("label")
    return rows.agg(F.count("*").alias("n"), F.avg((F.col("lang") != "en").cast("int")).alias("made_share"))


@R.add(
    "q_source_samples",
    "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42-' || doc_id::VARCHAR), doc_id) AS k FROM documents) WHERE k <= 5",
)
def source_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows of each source in seeded order: the sampling operator."""
    return S.unranked(S.ranked(load(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id").filter("_place <= 5"))


@R.add("q_mark_read", "SELECT event_id, event_id % 5 = 0 OR event_type = 'click' AS is_read FROM events")
def mark_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one type are marked as read; the others keep their mark."""
    read = F.when(F.col("event_type") == "click", True).otherwise(F.col("event_id") % 5 == 0)
    return load(spark, sf_dir, "events").select("event_id", read.alias("is_read"))


MODELS_SQL = """b AS (SELECT event_type AS model, (floor(value)::BIGINT % 101) AS s, user_id % 101 AS p FROM events),
  l AS (SELECT model, CASE WHEN s >= 70 THEN 'DANGEROUS' WHEN s >= 40 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS label,
    CASE WHEN p >= 70 THEN 'DANGEROUS' WHEN p >= 40 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS predicted FROM b),
  c AS (SELECT model, class, sum(hit) AS hit, sum(actual) AS actual, sum(told) AS told FROM (
    SELECT model, label AS class, (label = predicted)::INT AS hit, 1 AS actual, 0 AS told FROM l UNION ALL SELECT model, predicted, 0, 0, 1 FROM l) GROUP BY 1, 2),
  f AS (SELECT model, avg(2 * hit / (told + actual)) AS macro_f1, max(CASE WHEN class = 'DANGEROUS' AND actual > 0 THEN hit / actual END) AS recall FROM c GROUP BY 1),
  g AS (SELECT model, count(*) FILTER (label = 'SAFE' AND predicted = 'DANGEROUS') AS false_alarms FROM l GROUP BY 1),
  z AS (SELECT model, recall, false_alarms, macro_f1, 100 * coalesce(recall, 0) - 0.1::DOUBLE * false_alarms + 50 * macro_f1 AS score FROM f JOIN g USING (model))"""


def scored_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types stand for models."""
    score = F.floor("value").cast("long") % 101
    rows = load(spark, sf_dir, "events").select(F.col("event_type").alias("model"), T.risk_band(score).alias("label"), T.risk_band(F.col("user_id") % 101).alias("predicted"))
    return per_class_by(rows, "model", "DANGEROUS", "SAFE")


@R.add("q_model_score", f"WITH {MODELS_SQL} SELECT *, row_number() OVER (ORDER BY score DESC, model) = 1 AS chosen FROM z")
def model_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each model, so one task can order them."""
    score = 100 * F.coalesce("recall", F.lit(0.0)) - 0.1 * F.col("false_alarms") + 50 * F.col("macro_f1")
    first = F.row_number().over(Window.orderBy(F.col("score").desc(), "model")) == 1
    return scored_models(spark, sf_dir).withColumn("score", score).withColumn("chosen", first)


@R.add("q_model_choice", f"WITH {MODELS_SQL} SELECT model FROM z ORDER BY recall DESC, false_alarms, model LIMIT 1")
def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_models(spark, sf_dir).orderBy(F.col("recall").desc(), "false_alarms", "model").limit(1).select("model")


PADDED_V8 = LINKS.format(
    "replace(replace(replace(replace(replace(replace(" + LOWERED + ", 'o''', 'o‘'), 'o`', 'o‘'), 'g''', 'g‘'), 'g`', 'g‘'), 'raxmat', 'rahmat'), 'nima ssilka', 'nima havola')"
)
for _word in (*T.EXTENSIONS, ".pdf", *T.TECHNICAL):
    PADDED_V8 = f"replace({PADDED_V8}, '{_word}', ' {_word} ')"


@R.add("q_clean_v8", f"WITH {MESSAGES_SQL} SELECT id, " + COLLAPSE.format(f"regexp_replace(regexp_replace({PADDED_V8}, '!!+', ' multi_excl ', 'g'), '[^{T.WORD}\\s./:]', ' ', 'g')") + " AS out FROM m")
def clean_v8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", T.clean_v8(F.col("text")).alias("out"))


def files_sql() -> str:
    every = X.DANGEROUS_ENDINGS + X.ARCHIVE_ENDINGS + X.DOCUMENT_ENDINGS
    return ", ".join(f"regexp_extract_all(coalesce(text, ''), '(?i){X.FILE_SIGNS}+?\\{e}')" for e in every)


FILES_SQL = f"""{MESSAGES_SQL}, x AS (SELECT id, list_transform(flatten([{files_sql()}]), lambda f: trim(f)) AS all_files FROM m),
  y AS (SELECT id, list_filter(all_files, lambda f, i: list_position(all_files, f) = i) AS files FROM x)"""


@R.add(
    "q_file_names",
    f"""WITH {FILES_SQL} SELECT id, array_to_string(files, '|') AS files, CASE WHEN len(files) = 0 THEN NULL
      WHEN regexp_matches(lower(files[1]), '\\.({'|'.join(e[1:] for e in X.DANGEROUS_ENDINGS)})$') THEN '{X.FILE_KINDS[0]}'
      WHEN regexp_matches(lower(files[1]), '\\.({'|'.join(e[1:] for e in X.ARCHIVE_ENDINGS)})$') THEN '{X.FILE_KINDS[1]}'
      WHEN ends_with(lower(files[1]), '.pdf') THEN '{X.FILE_KINDS[2]}' ELSE '{X.FILE_KINDS[3]}' END AS kind FROM y""",
)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = F.col("files")
    rows = messages(spark, sf_dir).select("id", X.file_names(F.col("text")).alias("files"))
    return rows.select("id", F.array_join(files, "|").alias("files"), X.file_kind(F.get(files, F.lit(0))).alias("kind"))


PHISHING_SQL = f"len(list_filter({LINKS_SQL}, lambda u: {any_sql('lower(u)', X.PHISHING_WORDS)})) > 0"


@R.add("q_phishing_link", f"WITH {MESSAGES_SQL} SELECT id, {PHISHING_SQL} AS out FROM m")
def phishing_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", X.phishing_link(T.extract_links(F.coalesce("text", F.lit("")))).alias("out"))


@R.add(
    "q_confidence",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN s >= 70 THEN 'yuqori' WHEN s >= 40 THEN 'o‘rta' ELSE 'past' END
        WHEN p >= 85 THEN 'yuqori' WHEN p >= 60 THEN 'o‘rta' ELSE 'past' END AS label, CASE WHEN s >= 70 THEN 90 WHEN s >= 40 THEN 60 ELSE 30 END AS number
      FROM (SELECT event_id, floor(value)::BIGINT % 101 AS s, floor((user_id % 101) / 100 * 100)::BIGINT AS p FROM events)""",
)
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows have no model's probability."""
    score = F.floor("value").cast("long") % 101
    best = F.when(F.col("event_id") % 3 != 0, (F.col("user_id") % 101) / 100)
    return load(spark, sf_dir, "events").select("event_id", X.confidence(score, best).alias("label"), X.numeric_confidence(score).alias("number"))
