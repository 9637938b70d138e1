"""A message's way through the rule engine: text, signals, floors, score, level and the texts of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import lexicon, results as X, text as T
from tidewater.functions.fusion import fuse
from tidewater.operators import rules
from tidewater.operators.rules import settled

#: Levels by score, and the result of a message with nothing in it.
SAFE, SUSPICIOUS, DANGEROUS = "XAVFSIZ", "SHUBHALI", "XAVFLI"
EMPTY_ADVICE = "Xabar bo‘sh. Hech qanday xavf aniqlanmadi."


#: The result of an analysis that failed.
FAILED_RISK, FAILED_COLOR, FAILED_CONFIDENCE = 15, "yellow", "o‘rta"
FAILED_REASON, FAILED_ADVICE = "Tahlil vaqtida kutilmagan xatolik yuz berdi", "Xabarni ehtiyotkorlik bilan ko‘rib chiqing."


def level(score: Column) -> Column:
    return F.when(score >= 70, DANGEROUS).when(score >= 40, SUSPICIOUS).otherwise(SAFE)


def evidence(messages: DataFrame) -> DataFrame:
    """`messages` (id, message) with normalized text, intent, links, files, signals and the rule engine's flags.

    Signals are the lexicon's, then those that links and the first file give. A null message is empty.
    """
    original = F.trim(F.coalesce("message", F.lit("")))
    rows = messages.withColumn("text", T.norm_rules(original)).withColumns(
        {"intent": T.intent(F.col("text")), "links": T.extract_links(original), "files": X.file_names(original)}
    )
    rows = settled(rows, "text", "intent", "links", "files")
    file = F.get("files", F.lit(0))
    double = F.coalesce(F.rlike(F.lower(file), F.lit(T.DOUBLE_EXTENSION)), F.lit(False))
    first = F.when(file.isNull(), F.array().cast("array<string>")).otherwise(F.array(file))
    found = rules.match_lexicon(F.col("text"), lexicon.KEYWORDS)
    rows = rows.withColumns(
        {"file": file, "signals": X.added_signals(found, F.col("links"), T.tld_at_host_end(F.col("links")), double, first), "double_extension": double}
    )
    rows = settled(rows, "file", "signals", "double_extension")
    dangerous = F.coalesce(X.ends_with_any(F.lower("file"), X.DANGEROUS_ENDINGS), F.lit(False))
    rows = rows.withColumns(
        {
            "link": F.size("links") > 0,
            "suspicious_tld": T.tld_anywhere(F.col("links")),
            "malicious_file": F.array_contains("signals", "dangerous_file_extension") | dangerous,
            "double_extension": F.col("double_extension") | F.array_contains("signals", "double_extension_trick"),
            "has_file": F.col("file").isNotNull(),
        }
    )
    return settled(rows, "link", "suspicious_tld", "malicious_file", "double_extension", "has_file")


def judged(messages: DataFrame) -> DataFrame:
    """The evidence of `messages` with what the rule engine says of it."""
    return settled(rules.judge(evidence(messages), lexicon.SAFE_PHRASES), "hard_threat", "pattern_keys", "pattern_floor")


def analyze(messages: DataFrame, dangerous: Column | None = None, suspicious: Column | None = None) -> DataFrame:
    """`messages` (id, message) with base_score, hard_threat, pattern_keys, pattern_floor, risk, level, confidence,
    financial_alert, advice, reasons and first_link.

    dangerous and suspicious are a model's probabilities; without them the rules decide alone. A blank
    message without links and files has risk 0, no reasons and advice of its own.
    """
    nothing = F.lit(0.0)
    rows = judged(messages).withColumn("financial_alert", T.contains_any(F.col("text"), lexicon.FINANCIAL_ALERTS))
    rows = rows.withColumn("base_score", rules.base_score(rules.suppress(F.col("signals")), lexicon.WEIGHTS))
    fused = fuse(F.col("base_score"), F.col("pattern_floor"), dangerous if dangerous is not None else nothing, suspicious if suspicious is not None else nothing, F.col("hard_threat"))
    rows = rows.withColumn("risk", rules.apply_safe_override(fused["risk"], F.col("pattern_keys"), F.col("hard_threat")))
    blank = (F.trim(F.coalesce("message", F.lit(""))) == "") & ~F.col("link") & ~F.col("has_file")
    best = F.lit(None).cast("double")
    if dangerous is not None and suspicious is not None:
        best = F.greatest(dangerous, suspicious, F.lit(1.0) - dangerous - suspicious)
    rows = rows.withColumn("risk", F.when(blank, 0).otherwise(F.col("risk"))).withColumn("level", level(F.col("risk")))
    rows = settled(rows, "base_score", "risk", "level", "financial_alert")
    keys = F.concat("signals", "pattern_keys")
    no_tokens = F.array().cast("array<string>")
    told = X.advice(F.col("signals"), F.col("intent"), F.col("has_file"), F.col("link"))
    return rows.withColumns(
        {
            "confidence": F.when(blank, "past").otherwise(X.confidence(F.col("risk"), best)),
            "advice": F.when(blank, F.array(F.lit(EMPTY_ADVICE))).otherwise(told),
            "reasons": F.when(blank, no_tokens).otherwise(X.all_reasons(keys, F.col("level"), no_tokens, F.col("file"))),
            "first_link": F.get("links", F.lit(0)),
        }
    )


def analyze_checked(payloads: DataFrame, dangerous: Column | None = None, suspicious: Column | None = None) -> DataFrame:
    """`analyze` of raw `payloads` (id, payload: bytes), with `failed` and `color`: no row fails the job.

    A payload that isn't UTF-8 can't be read, and probabilities that are missing, no numbers or not within 0 and 1 can't be
    fused: such rows get the result of a failed analysis, others what `analyze` gives. A null payload is an empty message.
    """
    message = F.try_validate_utf8(F.col("payload").cast("string"))
    failed = F.col("payload").isNotNull() & message.isNull()
    told = []
    for p in (dangerous, suspicious):
        good = F.lit(True) if p is None else F.coalesce(~F.isnan(p) & p.between(0.0, 1.0), F.lit(False))
        failed = failed | ~good
        told.append(None if p is None else F.when(good, p).otherwise(F.lit(0.0)))
    rows = analyze(payloads.withColumns({"message": message, "failed": failed}), *told)
    color = F.when(F.col("risk") >= 70, "red").when(F.col("risk") >= 40, "yellow").otherwise("green")
    instead = {
        "risk": F.lit(FAILED_RISK), "level": level(F.lit(FAILED_RISK)), "confidence": F.lit(FAILED_CONFIDENCE), "advice": F.array(F.lit(FAILED_ADVICE)),
        "reasons": F.array(F.lit(FAILED_REASON)), "first_link": F.lit(None).cast("string"), "financial_alert": F.lit(False),
    }
    rows = rows.withColumn("color", F.when(F.col("failed"), FAILED_COLOR).otherwise(color))
    return rows.withColumns({name: F.when(F.col("failed"), value).otherwise(F.col(name)) for name, value in instead.items()})
