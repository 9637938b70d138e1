"""Text normalizers, extraction and flags as column expressions; no Python per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters and words the cleaners know.
CURLY_SINGLE, CURLY_DOUBLE = "‘’", "“”«»"
EXTENSIONS = (".apk", ".exe", ".scr", ".msi", ".bat", ".zip", ".rar")
INVISIBLE = "​‌‍﻿­"
HOMOGLYPHS = ("аоесрху", "aoecpxy")
LINK_TLDS = ("click", "xyz", "top", "gift", "info", "biz", "site", "apk", "online", "shop", "vip")
SHORTENERS = r"t\.me|wa\.me|bit\.ly|tinyurl\.com|rb\.gy|is\.gd"
URL_FLAG = r"http[s]?://|www\.|[a-z0-9_]+\.(com|org|net|uz|ru|xyz|top|click|online|site|store)"
DEVICE_URL_FLAG = URL_FLAG + r"|bit\.ly/|t\.me/|tinyurl\.com/"
DOUBLE_EXTENSION = r"\.[a-z0-9]{2,4}\.(apk|exe|scr|bat|msi|cmd|vbs|ps1)$"
#: Endings of suspicious domains; phrases of each intent, in order of precedence.
SUSPICIOUS_TLDS = (".click", ".xyz", ".top", ".info", ".online", ".site", ".work", ".gift", ".vip", ".shop", ".biz")
INTENTS = {
    "REQUEST": (
        "yuboring", "bering", "ayting", "kiriting", "tasdiqlang", "o'rnating",
        "send the code", "tell me", "enter the code", "confirm your login", "verify your account",
        "kodni yuboring", "kodni ayting", "kodni kiriting", "nomerga yuboring",
        "отправьте код", "введите код", "подтвердите",
    ),
    "WARNING": (
        "bermang", "aytman", "ko'rsatman", "do not share", "never share", "don't give",
        "hech kimga bermang", "xodimlariga ham", "hich kimg berma", "sir saqlang",
        "никому не сообщайте", "не передавайте",
    ),
    "INFO": (
        "kodi:", "kod:", "tasdiqlash kodi", "sms kodi", "parol:", "verification code:",
        "transaksiya", "o'tkazma", "yechildi", "tushum", "balance:", "hisobingizda",
        "kod подтверждения", "транзакция", "списание",
    ),
}
#: A letter, digit or underscore of any script; \w is ASCII in Spark.
WORD = r"\p{L}\p{N}_"


def collapse(text: Column) -> Column:
    """White space runs as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def pad(text: Column, words: tuple[str, ...]) -> Column:
    """Blanks around each literal."""
    return reduce(lambda t, w: F.replace(t, F.lit(w), F.lit(f" {w} ")), words, text)


def spaced_ml(text: Column) -> Column:
    """The first half of clean_ml, which has the same words: what the rest changes are signs and blanks between words."""
    out = F.translate(F.lower(F.coalesce(text, F.lit(""))), "‘’`ʼ", "''''")
    return pad(F.regexp_replace(out, r"(https?://\S+)", r" $1 "), EXTENSIONS)


def clean_ml(text: Column) -> Column:
    """Cleaner of the current model: apostrophes unified, links and extensions set apart, other signs dropped."""
    out = F.regexp_replace(F.regexp_replace(spaced_ml(text), "!!+", " ! "), rf"[^{WORD}\s./:']", " ")
    return collapse(out)


def clean_v1(text: Column) -> Column:
    """First cleaner: links, mail addresses and phone numbers go, then every sign."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"https?://\S+|www\.\S+", "")
    out = F.regexp_replace(out, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "")
    out = F.regexp_replace(out, r"\+?\d[\d\-\s()]{6,}\d", "")
    return collapse(F.regexp_replace(out, rf"[^{WORD}\s]", " "))


def clean_v7(text: Column) -> Column:
    """Cleaner that keeps the signs of links and file names."""
    out = pad(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(https?://\S+)", r" $1 "), EXTENSIONS)
    return collapse(F.regexp_replace(out, rf"[^{WORD}\s./:]", " "))


def norm_dedup(text: Column) -> Column:
    """Key of the per-language de-duplication."""
    out = collapse(F.lower(F.coalesce(text, F.lit(""))))
    return F.translate(out, CURLY_DOUBLE + CURLY_SINGLE + "`", '""""' + "'''")


def norm_foundation(text: Column) -> Column:
    """Key of the global de-duplication: more quotes, backticks stay."""
    out = F.translate(F.lower(F.coalesce(text, F.lit(""))), CURLY_DOUBLE + "„‟" + CURLY_SINGLE, '""""""' + "''")
    return collapse(out)


def norm_audit(text: Column) -> Column:
    """Key of the audits: curly quotes alone."""
    return F.translate(collapse(F.lower(F.coalesce(text, F.lit("")))), "“”‘’", "\"\"''")


def norm_rules(text: Column) -> Column:
    """Form the rules match on: homoglyphs are mapped before lower-casing, and so only lower-case ones."""
    out = F.translate(F.coalesce(text, F.lit("")), INVISIBLE, "")
    out = F.lower(F.translate(out, *HOMOGLYPHS))
    return collapse(F.translate(out, "'`’", "‘‘‘"))


def extract_links(text: Column) -> Column:
    """Links of both passes, distinct, first pass first."""
    first = F.regexp_extract_all(text, F.lit(rf"(?:https?://|www\.|(?:{SHORTENERS})/)[A-Za-z0-9./?=&_%#:~-]*[A-Za-z0-9_/]"), F.lit(0))
    # A name is tried from its start alone, or from where the last link ended: not from each of its letters.
    second = F.regexp_extract_all(text, F.lit(rf"(?:\G|(?<![A-Za-z0-9_-]))[A-Za-z0-9_-]++\.(?:{'|'.join(LINK_TLDS)})(?:[^A-Za-z0-9_]|$)"), F.lit(0))
    return F.array_distinct(F.concat(first, F.transform(second, lambda s: F.regexp_replace(s, r"[^A-Za-z0-9_]$", ""))))


def label_by_name(label: Column) -> Column:
    """Unified label of a label's name; null for unknown names, whose rows the loaders drop."""
    name = F.lower(F.trim(label))
    return (
        F.when(name.isin("ham", "safe"), "SAFE").when(name.isin("spam", "suspicious"), "SUSPICIOUS").when(name.isin("scam", "dangerous"), "DANGEROUS")
    )


def label_by_part(label: Column) -> Column:
    """Unified label by parts of the name; dangerous ones first, SUSPICIOUS otherwise."""
    name = F.lower(label)
    has = lambda *parts: reduce(Column.__or__, (F.contains(name, F.lit(p)) for p in parts))
    return (
        F.when(label.isNull(), "SUSPICIOUS")
        .when(has("phishing", "fraud", "scam", "malware", "dangerous"), "DANGEROUS")
        .when(has("ham", "legit", "normal", "safe"), "SAFE")
        .otherwise("SUSPICIOUS")
    )


def risk_band(score: Column, suspicious: float = 40, dangerous: float = 70) -> Column:
    """Band of a score; older models used 30/60."""
    return F.when(score >= dangerous, "DANGEROUS").when(score >= suspicious, "SUSPICIOUS").otherwise("SAFE")


def script_language(text: Column) -> Column:
    """Language by the share of Cyrillic letters, Uzbek signs first."""
    def told(t: Column) -> Column:
        # What is left without the other signs: a match a run of these, not one a letter.
        cyrillic = F.char_length(F.regexp_replace(t, "[^А-Яа-яЁёЎўҚқҒғҲҳ]+", ""))
        latin = F.char_length(F.regexp_replace(t, "[^A-Za-z]+", ""))
        return F.struct(t.alias("text"), cyrillic.alias("cyrillic"), latin.alias("latin"))

    def judged(row: Column) -> Column:
        text, cyrillic, latin = row["text"], row["cyrillic"], row["latin"]
        total = cyrillic + latin
        return (
            F.when(F.trim(text) == "", "unknown")
            .when(total == 0, "unknown")
            .when(cyrillic / total >= 0.7, F.when(F.rlike(text, F.lit("[ЎўҚқҒғҲҳ]")), "uz").otherwise("ru"))
            .when(latin / total >= 0.7, F.when(F.rlike(F.lower(text), F.lit("o['‘ʻ]|g['‘ʻ]")), "uz").otherwise("en"))
            .otherwise("mixed")
        )

    # Letters are counted once; each branch would count them again.
    return F.get(F.transform(F.array(told(text)), judged), F.lit(0))


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether the text contains one of the phrases; null text does not."""
    return F.coalesce(reduce(Column.__or__, (F.contains(text, F.lit(p)) for p in phrases)), F.lit(False))


def intent(normalized: Column) -> Column:
    """First intent with a phrase in the text: REQUEST, WARNING, INFO, else UNKNOWN."""
    first = reduce(lambda case, name: case.when(contains_any(normalized, INTENTS[name]), name), list(INTENTS)[1:], F.when(contains_any(normalized, INTENTS["REQUEST"]), "REQUEST"))
    return first.otherwise("UNKNOWN")


def tld_at_host_end(links: Column) -> Column:
    """Whether a link ends with a suspicious domain ending, or has one before a slash."""
    return F.exists(links, lambda u: reduce(Column.__or__, (F.endswith(F.lower(u), F.lit(t)) | F.contains(F.lower(u), F.lit(t + "/")) for t in SUSPICIOUS_TLDS)))


def tld_anywhere(links: Column) -> Column:
    """Whether a suspicious domain ending stands anywhere in a link: the pattern rules' laxer test."""
    return F.exists(links, lambda u: contains_any(F.lower(u), SUSPICIOUS_TLDS))


#: Words that the eighth cleaner sets apart, even inside words.
TECHNICAL = ("login", "parol", "password", "karta", "card", "cvv", "kod", "code", "otp")


def clean_v8(text: Column) -> Column:
    """Cleaner that unifies Uzbek apostrophes and sets links, endings and technical words apart."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for old, new in (("o'", "o‘"), ("o`", "o‘"), ("g'", "g‘"), ("g`", "g‘"), ("raxmat", "rahmat"), ("nima ssilka", "nima havola")):
        out = F.replace(out, F.lit(old), F.lit(new))
    out = pad(F.regexp_replace(out, r"(https?://\S+)", r" $1 "), (*EXTENSIONS, ".pdf"))
    out = F.regexp_replace(pad(out, TECHNICAL), "!!+", " multi_excl ")
    return collapse(F.regexp_replace(out, rf"[^{WORD}\s./:]", " "))
