"""Files, links and parts of chat posts; signals added by evidence; confidence, advice and reasons of a result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.text import collapse, contains_any

#: File endings and their names, words of phishing links, patterns of chat posts.
DANGEROUS_ENDINGS = (".apk", ".exe", ".scr", ".bat", ".msi", ".cmd", ".vbs", ".ps1", ".js", ".jar", ".hta")
ARCHIVE_ENDINGS = (".zip", ".rar", ".7z", ".tar")
DOCUMENT_ENDINGS = (".pdf", ".doc", ".docx")
FILE_KINDS = ("Xavfli dastur fayli", "Arxiv fayli", "PDF hujjat", "Hujjat fayli")
FILE_SIGNS = r"[A-Za-z0-9_\-.() ]"
PHISHING_WORDS = ("login", "verify", "secure", "update", "account", "bank-login", "card-update", "claim")
CHAT_LINK = r"(?i)\b(?:(?:https?://|www\.)\S+|bit\.ly/\S+)\b"
CHAT_FILE = r"(?i)\b[\w\s\-\(\)\[\]\.]+\.(?:apk|zip|rar|7z|exe|pdf|docx?|xlsx?|pptx?)\b"
CHAT_KINDS = (
    (".apk", "APK dastur fayli"), (".zip", "Arxiv fayli"), (".rar", "RAR arxiv fayli"), (".7z", "7Z arxiv fayli"),
    (".exe", "EXE dastur fayli"), (".pdf", "PDF hujjat"),
)
BURST_MS = 1500


def ends_with_any(name: Column, endings: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (F.endswith(name, F.lit(e)) for e in endings))


def file_names(text: Column) -> Column:
    """Names of files in a text, distinct, by the order of endings, then of the text; `.doc` also is found in `.docx`.

    Runs of the signs that names consist of are cut out first, each up to the last ending in it: so no sign is looked at more
    often than there are endings.
    """
    endings = DANGEROUS_ENDINGS + ARCHIVE_ENDINGS + DOCUMENT_ENDINGS
    text = F.coalesce(text, F.lit(""))
    ending_of_any = F.lit(r"(?i)\.(?:" + "|".join(e[1:] for e in endings) + ")")
    runs = F.filter(F.regexp_extract_all(text, F.lit(f"{FILE_SIGNS}+"), F.lit(0)), lambda r: F.rlike(r, ending_of_any))

    def of(ending: str, runs: Column) -> Column:
        pattern = ending.replace(".", r"\.")
        some = F.filter(runs, lambda r: F.contains(F.lower(r), F.lit(ending)))
        cut = F.transform(some, lambda r: F.regexp_extract(r, rf"(?i)^.*{pattern}", 0))
        return F.flatten(F.transform(cut, lambda r: F.regexp_extract_all(r, F.lit(rf"(?i){FILE_SIGNS}+?{pattern}"), F.lit(0))))

    # The runs are cut out once a text, and of no text without an ending; as a plain expression they would be for each ending.
    named = F.get(F.transform(F.array(runs), lambda rs: F.concat(*(of(e, rs) for e in endings))), F.lit(0))
    found = F.when(F.rlike(text, ending_of_any), named).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(found, lambda f: F.trim(f)))


def file_kind(name: Column) -> Column:
    """Kind of a file by the end of its name."""
    low = F.lower(name)
    program, archive, pdf, other = FILE_KINDS
    return (
        F.when(name.isNull(), None)
        .when(ends_with_any(low, DANGEROUS_ENDINGS), program)
        .when(ends_with_any(low, ARCHIVE_ENDINGS), archive)
        .when(F.endswith(low, F.lit(".pdf")), pdf)
        .otherwise(other)
    )


def phishing_link(links: Column) -> Column:
    """Whether a link contains a word of phishing links."""
    return F.exists(links, lambda u: contains_any(F.lower(u), PHISHING_WORDS))


def norm_parts(parts: Column) -> Column:
    """Parts of a post with white space collapsed, without blank and repeated ones."""
    return F.array_distinct(F.filter(F.transform(parts, lambda p: collapse(F.coalesce(p, F.lit("")))), lambda p: p != ""))


def chat_links(parts: Column) -> Column:
    """Links of a post's parts, distinct, in order."""
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(CHAT_LINK), F.lit(0)))))


def chat_file(parts: Column) -> Column:
    """First file name of a post's parts; null if there is none."""
    found = F.filter(F.transform(parts, lambda p: F.trim(F.regexp_extract(p, CHAT_FILE, 0))), lambda f: f != "")
    return F.get(found, F.lit(0))


def chat_file_kind(name: Column) -> Column:
    """Kind of a chat post's file; null for other endings."""
    low = F.lower(F.trim(name))
    return reduce(lambda c, kind: c.when(F.endswith(low, F.lit(kind[0])), kind[1]), CHAT_KINDS[1:], F.when(F.endswith(low, F.lit(CHAT_KINDS[0][0])), CHAT_KINDS[0][1]))


def latest_burst(posts: Column) -> Column:
    """Of structs (text, ms) those within 1.5 s of the last one; blank texts go first."""
    told = F.filter(posts, lambda p: F.coalesce(F.trim(p["text"]), F.lit("")) != "")
    last = F.array_max(F.transform(told, lambda p: p["ms"]))
    return F.filter(told, lambda p: p["ms"] >= last - BURST_MS)


def without_sender(text: Column, sender: Column) -> Column:
    """Text without the sender's name before it, the attachment sign and the word for file."""
    out = text
    for mark in (": ", " - "):
        head = F.concat(F.coalesce(sender, F.lit("")), F.lit(mark))
        named = (F.coalesce(F.trim(sender), F.lit("")) != "") & F.startswith(out, head)
        out = F.when(named, F.substr(out, F.length(head) + 1)).otherwise(out)
    return F.trim(F.regexp_replace(F.regexp_replace(out, "^📎", ""), "^Файл", ""))


def added_signals(signals: Column, links: Column, tld: Column, double_extension: Column, files: Column) -> Column:
    """Signals of the lexicon with those that links and files give, each once, in their order."""
    extra = F.array_compact(
        F.array(
            F.when(F.size(links) > 0, "suspicious_link"),
            F.when(tld, "suspicious_tld_match"),
            F.when(phishing_link(links), "phishing_login"),
            F.when(double_extension, "double_extension_trick"),
            F.when(F.exists(files, lambda f: ends_with_any(F.lower(f), DANGEROUS_ENDINGS)), "dangerous_file_extension"),
        )
    )
    return F.array_union(signals, extra)


def confidence(score: Column, best: Column) -> Column:
    """Label of confidence by the best class's probability (null: no model, then by the score)."""
    percent = F.floor(best * 100)
    by_model = F.when(percent >= 85, "yuqori").when(percent >= 60, "o‘rta").otherwise("past")
    return F.when(best.isNotNull(), by_model).otherwise(F.when(score >= 70, "yuqori").when(score >= 40, "o‘rta").otherwise("past"))


def numeric_confidence(score: Column) -> Column:
    return F.when(score >= 70, 90).when(score >= 40, 60).otherwise(30)


#: Texts of the advice, of the reasons, and the group of each signal and rule.
ADVICE_FILE = ("Bu faylni ochmang yoki o‘rnatmang", "Noma'lum fayllar qurilmangizni buzishi mumkin")
ADVICE_LINK = ("Havolani bosishdan oldin manzilini tekshiring", "Hech qachon noma'lum saytga login yoki parolingizni kiritmang")
ADVICE_PRIZE = ("Tanish odam nomidan kelgan bo'lsa ham, bunday yutuqlarga ishonmang",)
ADVICE_CODE = ("Hech qachon SMS kodingizni yoki karta ma'lumotlarini begonaga aytmang",)
ADVICE_DATA = ("Bank karta ma'lumotlarini yoki SMS kodni hech kimga aytmang",)
ADVICE_NONE = "Xabarni ehtiyotkorlik bilan ko‘rib chiqing"
VERDICTS = {
    "XAVFLI": "Xabar firibgarlik ekanligi aniq. Havolani ochmang, faylni yuklamang!",
    "SHUBHALI": "Xabar shubhali ko‘rinmoqda. Manba va ma'lumotlarni qayta tekshiring.",
    "XAVFSIZ": "Xabar xavfsiz ko‘rinadi.",
}
GROUPS = {
    "DOWNLOAD": (
        "download_intent", "dangerous_file_extension", "archive_payload", "double_extension_trick", "malware_delivery", "hidden_malware",
        "intent_download_malware",
    ),
    "FINANCIAL": (
        "payment_intent", "card_phishing_bait", "financial_data_request", "intent_link_payment", "intent_payment_urgency", "request_card_scam",
    ),
    "ACCOUNT": (
        "login_intent", "phishing_login", "phishing_auth_bait", "otp_request", "account_update_pressure", "personal_info_request",
        "intent_link_login", "intent_urgent_account_threat", "intent_submit_scam", "account_update_phishing", "account_update_login_scam",
        "request_otp_danger",
    ),
    "ACTION": ("click_intent", "suspicious_link", "suspicious_tld_match", "intent_bait_click", "request_link_phishing"),
    "PRESSURE": ("urgency_intent", "fear_threat", "urgency_pressure", "account_update_pressure_high"),
    "BAIT": ("prize_bait", "curiosity_lure", "promo_pressure", "promo_link_suspicious", "scam_promo", "phishing_giveaway"),
}
LINK_KEYS = ("suspicious_link", "intent_link_login", "intent_link_payment", "phishing_login")
SECOND = {
    "FINANCIAL": "moliyaviy ma’lumotlarni olishga ",
    "ACCOUNT": "profilni boshqarishga ",
    "ACTION": "shubhali havolaga o'tishga ",
    "PRESSURE": "shoshilinch qaror qabul qildirishga ",
    "BAIT": "sizni qiziqtirishga ",
}
SAFE_REASON = "Xabar xavfsiz ko‘rinadi. Xavfli belgilar aniqlanmadi."
VAGUE_REASON = "Xabarda shubhali elementlar aniqlandi."
WARNINGS = {"XAVFLI": "Bu aniq firibgarlik harakati bo‘lishi mumkin, ehtiyot bo‘ling.", "SHUBHALI": "Ehtiyot bo‘lish tavsiya etiladi."}


def contains_one(keys: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(keys, F.array(*map(F.lit, names)))


def advice(signals: Column, intent: Column, has_file: Column, has_links: Column) -> Column:
    """The first three pieces of advice, in order of the evidence."""
    asks = F.coalesce(intent == "REQUEST", F.lit(False))
    parts = (
        (has_file | contains_one(signals, ("dangerous_file_extension",)), ADVICE_FILE),
        (has_links | contains_one(signals, ("suspicious_link", "suspicious_tld_match")), ADVICE_LINK),
        (contains_one(signals, ("phishing_auth_bait", "prize_bait")), ADVICE_PRIZE),
        (asks & contains_one(signals, ("otp_request", "financial_data_request")), ADVICE_CODE),
        (contains_one(signals, ("personal_info_request", "financial_data_request", "otp_request")), ADVICE_DATA),
    )
    found = F.array_compact(F.array(*(F.when(when, text) for when, texts in parts for text in texts)))
    return F.when(F.size(found) == 0, F.array(F.lit(ADVICE_NONE))).otherwise(F.slice(found, 1, 3))


def verdict(level: Column) -> Column:
    """The one sentence of a level; that of the safe level for others."""
    return F.when(level == "XAVFLI", VERDICTS["XAVFLI"]).when(level == "SHUBHALI", VERDICTS["SHUBHALI"]).otherwise(VERDICTS["XAVFSIZ"])


def reasons(keys: Column, level: Column) -> Column:
    """Sentences that explain a result: the first two groups that the signals and rules belong to, and a warning by level."""
    groups = F.array_compact(F.array(*(F.when(contains_one(keys, names), group) for group, names in GROUPS.items())))
    first, second = F.get(groups, F.lit(0)), F.get(groups, F.lit(1))
    has = lambda *names: contains_one(keys, names)
    link = lambda text: F.when(contains_one(keys, LINK_KEYS), text).otherwise("")
    pick = lambda when, yes, no: F.when(when, yes).otherwise(no)
    money = pick(has("card_phishing_bait", "payment_intent"), "to‘lov qilishga yoki karta ma’lumotlarini kiritishga ", "shubhali moliyaviy amallarni bajarishga ")
    account = pick(
        has("phishing_login", "otp_request"),
        "shaxsiy akkauntingizni egallashga yoki hisobni tasdiqlashga ",
        "akkaunt ma’lumotlarini yangilash niqobi ostida manipulyatsiyaga ",
    )
    main = (
        F.when(first == "DOWNLOAD", "zararli APK ilova yoki faylni yuklab olishga ")
        .when(first == "FINANCIAL", F.concat(link("shubhali havola orqali "), money))
        .when(first == "ACCOUNT", F.concat(link("shubhali havola yordamida "), account))
        .when(first == "ACTION", F.concat(link("shubhali havolani ochishga va "), F.lit("noaniq harakatlarni bajarishga ")))
        .when(first == "PRESSURE", "ruhiy bosim o‘tkazish va shoshiltirish orqali chalg‘itishga ")
        .otherwise("turli sovg‘alar yoki qiziqarli va’dalar bilan sizni jalb qilishga ")
    )
    also = F.create_map(*(F.lit(x) for item in SECOND.items() for x in item))[second]
    tail = F.when(second.isNotNull(), F.concat(F.lit("va "), also)).otherwise("")
    sentence = F.concat(F.lit("Xabar "), main, tail, F.lit("urinmoqda."))
    warning = F.when(level == "XAVFLI", WARNINGS["XAVFLI"]).when(level == "SHUBHALI", WARNINGS["SHUBHALI"])
    return (
        F.when(level == "XAVFSIZ", F.array(F.lit(SAFE_REASON)))
        .when(F.size(groups) == 0, F.array(F.lit(VAGUE_REASON)))
        .otherwise(F.array_compact(F.array(sentence, warning)))
    )


def all_reasons(keys: Column, level: Column, tokens: Column, file: Column) -> Column:
    """The reasons, two suspicious words for dangerous messages, and the file's name."""
    words = F.when((level == "XAVFLI") & (F.size(tokens) > 0), F.concat(F.lit("Shubhali so'zlar: "), F.array_join(F.slice(tokens, 1, 2), ", ")))
    return F.concat(reasons(keys, level), F.array_compact(F.array(words, F.concat(F.lit("Fayl nomi: "), file))))
