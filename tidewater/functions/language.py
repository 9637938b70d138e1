"""Language detectors by script, marker words and token sets; hints against detection; labels and tags by keywords."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import WORD, contains_any

#: Letters and words that mark a language, for each detector.
CYRILLIC, LATIN = "[Ѐ-ӿ]", "[a-zA-Z]"
UZBEK_CYRILLIC = "ўғқҳ"
UZBEK_APOSTROPHES = ("oʻ", "gʻ", "o'", "g'", "o‘", "g‘")
UZBEK_MARKERS = (
    "sh", "ch", "ng", "siz", "sizning", "salom", "rahmat", "kerak", "bormi", "bilan", "qiling", "kiriting", "kartangiz", "hisobingiz",
    "tasdiqlang", "havolani", "xabar", "xavfsizlik", "yuborish", "yuboring", "tizimga", "parol", "shaxsiy", "ma'lumot", "malumot", "tugmani",
    "bosing", "olish", "uchun", "orqali", "kodni", "tasdiqlash", "bank", "hisob", "kredit", "transaksiya", "shubhali", "bloklandi",
    "karta", "balans", "murojaat", "telefon", "raqamingiz", "to.lov", "pul", "so.m",
)
RUSSIAN_MARKERS = (
    "ваш", "вашего", "внимание", "счет", "карта", "банк", "безопасност", "срочно", "перевод", "подтвердите", "ссылк", "сообщени", "номер",
    "оплат", "акаунт", "заблокирован", "пароль", "код", "вход", "пожалуйста", "здравствуйте", "добрый", "день", "спасибо", "привет",
    "нажмите", "перейдите", "уведомлени", "вы", "не", "на", "и", "в", "от", "с", "по", "это", "как", "был", "быть", "если",
)
UZBEK_WORDS = (
    "salom", "rahmat", "kerak", "uchun", "bilan", "haqida", "bo'ldi", "qilish", "qiling", "qilib", "bosing", "kirish", "chiqish",
    "parol", "karta", "hisobingiz", "kartangiz", "telefon", "xabar", "yuborish", "olish", "berish", "ko'rish",
    "iltimos", "marhamat", "hurmatli", "assalomu", "alaykum", "sizning", "sizga", "siz", "men", "biz", "ular",
    "va", "ham", "yoki", "lekin", "chunki", "shu", "bir", "bu", "u", "har", "hamma", "barcha",
    "yo'q", "bor", "emas", "ekan", "edi", "bo'lsa", "qanday", "nima", "kim", "qaerda", "qachon",
    "tiklash", "bloklandi", "tasdiqlash", "kod", "kodi", "buyurtma", "to'lov", "pullik", "pul", "so'm", "summa",
    "mijoz", "foydalanuvchi", "xizmat", "dastur", "ma'lumot", "shaxsiy", "maxfiy", "xavfsiz", "orqali", "tekshirish", "yutuq", "sovg'a",
    "ishlamayapti", "ishlamoqda", "ishlaydi", "boraman", "kelaman", "ketaman", "turaman", "bugun", "ertaga", "kecha", "hozir",
    "aka", "opa", "uka", "singil", "do'stim", "yaxshi", "yomon", "katta", "kichik", "maktab", "universitet", "ish", "uy",
    "qalay", "qalaysan", "qalaysiz", "kechirasiz", "uzr",
    "салом", "рахмат", "керак", "учун", "билан", "ҳақида", "бўлди", "қилиш", "босинг", "кириш", "хабар", "юбориш", "олиш", "бериш",
    "илтимос", "марҳамат", "ҳурматли", "сизнинг", "сизга", "сиз", "мен", "биз", "ва", "ҳам", "ёки", "лекин", "чунки",
    "бир", "бу", "ҳар", "ҳамма", "барча", "йўқ", "бор", "эмас", "экан", "эди", "қандай", "нима", "ким", "қаерда", "қачон",
)
RUSSIAN_WORDS = (
    "и", "в", "на", "не", "что", "это", "он", "она", "они", "был", "была", "были", "быть", "для", "как", "так",
    "все", "вы", "мы", "его", "ее", "их", "от", "до", "но", "по", "из", "за", "то", "да", "нет",
    "можно", "нужно", "только", "уже", "еще", "тоже", "если", "когда", "где", "кто", "чем", "или",
    "бы", "же", "ли", "вот", "тут", "там", "свой", "этот", "тот", "один", "два", "три",
    "очень", "потом", "сейчас", "здесь", "сюда", "деньги", "рублей", "рубль", "перевод", "счет", "банк",
    "срочно", "требуется", "прибыль", "удалённая", "работа", "привет", "здравствуйте", "спасибо", "пожалуйста",
)
ENGLISH_WORDS = (
    "the", "is", "are", "was", "were", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should",
    "can", "may", "might", "shall", "must", "a", "an", "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they",
    "my", "your", "his", "her", "its", "our", "their", "am", "be", "been", "being", "not", "no", "yes", "ok",
    "at", "by", "for", "from", "in", "of", "on", "to", "with", "and", "but", "or", "if", "so", "as", "than",
    "just", "also", "very", "too", "only", "now", "here", "there", "where", "when", "how", "what", "who",
    "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "then", "well",
    "free", "win", "call", "text", "send", "reply", "claim", "prize", "cash", "offer", "click",
    "please", "dear", "hi", "hello", "thanks", "thank", "sorry", "good", "great", "nice", "love", "like", "want", "need",
    "get", "got", "go", "going", "come", "coming", "know", "think", "see", "look", "find", "give", "tell",
    "try", "ask", "work", "seem", "feel", "leave",
)
ENGLISH_FEW = (
    "the", "is", "are", "was", "have", "has", "do", "does", "a", "an", "this", "that", "i", "you", "he", "she",
    "not", "and", "but", "or", "if", "for", "from", "to", "with",
)
SHARE_MARKERS = ("siz", "pul", "hisob", "kod", "yuboring")
AUDIT_UZBEK = (
    "va", "bilan", "uchun", "bu", "yoki", "siz", "biz", "ga", "yil", "haqida", "qilish", "o'", "g'", "o‘", "g‘", "ning", "karta", "tasdiqlash",
    "kod", "parol", "qabul", "chiqish", "shaxsiy", "ma'lumot", "iltimos", "yuboring", "yutuq", "bloklandi",
)
AUDIT_ENGLISH = (
    "the", "is", "in", "and", "to", "of", "a", "that", "i", "it", "for", "on", "with", "as", "you", "are", "be", "this", "your",
    "account", "verify", "click", "link", "free", "win", "prize", "urgent", "alert", "security",
)
KEYWORD_UZBEK = (
    "kodi", "bermang", "yuboring", "ayting", "kiriting", "tasdiqlash", "so'm", "yechildi", "tushum", "olindi", "uchrashamiz", "boraman",
    "yutuq", "sovrin", "bonus", "darhol", "shoshiling", "akkaunt", "bloklandi",
)
LETTER_UZBEK = ("boladi", "uchun", "bilan", "nima", "qanaqa", "yaxshi", "bolsa", "o'", "g'", "o‘", "g‘", "o`", "g`", "sh", "ch", "ng")
TOKEN = "[a-zA-ZЀ-ӿ'`‘’ʻʼ]+"
LANGUAGE_NAMES = {
    "uz": "uz", "uzb": "uz", "uzbek": "uz", "en": "en", "eng": "en", "english": "en",
    "ru": "ru", "rus": "ru", "russian": "ru", "mixed": "mixed",
}


def whole(words: Sequence[str]) -> str:
    """Pattern of a whole word out of several; letters and digits of any script make words."""
    return rf"(?:^|[^{WORD}])(?:{'|'.join(words)})(?:[^{WORD}]|$)"


def blank(text: Column) -> Column:
    """Null, empty or white space alone."""
    return ~F.coalesce(F.rlike(text, F.lit(r"\S")), F.lit(False))


def shares(df: DataFrame, text: str) -> DataFrame:
    """`df` with _cyr, _lat (letters), _low (lower-case text)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"_cyr": F.regexp_count(t, F.lit(CYRILLIC)), "_lat": F.regexp_count(t, F.lit(LATIN)), "_low": F.lower(t)})


def pair(*values: str) -> Column:
    return F.array(*map(F.lit, values))


def finish(df: DataFrame, result: Column, names: Sequence[str]) -> DataFrame:
    """`df` with the members of the array `result` as columns, working columns gone."""
    done = df.withColumn("_result", result)
    done = done.withColumns({name: done["_result"][i] for i, name in enumerate(names)})
    return done.drop(*(c for c in done.columns if c in ("_cyr", "_lat", "_low", "_tokens", "_uz", "_ru", "_en", "_few", "_points", "_result")))


def by_markers(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with language, method and share: the script of 70% of the letters decides, marker words tell Uzbek from the rest.

    Texts without letters are English by default; where no script has 70%, that with more letters counts, Latin of equals.
    """
    rows = shares(df, text)
    cyr, lat, low = F.col("_cyr"), F.col("_lat"), F.col("_low")
    total = cyr + lat
    uz_letters = F.rlike(low, F.lit(f"[{UZBEK_CYRILLIC}]"))
    uz_words = F.rlike(low, F.lit(f"{'|'.join(UZBEK_APOSTROPHES)}|{whole(UZBEK_MARKERS)}"))
    result = (
        F.when(blank(F.col(text)), pair("en", "empty_default"))
        .when(total == 0, pair("en", "no_alpha_default"))
        .when(
            cyr / total >= 0.7,
            F.when(uz_letters, pair("uz", "cyrillic_uz_chars"))
            .when(F.rlike(low, F.lit(whole(RUSSIAN_MARKERS))), pair("ru", "cyrillic_ru_words"))
            .otherwise(pair("ru", "cyrillic_default")),
        )
        .when(lat / total >= 0.7, F.when(uz_words, pair("uz", "latin_uz_markers")).otherwise(pair("en", "latin_default")))
        .when(cyr > lat, F.when(uz_letters, pair("uz", "mixed_uz_cyrillic")).otherwise(pair("ru", "mixed_cyrillic_dominant")))
        .otherwise(F.when(uz_words, pair("uz", "mixed_uz_latin")).otherwise(pair("en", "mixed_latin_dominant")))
    )
    share = F.when(total == 0, 1.0).otherwise(F.greatest(cyr, lat) / total)
    return finish(rows.withColumn("share", share), result, ("language", "method"))


def by_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with language, confidence and method: distinct tokens against word sets, within the script of 70% of the letters."""
    rows = shares(df, text).withColumn("_tokens", F.regexp_extract_all("_low", F.lit(TOKEN), F.lit(0)))
    known = lambda words: F.size(F.array_intersect("_tokens", F.array(*map(F.lit, dict.fromkeys(words)))))
    rows = rows.withColumns({"_uz": known(UZBEK_WORDS), "_ru": known(RUSSIAN_WORDS), "_en": known(ENGLISH_WORDS), "_few": known(ENGLISH_FEW)})
    low, n = F.col("_low"), F.size("_tokens")
    points = (
        F.when(contains_any(low, ("o'", "g'", "o`", "g`")), 3).otherwise(0)
        + F.when(contains_any(low, ("oʻ", "gʻ")), 3).otherwise(0)
        + F.col("_uz") * 2
        + F.when(contains_any(low, ("sh",)), 0.5).otherwise(0.0)
        + F.when(contains_any(low, ("ch",)), 0.5).otherwise(0.0)
    )
    rows = rows.withColumn("_points", points)
    cyr, lat, uz, ru, en, few, points = (F.col(c) for c in ("_cyr", "_lat", "_uz", "_ru", "_en", "_few", "_points"))
    total = cyr + lat
    letters = F.rlike(F.coalesce(F.col(text), F.lit("")), F.lit(f"[{UZBEK_CYRILLIC}]"))
    result = (
        F.when(blank(F.col(text)), pair("en", "low", "empty_text"))
        .when(n == 0, pair("en", "low", "no_tokens"))
        .when(total == 0, pair("en", "low", "no_alpha_chars"))
        .when(
            cyr / total >= 0.7,
            F.when(letters & (uz > ru), pair("uz", "high", "cyrillic_uz_chars_and_words"))
            .when(letters & (uz > 0), pair("uz", "medium", "cyrillic_uz_chars"))
            .when(ru > 0, pair("ru", "high", "cyrillic_ru_words"))
            .otherwise(pair("ru", "medium", "cyrillic_default")),
        )
        .when(
            lat / total >= 0.7,
            F.when((points >= 3) & (uz > en), pair("uz", "high", "latin_uz_markers_and_words"))
            .when(points >= 2, pair("uz", "medium", "latin_uz_markers"))
            .when(en >= 2, pair("en", "high", "latin_en_words"))
            .when(en >= 1, pair("en", "medium", "latin_en_default"))
            .otherwise(pair("en", "low", "latin_default")),
        )
        .when((uz == 0) & (ru == 0) & (few == 0), F.when(cyr > lat, pair("ru", "low", "mixed_cyrillic_dominant")).otherwise(pair("en", "low", "mixed_latin_dominant")))
        .when((uz >= ru) & (uz >= few), pair("uz", "low", "mixed_script_uz_words"))
        .when(ru >= few, pair("ru", "low", "mixed_script_ru_words"))
        .otherwise(pair("en", "low", "mixed_script_en_words"))
    )
    return finish(rows, result, ("language", "confidence", "method"))


def by_share(text: Column) -> Column:
    """Language by the script with more letters (Latin of equals) and five Uzbek words or letters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    cyr, lat = (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(letters)) for letters in (CYRILLIC, LATIN))
    uz = F.rlike(low, F.lit(f"[{UZBEK_CYRILLIC}]|{whole(SHARE_MARKERS)}"))
    return F.when(cyr + lat == 0, "en").when(uz, "uz").when(cyr > lat, "ru").otherwise("en")


def by_audit(text: Column) -> Column:
    """Russian from 40% of Cyrillic letters on, else the language with more keywords, Uzbek by apostrophes, else mixed; blank is unknown."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(f"[{WORD}]+"), F.lit(0))
    uz, en = (F.size(F.array_intersect(words, F.array(*map(F.lit, known)))) for known in (AUDIT_UZBEK, AUDIT_ENGLISH))
    signs = F.regexp_count(low, F.lit(r"[\p{L}\p{N}]"))
    return (
        F.when(blank(text), "unknown")
        .when((signs > 0) & (F.regexp_count(low, F.lit("[а-яё]")) / signs > 0.4), "ru")
        .when(uz > en, "uz")
        .when(en > uz, "en")
        .when(F.rlike(text, F.lit("['‘’]")), "uz")
        .otherwise("mixed")
    )


def by_keywords(text: Column) -> Column:
    """Uzbek by keywords anywhere, else Russian by a Cyrillic letter, else English."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(contains_any(low, KEYWORD_UZBEK), "uz").when(F.rlike(low, F.lit("[а-яё]")), "ru").otherwise("en")


def by_letters(text: Column) -> Column:
    """One of seven classes by the scripts that occur and letters of one language alone."""
    low = F.lower(F.coalesce(text, F.lit("")))
    cyrillic, latin = F.rlike(low, F.lit("[а-яё]")), F.rlike(low, F.lit("[a-z]"))
    return (
        F.when(cyrillic & latin, "Mixed")
        .when(cyrillic & F.rlike(low, F.lit(f"[{UZBEK_CYRILLIC}]")), "Uzbek (Cyrillic)")
        .when(cyrillic & F.rlike(low, F.lit("[ыщъё]")), "Russian")
        .when(cyrillic, "Cyrillic (Probable RU/UZ)")
        .when(latin & contains_any(low, LETTER_UZBEK), "Uzbek (Latin)")
        .when(latin, "English")
        .otherwise("Unknown")
    )


def language_code(name: Column, default: str | None = None) -> Column:
    """Code of a language's name; `default` for others and null."""
    codes = F.create_map(*(F.lit(x) for item in LANGUAGE_NAMES.items() for x in item))
    return F.coalesce(codes[F.coalesce(F.lower(F.trim(name)), F.lit(""))], F.lit(default))


def resolve_hint(detected: Column, confidence: Column, hint: Column) -> Column:
    """Array of language, confidence, method: agreement is sure, a sure or middling detection beats the hint, a weak one yields."""
    code = F.nullif(language_code(hint), F.lit("mixed"))
    return (
        F.when(F.coalesce(F.trim(hint), F.lit("")) == "", F.array(detected, confidence, F.lit("detected_only")))
        .when(code.isNull(), F.array(detected, confidence, F.lit("hint_unknown_using_detected")))
        .when(code == detected, F.array(detected, F.lit("high"), F.lit("hint_and_detected_agree")))
        .when(confidence == "high", F.array(detected, F.lit("medium"), F.concat(F.lit("detected_overrides_hint_"), code)))
        .when(confidence == "medium", F.array(detected, F.lit("low"), F.concat(F.lit("detected_vs_hint_"), code)))
        .otherwise(F.array(code, F.lit("low"), F.lit("hint_used_low_detection")))
    )


def agreement(named: Column, detected: Column) -> Column:
    """Confidence of a detection: high where the name agrees, medium where it names none of the three languages, else low."""
    name = F.coalesce(F.lower(F.trim(named)), F.lit(""))
    return F.when(name == detected, "high").when(~name.isin("uz", "en", "ru"), "medium").otherwise("low")


#: Keywords of the relabelling and of the hard-case tags.
ASKS = ("yuboring", "ayting", "kiriting", "send", "tell", "enter", "confirm", "verify", "submit")
SECRETS = ("kod", "code", "card", "karta", "cvv", "parol", "password", "login")
PAYLOADS = (".apk", ".exe", ".scr", ".msi", ".bat")
PRIZES = ("winner", "yutuq", "sovrin", "gift", "prize", "bonus")
OTP_INFO = ("tasdiqlash kodi", "sms kodi", "verification code", "your code is")
OTP_WARNING = ("bermang", "never share", "don't share", "hech kimga")
HARD_TAGS = (
    ("SAFE", "SAFE:login", ("login",)),
    ("SAFE", "SAFE:otp", ("kod", "otp", "code")),
    ("SAFE", "SAFE:payment", ("to'lov", "pay", "to’lov", "tolov")),
    ("SAFE", "SAFE:link", ("http", "havola", "www")),
    ("SAFE", "SAFE:account", ("akkaunt", "profil", "account")),
    ("SUSPICIOUS", "SUSP:bait", ("yutuq", "sovg'a", "prize", "gift")),
    ("SUSPICIOUS", "SUSP:promo", ("shoshiling", "darhol", "aksiya", "bugunoq")),
    ("SUSPICIOUS", "SUSP:curiosity", ("kutilmagan", "ssilka", "koʻring", "ko'ring")),
    ("SUSPICIOUS", "SUSP:account_update", ("yangilang",)),
    ("DANGEROUS", "DANG:apk", (".apk", "install", "yuklab", "yuklang")),
    ("DANGEROUS", "DANG:tg_scam", ("premium", "stars", "sovg'a")),
    ("DANGEROUS", "DANG:payment", ("to’lov", "tolov", "pay", "karta", "card")),
)


def relabel(scam: Column, text: Column) -> tuple[Column, Column, Column]:
    """risk_label, intent_label and tags (comma-joined) of a message from its old label (a scam or not) and keywords."""
    low = F.lower(F.coalesce(text, F.lit("")))
    scam = F.coalesce(scam, F.lit(False))
    asks, payload, info, warning = (contains_any(low, w) for w in (ASKS, PAYLOADS, OTP_INFO, OTP_WARNING))
    danger = (asks & contains_any(low, SECRETS)) | payload
    risk = F.when(~scam, "SAFE").when(danger, "DANGEROUS").otherwise("SUSPICIOUS")
    intent = (
        F.when(scam & (danger | asks), "REQUEST").when(scam, "UNKNOWN").when(info, "INFO").when(warning, "WARNING").otherwise("UNKNOWN")
    )
    tags = F.concat_ws(
        ",",
        F.when(scam & payload, "malware"),
        F.when(scam & contains_any(low, ("http", "www")), "link"),
        F.when(scam & contains_any(low, PRIZES), "prize_bait"),
        F.when(~scam & info, "otp"),
        F.when(~scam & ~info & warning, "otp_warning"),
    )
    return risk, intent, tags


def hard_tags(risk: Column, text: Column) -> Column:
    """Tags of the hard cases that a message is an example of, in a fixed order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    plain = {tag: F.when((risk == label) & contains_any(low, words), tag) for label, tag, words in HARD_TAGS}
    login = F.when((risk == "DANGEROUS") & F.contains(low, F.lit("login")) & contains_any(low, ("parol", "verify", "password", "auth")), "DANG:phishing_login")
    code = F.when((risk == "DANGEROUS") & F.contains(low, F.lit("kod")) & F.contains(low, F.lit("yuboring")), "DANG:otp_harvesting")
    order = list(plain.values())
    return F.array_compact(F.array(*order[:9], login, order[9], code, *order[10:]))


def composite_label(risk: Column, intent: Column) -> Column:
    """risk|intent without nulls; null where both are."""
    return F.when(risk.isNotNull() | intent.isNotNull(), F.concat_ws("|", risk, intent))

