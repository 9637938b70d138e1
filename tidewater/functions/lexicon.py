"""The signals of the rule engine: keywords, category and weight of each."""

from __future__ import annotations

from typing import NamedTuple

from tidewater.functions.results import ARCHIVE_ENDINGS, DANGEROUS_ENDINGS
from tidewater.functions.text import SUSPICIOUS_TLDS


class Signal(NamedTuple):
    """A message has the signal if one of the keywords occurs; without keywords other evidence gives it."""

    keywords: tuple[str, ...]
    weight: int
    category: str


#: Keywords of safe notices. Those that contain ' never occur, as normalized texts have ‘ alone.
SAFE_OTP = ("bu kodni hech kimga bermang", "xodimlariga ham", "don't share", "ni hech kimga aytmang", "никому не сообщайте")
SAFE_TRANSACTION = ("yechildi", "tushum", "to'lov qabul qilindi", "balans:", "balance:", "o'tkazildi")
SAFE_SERVICE = (
    "successfully updated", "sizning profilingiz", "xizmat yoqildi", "tasdiqlash kodi", "sms kodi", "ariza qabul qilindi", "my.gov.uz",
    "yetkazib berildi", "buyurtmangiz borgan", "tarif rejangiz", "daqiqalar qoldi", "hisobingiz to'ldirildi", "ijobiy hal etildi",
    "id.egov.uz",
)
SAFE_BANK = (
    "o'tkazildi", "tushum:", "xarid:", "yechildi:", "karta bloklandi", "shaxsiy kabinetingizga kirish", "vaqtida to'lov qiling",
    "hisobingiz holati",
)
#: Phrases that let a warning or a notice count as safe.
SAFE_PHRASES = SAFE_OTP + SAFE_TRANSACTION + SAFE_SERVICE

#: Keywords of files, logins and money.
MALWARE = {
    "dangerous_file_extension": Signal(DANGEROUS_ENDINGS, 75, "MALWARE"),
    "archive_payload": Signal(ARCHIVE_ENDINGS, 20, "MALWARE"),
    "double_extension_trick": Signal((), 50, "MALWARE"),
}
PHISHING = {
    "phishing_login": Signal(
        ("login", "parol", "verifikatsiya", "identifikatsiya", "verify", "secure", "update", "account", "bank-login", "confirm-account",
         "security-update"), 40, "PHISHING",
    ),
    "phishing_auth_bait": Signal(("telegram premium", "premium free", "free premium", "premium gift", "premium claim"), 45, "PHISHING"),
}
FINANCIAL = {
    "financial_data_request": Signal(
        ("bank", "karta", "hisob", "balans", "to‘lov", "o‘tkazma", "karta raqami", "pul mablag‘lari", "onlayn bank", "hisob raqami", " карта ",
         "счет", "перевод"), 25, "FINANCIAL",
    ),
    "otp_request": Signal(
        ("otp", "one time password", "tasdiqlash kodi", "sms kodi", "verification code", "kodni yuboring", "kodni ayting", "kodni kiriting",
         "подтверждения", "код подтверждения"), 45, "FINANCIAL",
    ),
    "personal_info_request": Signal(("pasport", "jshshir", "pinfl", "shaxsiy ma'lumot", "hujjat", "propiska", "seriyasi"), 30, "FINANCIAL"),
    "card_phishing_bait": Signal(
        ("cvv", "cvc", "muddat", "kartaning amal qilish muddati", "to'lov", "payment", "plastik karta", "uzcard", "humo", "visa", "mastercard",
         "karta raqami", "karta raqamini", "muddatini", "amal qilish muddati"), 35, "FINANCIAL",
    ),
}
LINKS = {
    "suspicious_link": Signal(("http://", "https://", "bit.ly", "tinyurl", "rb.gy", "shorturl", "klik qiling", "bosing"), 30, "LINK"),
    "suspicious_tld_match": Signal(SUSPICIOUS_TLDS, 25, "LINK"),
}
#: Keywords of pressure and bait.
PRESSURE = {
    "urgency_pressure": Signal(
        ("urgent", "immediately", "darhol", "shoshiling", "zudlik bilan", "hozir", "kechiktirmang", "tezda", "24 soat", "10 daqiqa",
         "tezkor javob", "срочно", "немедленно", "aks holda", "vaqt tugayapti", "cheklanadi"), 15, "SOCIAL_ENGINEERING",
    ),
    "fear_threat": Signal(
        ("bloklandi", "muzlatildi", "yopiladi", "hisob yopiladi", "cheklangan", "xavf ostida", "jarima", "to‘xtatiladi", "shoshilinch xavf",
         "блокировка", "заблокирован"), 25, "SOCIAL_ENGINEERING",
    ),
    "prize_bait": Signal(
        ("yutdingiz", "sovrin", "bonus", "mukofot", "bepul", "hadya", "lotereya", "sovg'a", "yutuq", "giveaway", "free premium",
         "stars giveaway", "вы выиграли", "приз", "premium yutdingiz", "premium yutib oldingiz", "sovg'a tayyorlangan", "siz yutdingiz"),
        30, "SOCIAL_ENGINEERING",
    ),
    "curiosity_lure": Signal(
        ("bu senmi", "rasmga qaragin", "shu rasmda sen bormi", "look at this photo", "is this you", "senmisan", "foto", "video",
         "shaxsiy rasm", "siz uchun tayyorlangan", "sizga maxsus", "ko'rib chiqing", "tekshirib ko'ring", "sizni kutmoqda",
         "tavsiya etiladi", "saqlab qolish uchun"), 15, "SOCIAL_ENGINEERING",
    ),
    "promo_pressure": Signal(
        ("ajoyib imkoniyat", "bugunoq", "hoziroq", "ro'yxatdan o'ting", "aktivlashtiring", "maxsus taklif", "aksiya", "foydali taklif",
         "imkoniyatni boy bermang", "siz uchun maxsus", "foydali", "imkoniyat", "foydali imkoniyat"), 15, "SOCIAL_ENGINEERING",
    ),
    "account_update_pressure": Signal(
        ("profilingizni yangilang", "profilingizni tasdiqlang", "akkauntingizni yangilang", "akkauntingizni tasdiqlang",
         "loginni tasdiqlang", "hisobingizni tasdiqlang", "funksiyalar ishlamasligi mumkin", "bloklanishi mumkin",
         "hisobingiz bo'yicha yangilanish", "akkauntni tasdiqlang", "yangilanish mavjud", "hisobingiz bo'yicha", "yangilanish",
         "akkaunt yangilanishi", "hisob yangilanishi"), 15, "SOCIAL_ENGINEERING",
    ),
    "vague_action_request": Signal(
        ("tekshirib chiqing", "yangilang", "tasdiqlang", "ko'rib chiqing", "haqidagiyangilanish", "tasdiqlash", "tasdiqlanish",
         "qayta tasdiqlash", "aniqlash", "aniqlashtirish", "ma'lumotlarni aniqlashtirish"), 10, "SOCIAL_ENGINEERING",
    ),
}
#: Keywords of what a message asks for.
INTENT = {
    "click_intent": Signal(
        ("bosing", "bos", "havolani oching", "linkni oching", "open", "click", "tap", "batafsil ko‘ring", "see details", "ko‘rib chiqing"),
        5, "INTENT",
    ),
    "download_intent": Signal(
        ("yuklab oling", "yuklab olish", "download", "install", "o‘rnating", "ilovani o‘rnating", ".apk", "apk", "faylni yuklab oling"),
        15, "INTENT",
    ),
    "login_intent": Signal(
        ("login qiling", "hisobga kiring", "akkauntga kiring", "sign in", "confirm account", "parolni kiriting",
         "identifikatsiyadan o'ting", "shaxsingizni tasdiqlang"), 20, "INTENT",
    ),
    "payment_intent": Signal(
        ("to‘lov qiling", "to‘lovni yakunlang", "payment", "pay now", "karta ma’lumotlarini kiriting", "card details", "transfer qiling",
         "jarimani to‘lang", "click.uz", "payme", "karta raqami", "muddatini"), 25, "INTENT",
    ),
    "urgency_intent": Signal(
        ("hoziroq", "darhol", "zudlik bilan", "immediately", "urgent", "bugun oxirigacha", "24 soat ichida", "kechiktirmang", "aks holda",
         "bloklanadi"), 5, "INTENT",
    ),
    "submit_intent": Signal(
        ("yuboring", "jo‘nating", "reply qiling", "javob bering", "sms kodni yuboring", "confirm code", "kodni kiriting",
         "tasdiqlash kodini yuboring"), 10, "INTENT",
    ),
}
REST = {
    "social_manipulation": Signal(
        ("do‘stlaringiz kutmoqda", "jamiyat oldida", "hammasi sizga bog‘liq", "hech kimga aytmang", "maxfiy"), 15, "SOCIAL_ENGINEERING"
    ),
    "safe_otp_notice": Signal(SAFE_OTP, 0, "SAFE"),
    "safe_transaction_info": Signal(SAFE_TRANSACTION, 0, "SAFE"),
    "safe_service_notification": Signal(SAFE_SERVICE, 0, "SAFE"),
    "safe_bank_alert": Signal(SAFE_BANK, 0, "SAFE"),
}
#: All signals, in the order in which they are found.
SIGNALS: dict[str, Signal] = MALWARE | PHISHING | FINANCIAL | LINKS | PRESSURE | INTENT | REST
KEYWORDS = {name: s.keywords for name, s in SIGNALS.items()}
WEIGHTS = {name: (s.category, s.weight) for name, s in SIGNALS.items()}
#: Phrases that tell of the state of an account.
FINANCIAL_ALERTS = (*SAFE_TRANSACTION, "tranzaksiya", "noma’lum to‘lov", "hisobingizda shubhali faollik", "kirish aniqlandi")
