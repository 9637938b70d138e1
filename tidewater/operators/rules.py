"""The rule engine: lexicon signals, pattern floors and overrides as column expressions, one pass and no shuffle.

Messages carry signals (array of names, null: none), intent (null: unknown), text (normalized, null: empty) and the
booleans link, suspicious_tld, malicious_file, double_extension and has_file (null: false).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

#: Signals that count as soft pressure, and phrases of strong pressure.
SOFT_SIGNALS = ("account_update_pressure", "urgency_pressure", "promo_pressure", "vague_action_request")
STRONG_PHRASES = ("aks holda", "cheklanadi", "vaqt tugayapti")
SEND_WORD = "yuboring"
#: The signal on the left silences the one on the right in the base score.
SUPPRESSION = (
    ("urgency_pressure", "urgency_intent"),
    ("card_phishing_bait", "financial_data_request"),
    ("account_update_pressure", "vague_action_request"),
    ("personal_info_request", "curiosity_lure"),
)
#: The most that a category adds to the base score.
CATEGORY_CAPS = {"SOCIAL_ENGINEERING": 30, "FINANCIAL": 40}


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def signals() -> Column:
    return F.coalesce("signals", F.array().cast("array<string>"))


def has(*names: str) -> Column:
    """Whether one of the signals is there."""
    return reduce(Column.__or__, (F.array_contains(signals(), n) for n in names))


def says(*phrases: str) -> Column:
    """Whether the text contains one of the phrases."""
    return reduce(Column.__or__, (F.contains(F.coalesce("text", F.lit("")), F.lit(p)) for p in phrases))


def trie_pattern(words: Sequence[str]) -> str:
    """A pattern that matches the longest of the words at a place: their tree of letters, read once a place."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def written(node: dict) -> str:
        branches = [f"\\x{{{ord(letter):x}}}" + written(below) for letter, below in sorted(node.items()) if letter]
        if not branches:
            return ""
        inner = branches[0] if len(branches) == 1 else "|".join(branches)
        return f"(?:{inner})?+" if "" in node else f"(?:{inner})" if len(branches) > 1 else inner

    return written(tree)


def stripped(word: str) -> str:
    return word.lower().replace(" ", "").replace(".", "")


def match_lexicon(text: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """Signals whose keywords occur, in the lexicon's order: as written, without blanks, or without blanks and dots.

    What occurs as written also does once the same characters are taken out of text and keyword, so the last
    way finds all that the others do; only a keyword with capitals may occur as written alone. A text is read
    once for all keywords: by an automaton over batches of texts where its library is there, else by a pattern.
    """
    words = {name: tuple(sorted({stripped(w) for w in keywords})) for name, keywords in lexicon.items() if keywords}
    capitals = {name: tuple(w for w in keywords if w != w.lower()) for name, keywords in lexicon.items()}
    if not words:
        return F.array().cast("array<string>")
    bare = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit("")), F.lit("."), F.lit(""))
    return (by_pattern if ahocorasick is None else by_automaton)(bare, text, words, capitals)


def by_automaton(bare: Column, text: Column, words: Mapping[str, Sequence[str]], capitals: Mapping[str, Sequence[str]]) -> Column:
    """The signals of texts without blanks and dots, a batch at a time; a keyword's signals are bits of a number."""
    names = list(words)
    bits: dict[str, int] = {}
    for i, name in enumerate(names):
        for word in words[name]:
            bits[word] = bits.get(word, 0) | 1 << i
    always = bits.pop("", 0)
    spelled = [(1 << i, word) for i, name in enumerate(names) for word in capitals[name]]

    def find(stripped_texts: pa.Array, *texts: pa.Array) -> pa.Array:
        # Texts become Python strings one by one; those of a whole batch would be several times its size.
        automaton = ahocorasick.Automaton()
        for word, owners in bits.items():
            automaton.add_word(word, owners)
        automaton.make_automaton()
        out = []
        for i, short in enumerate(stripped_texts):
            found = always
            for _, owners in automaton.iter(short.as_py()) if bits else ():
                found |= owners
            whole = texts[0][i].as_py() if texts else None
            for owner, word in spelled:
                if whole is not None and word in whole:
                    found |= owner
            out.append([name for k, name in enumerate(names) if found >> k & 1])
        return pa.array(out, pa.list_(pa.string()))

    def of_both(stripped_texts: pa.Array, texts: pa.Array) -> pa.Array:
        return find(stripped_texts, texts)

    def of_one(stripped_texts: pa.Array) -> pa.Array:
        return find(stripped_texts)

    # The text itself is of use for keywords with capitals alone.
    return F.arrow_udf(of_both, "array<string>")(bare, text) if spelled else F.arrow_udf(of_one, "array<string>")(bare)


def by_pattern(bare: Column, text: Column, words: Mapping[str, Sequence[str]], capitals: Mapping[str, Sequence[str]]) -> Column:
    """The same by a pattern: at each place the tree of keywords gives the longest that begins there, and with it occur
    all keywords that it begins with, and no others at that place."""
    every = sorted({w for own in words.values() for w in own if w})
    hits = F.array_distinct(F.regexp_extract_all(bare, F.lit(f"(?=({trie_pattern(every)}))"), F.lit(1))) if every else F.array().cast("array<string>")

    def signals_in(found: Column) -> Column:
        def occurs(name: str) -> Column:
            if "" in words[name]:
                return F.lit(True)
            longest = [w for w in every if any(w.startswith(own) for own in words[name])]
            capital = [F.coalesce(F.contains(text, F.lit(w)), F.lit(False)) for w in capitals[name]]
            return reduce(Column.__or__, capital, F.arrays_overlap(found, F.array(*map(F.lit, longest))))

        return F.array_compact(F.array(*(F.when(occurs(name), name) for name in words)))

    return F.get(F.transform(F.array(hits), signals_in), F.lit(0))


def suppress(found: Column) -> Column:
    """Signals that count for the base score."""
    silenced = [F.when(F.array_contains(found, strong), weak) for strong, weak in SUPPRESSION]
    return F.array_except(found, F.array_compact(F.array(*silenced)))


def base_score(found: Column, weights: Mapping[str, tuple[str, int]]) -> Column:
    """Sum of the weights {signal: (category, weight)}, capped by category, then to 0..100."""
    total = F.lit(0)
    for category in sorted({c for c, _ in weights.values()}):
        parts = [F.when(F.array_contains(found, n), w).otherwise(0) for n, (c, w) in weights.items() if c == category]
        part = reduce(Column.__add__, parts)
        total = total + (F.least(part, F.lit(CATEGORY_CAPS[category])) if category in CATEGORY_CAPS else part)
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def hard_threat() -> Column:
    """Evidence that lets a message be dangerous: a link, a file, or a request for codes, cards or money."""
    link, send = flag("link"), says(SEND_WORD)
    return (
        link
        | flag("malicious_file")
        | has("otp_request", "card_phishing_bait")
        | (has("payment_intent") & (has("urgency_pressure") | send))
        | (has("submit_intent") & send)
    )


def floors() -> list[tuple[str, int, Column]]:
    """Rules (key, floor, when) that hold before the cap."""
    link, tld, file = flag("link"), flag("suspicious_tld"), flag("malicious_file")
    asks = F.coalesce(F.col("intent") == "REQUEST", F.lit(False))
    return [
        ("request_otp_danger", 85, asks & has("otp_request")),
        ("request_card_scam", 90, asks & has("card_phishing_bait", "financial_data_request")),
        ("request_link_phishing", 70, asks & link),
        ("mixed_content_danger", 90, link & (file | flag("has_file")) & has("urgency_pressure", "prize_bait")),
        ("phishing_giveaway", 75, has("prize_bait") & link),
        ("scam_promo", 80, has("prize_bait") & tld),
        ("financial_phishing", 85, has("financial_data_request") & link),
        ("credential_theft", 80, has("otp_request", "personal_info_request") & has("urgency_pressure")),
        ("tg_premium_scam", 80, has("phishing_auth_bait") & link),
        ("tg_phishing_extreme", 85, has("phishing_auth_bait") & tld),
        ("malware_delivery", 90, file),
        ("hidden_malware", 95, flag("double_extension") & (file | flag("has_file"))),
        ("social_malware", 90, has("prize_bait", "curiosity_lure") & file),
        ("phishing_login_match", 90, has("phishing_login") & tld),
        ("banking_alert_scam", 85, has("financial_data_request") & link),
        ("fear_phishing", 75, has("fear_threat") & link),
    ]


def combinations() -> list[tuple[str, int, Column]]:
    """Rules (key, floor, when) of intents; they hold after the cap and may exceed it."""
    link = flag("link")
    return [
        ("intent_link_login", 70, link & has("login_intent")),
        ("intent_link_payment", 65, link & has("payment_intent")),
        ("intent_download_malware", 90, has("download_intent") & flag("malicious_file")),
        ("intent_urgent_account_threat", 80, has("urgency_intent") & has("fear_threat") & has("login_intent")),
        ("intent_bait_click", 55, has("prize_bait", "curiosity_lure") & has("click_intent")),
        ("intent_payment_urgency", 70, has("payment_intent") & has("urgency_intent")),
        ("intent_submit_scam", 75, has("submit_intent") & (link | has("login_intent"))),
    ]


def highest(rules: list[tuple[str, int, Column]]) -> Column:
    return F.greatest(F.lit(0), *(F.when(when, floor).otherwise(0) for _, floor, when in rules))


def settled(rows: DataFrame, *columns: str) -> DataFrame:
    """`rows` with the columns computed at this point. The optimizer would put a filter on a later column below,
    with every reference replaced by what it stands for, which grows by powers; it leaves what a generator makes."""
    others = [c for c in rows.columns if c not in columns]
    return rows.select(*others, F.inline(F.array(F.struct(*columns))))


def judge(messages: DataFrame, safe_phrases: Sequence[str] = ()) -> DataFrame:
    """`messages` with hard_threat, pattern_keys (in rule order) and pattern_floor.

    A floor without a hard threat is capped at 60 before the intent rules; messages with no signal have floor 0.
    """
    safe = flag("suspicious_tld") | flag("malicious_file") | ~F.coalesce(F.col("intent").isin("WARNING", "INFO"), F.lit(False))
    safe = ~safe & F.col("says_safe")
    soft = reduce(Column.__add__, (has(s).cast("int") for s in SOFT_SIGNALS))
    strong, hard = F.col("says_strong"), F.col("hard_threat")
    early, late = [*floors()], combinations()
    early.insert(3, ("safe_override_applied", 5, safe))
    pressed = ~hard & ((soft >= 2) | strong)
    lifted = F.when(pressed & ((soft >= 3) | strong), 50).when(pressed, 40).otherwise(0)
    before = F.greatest(highest(early), lifted)
    many = F.size(signals())
    five = hard & ((many >= 5) | ((many >= 4) & (flag("link") | flag("malicious_file"))))
    rules = [*early, ("soft_manipulation_floor", 0, pressed), *late]
    keys = F.array_compact(F.array(*(F.when(when, key) for key, _, when in rules)))
    floor = F.greatest(F.when(hard, before).otherwise(F.least(before, F.lit(60))), highest(late), F.when(five, 95).otherwise(0))
    # The text is searched once for the phrases; each rule would search it again.
    searched = {"hard_threat": hard_threat(), "says_strong": says(*STRONG_PHRASES), "says_safe": says(*safe_phrases) if safe_phrases else F.lit(False)}
    rows = settled(messages.withColumns(searched), *searched)
    return rows.withColumns({"pattern_keys": keys, "pattern_floor": floor}).drop("says_strong", "says_safe")


def apply_safe_override(score: Column, keys: Column, hard: Column) -> Column:
    """Scores from 40 on fall to 39 where a safe phrase was found and nothing is hard evidence."""
    return F.when(F.array_contains(keys, "safe_override_applied") & ~hard & (score >= 40), 39).otherwise(score)
