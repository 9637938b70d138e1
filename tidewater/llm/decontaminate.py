"""Benchmark decontamination: word windows of test items found in training texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import LOWER, UPPER, let, window_hash
from tidewater.session import load

#: Words of a window.
WINDOW = 10
#: Windows of test items of up to so many bytes are broadcast, counting RECORD_BYTES for each besides its
#: characters and items; more are joined by a shuffle.
MOST_BROADCAST, RECORD_BYTES = 64 << 20, 64
#: Places of windows in a text.
SPANS = "array<struct<start:int,len:int>>"
#: Fixed value: the ASCII characters that part words, after lower-casing.
PARTING = "".join(chr(c) for c in range(128) if not (chr(c).isdigit() or chr(c).islower() or chr(c).isupper()))
PARTING_CLASS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def benchmark_words(text: Column) -> Column:
    """The lower-cased (A-Z) runs of digits, letters a-z and non-ASCII characters; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + PARTING[1:], LOWER + " " * len(PARTING[1:]))
    return F.array_remove(F.split(F.translate(plain, PARTING[0], " "), " "), "")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The items' distinct windows: gram (words joined by blanks), len, h, and `items`, the ids that have it.

    An item with fewer words than `window` is one window of all its words; one without words has none.
    Null ids are left out of `items`.
    """
    words = items.select("item_id", benchmark_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    grams = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, n))).alias("g"))
    # The hash has to be that of window_hash: an array's is that of its elements, one after the other.
    each = grams.select(F.col("item_id").cast("string").alias("item"), F.array_join("g", " ").alias("gram"), F.size("g").alias("len"), F.xxhash64("g").alias("h"))
    return each.groupBy("gram", "len", "h").agg(F.collect_set("item").alias("items"))


def places(words: DataFrame, lengths: list[int]) -> DataFrame:
    """`words` (a column `w` of words among others) at each place `at` once for each length of window, with the
    window's hash `hash`; null where the text ends before. Hashes are computed after the places are exploded,
    and so in generated code."""
    each = words.withColumn("length", F.explode(F.array(*map(F.lit, lengths)))) if len(lengths) > 1 else words.withColumn("length", F.lit(lengths[0]))
    each = each.select("*", F.posexplode_outer("w").alias("at", "_word")).drop("_word")
    h = F.lit(None).cast("long")
    for length in lengths:
        h = F.when(F.col("length") == length, window_hash(F.col("w"), F.col("at"), length)).otherwise(h)
    return each.withColumn("hash", F.when(F.col("at") + F.col("length") <= F.size("w"), h))


def gathered(found: DataFrame, *by: str) -> DataFrame:
    """`spans` and `item_ids` of each group of verified hits (span, items)."""
    return found.groupBy(*by).agg(
        *(F.first(c, ignorenulls=True).alias(c) for c in ("row", "n_words") if c in found.columns),
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )


def gram_at(at: Column, length: Column) -> Column:
    """The words of a window, joined as those of item_windows are."""
    return F.array_join(F.slice("w", at + 1, length), " ")


def hits_by_broadcast(rows: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """row, n_words, spans and item_ids of each of `rows` (id, row, w): every window is looked up in the
    broadcast windows and verified in the same pass; only hits and one line a row are gathered. The row itself,
    its text included, comes with its first place alone, so that hits cost no more than their spans."""
    each = places(rows.select("id", "row", "w"), lengths)
    same = (F.col("length") == F.col("len")) & (gram_at(F.col("at"), F.col("len")) == F.col("gram"))
    found = each.join(F.broadcast(grams), (F.col("hash") == F.col("h")) & same, "left")
    leads = F.col("at").isNull() | ((F.col("at") == 0) & (F.col("length") == lengths[0]))
    found = found.filter(F.col("h").isNotNull() | leads).select(
        "id",
        F.when(leads, F.col("row")).alias("row"),
        F.when(leads, F.size("w").cast("long")).alias("n_words"),
        F.when(F.col("h").isNotNull(), F.struct(F.col("at").alias("start"), F.col("len").alias("len"))).alias("span"),
        "items",
    )
    return gathered(found, "id").drop("id")


def hits_by_shuffle(rows: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for windows that are too many to broadcast.

    Texts stay where they are: what is shuffled of a place is its hash, with the row's 128-bit key. Places
    whose hash is a window's go back to their texts to be verified word by word; spans and items are then
    joined to the rows. Each window is on its side of a join once, so where a window is frequent Spark's
    adaptive plan splits the places alone. Equal rows share a key, and so their hits; a row without hits needs none.
    """
    key = ["k1", "k2"]
    keyed = rows.select("row", F.size("w").cast("long").alias("n_words"), "w", *key)
    each = places(keyed.select(*key, "w"), lengths).filter("hash IS NOT NULL").select(*key, "at", "length", "hash")
    wanted = grams.select(F.col("len").alias("length"), F.col("h").alias("hash")).distinct()
    seen = each.join(wanted, ["length", "hash"], "left_semi")
    seen = seen.groupBy(*key).agg(F.collect_set(F.struct("at", "length", "hash")).alias("seen"))
    shown = keyed.select(*key, "w").join(seen, key).select(*key, "w", F.explode("seen").alias("s"))
    shown = shown.select(*key, F.struct(F.col("s.at").alias("start"), F.col("s.length").alias("len")).alias("span"), gram_at(F.col("s.at"), F.col("s.length")).alias("gram"), F.col("s.hash").alias("h"))
    verified = shown.join(grams.select("gram", "h", "items"), ["gram", "h"])
    hits = gathered(verified.select(*key, "span", "items"), *key)
    return keyed.drop("w").join(hits, key, "left").select(
        "row",
        "n_words",
        F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_broadcast: int | None = None) -> DataFrame:
    """doc_id, n_words, spans and item_ids of each row of `docs`; see hits_beside."""
    return hits_beside(docs, items, ["doc_id"], window, most_broadcast).select("row.doc_id", "n_words", "spans", "item_ids")


def hits_beside(docs: DataFrame, items: DataFrame, keep: list[str], window: int, most_broadcast: int | None) -> DataFrame:
    """One row per row of `docs`: `row`, a struct of the columns to `keep`, n_words, spans and item_ids.

    spans: sorted (start, len) in words of all item windows in the text; item_ids: as strings, sorted.
    Every window of every text is looked up. Null and empty texts have no words. Null item_ids hit like
    others but aren't listed. Repeated documents give repeated rows; repeated items count once. Either
    table may be empty. Columns besides doc_id and text may have any names. Windows of up to most_broadcast
    bytes (characters and RECORD_BYTES for each) are broadcast, more are shuffled.
    """
    most_broadcast = MOST_BROADCAST if most_broadcast is None else most_broadcast
    grams = item_windows(items, window)
    told = grams.agg(F.collect_set("len").alias("lengths"), F.sum(F.octet_length("gram") + F.size("items") * 16 + RECORD_BYTES).alias("size")).first()
    lengths = sorted(told["lengths"])  # `window` values at most
    rows = docs.select(
        F.monotonically_increasing_id().alias("id"),
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"),
        benchmark_words(F.col("text")).alias("w"),
        *(F.xxhash64(F.lit(i), F.col("doc_id").isNull(), "doc_id", "text").alias(f"k{i}") for i in (1, 2)),
    )
    if not lengths:
        none = F.array().cast("array<string>").alias("item_ids")
        return rows.select("row", F.size("w").cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"), none)
    return (hits_by_broadcast if told["size"] <= most_broadcast else hits_by_shuffle)(rows, grams, lengths)


def hit_places(spans: Column) -> Column:
    """The places of all words that the spans cover, each once."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))


def covered_words(spans: Column) -> Column:
    """How many words the spans cover."""
    return F.size(hit_places(spans)).cast("long")


def remove_words(text: Column, spans: Column) -> Column:
    """`text` without the words in `spans` and what stands directly before each of them."""
    pattern = F.lit(f"[{PARTING_CLASS}]*[^{PARTING_CLASS}]+|[{PARTING_CLASS}]+$")
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), pattern, F.lit(0))
    return let(
        tokens,
        lambda every: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), hit_places(spans)), lambda i: F.get(every, i)), ""
        ),
    )


def decontaminate(docs: DataFrame, items: DataFrame, most_hit_share: float = 0.2, window: int = WINDOW, most_broadcast: int | None = None) -> DataFrame:
    """`docs` without what they share with `items`: texts lose the windows that hit; a text of which
    more than `most_hit_share` is hit goes as a whole. Texts without a hit stay as they are, null ones too.
    """
    found = hits_beside(docs, items, docs.columns, window, most_broadcast).withColumn("hit", covered_words(F.col("spans")))
    kept = found.filter(F.col("hit") <= most_hit_share * F.col("n_words"))
    text = F.when(F.col("hit") > 0, remove_words(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    return kept.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document shares with the benchmark's items."""
    found = find_hits(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    n_hit = covered_words(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item_id, len, array_to_string(w[i:i + len - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - len + 2)) AS i FROM (SELECT *, least(len(w), 10) AS len FROM b WHERE len(w) > 0))),
p AS (
  SELECT rid, len, i, array_to_string(w[i:i + len - 1], ' ') AS gram
  FROM (SELECT rid, w, l.len AS len, unnest(range(1, len(w) - l.len + 2)) AS i FROM d, (SELECT DISTINCT len FROM g) l)),
h AS (SELECT rid, i, p.len AS len, item_id FROM p JOIN g USING (len, gram)),
c AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + len)) AS k FROM (SELECT DISTINCT rid, i, len FROM h)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
