"""Checks and comparisons of tables: validation, translation candidates, positions, overlaps, first and last rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.text import contains_any


def violations(rows: DataFrame, required: Sequence[str], allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """problem, column and n: required columns that are missing (n null), and values that aren't allowed; nulls are not counted."""
    spark = rows.sparkSession
    missing = [("missing column", c, None) for c in required if c not in rows.columns]
    out = spark.createDataFrame(missing, "problem string, column string, n long")
    checked = [c for c in allowed if c in rows.columns]
    if checked:
        counts = rows.agg(*(F.count_if(~F.col(c).isin(*allowed[c])).alias(c) for c in checked))
        each = F.explode(F.array(*(F.struct(F.lit("value not allowed").alias("problem"), F.lit(c).alias("column"), F.col(c).alias("n")) for c in checked)))
        out = out.unionByName(counts.select(each.alias("v")).select("v.*").filter("n > 0"))
    return out


#: Words of scams worth translating, of small talk that hints at a language, and the reasons given.
SCAM_WORDS = ("win", "prize", "claim", "reward", "urgent", "call now", "click", "link", "account blocked", "payment", "verify", "crypto", "investment", "guaranteed")
UZBEK_WORDS = ("salom", "qalay", "yaxshi", "bugun", "ertaga", "rahmat", "bilan")
SCAM_REASONS = (
    (("win", "prize", "claim"), "strong prize scam pattern"),
    (("account", "payment", "verify"), "urgent financial scam pattern"),
    (("crypto", "investment"), "crypto/investment scam"),
)
CHAT_REASON, OTHER_REASON, MEDIUM_REASON = "telegram promotional scam style", "high priority general scam", "medium priority scam style"
SEED_REASON, BALANCE_REASON, WEAK_REASON = "uzbek seed example", "useful ham example for balance", "noisy or weak example"
#: A safe text with fewer words than this is of use.
FEW_WORDS = 15


def candidate(scam: Column, chat: Column, text: Column) -> tuple[Column, Column, Column]:
    """Language hint, priority and reason of a text as a candidate for translation; `chat` tells its source."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda words: contains_any(low, words)
    hint = F.when(F.rlike(low, F.lit("[а-яё]")), "ru").when(has(UZBEK_WORDS), "uz").otherwise("en")
    strong, short = has(SCAM_WORDS), F.size(F.filter(F.split(low, r"\s+"), lambda w: w != "")) < FEW_WORDS
    why = F.when(chat, CHAT_REASON).otherwise(OTHER_REASON)
    for words, reason in reversed(SCAM_REASONS):
        why = F.when(has(words), reason).otherwise(why)
    useful = short & (hint == "uz")
    priority = F.when((scam & strong) | (~scam & useful), "high").when(scam | short, "medium").otherwise("low")
    reason = F.when(scam, F.when(strong, why).otherwise(MEDIUM_REASON)).when(useful, SEED_REASON).when(short, BALANCE_REASON).otherwise(WEAK_REASON)
    return hint, priority, reason


def chosen(priority: Column, text: Column) -> Column:
    """All of high priority, and those of medium whose digest is a multiple of five: a fifth, the same at each run."""
    part = F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 8), 16, 10).cast("long")
    return (priority == "high") | ((priority == "medium") & (part % 5 == 0))


def settled_language(label: Column, detected: Column) -> tuple[Column, Column]:
    """Language and origin: a label wins unless it is null, mixed or unknown; then a detection that is neither, else the label or `unknown`."""
    vague = lambda c: F.coalesce(F.lower(F.trim(c)).isin("", "mixed", "unknown"), F.lit(True))
    language = F.when(~vague(label), F.lower(F.trim(label))).when(~vague(detected), detected).otherwise(F.coalesce(F.nullif(F.lower(F.trim(label)), F.lit("")), F.lit("unknown")))
    return language, F.when(~vague(label), "label").when(~vague(detected), "detected").otherwise("none")


def positional_differences(left: DataFrame, right: DataFrame, at: str, value: str) -> DataFrame:
    """Rows of two tables at the same place whose values differ; null is equal to null. A place of one table alone differs."""
    a, b = left.select(at, F.col(value).alias("left"), F.lit(True).alias("_l")), right.select(at, F.col(value).alias("right"), F.lit(True).alias("_r"))
    both = a.join(b, at, "full_outer")
    return both.filter(F.col("_l").isNull() | F.col("_r").isNull() | ~F.col("left").eqNullSafe(F.col("right"))).select(at, "left", "right")


def overlap_examples(left: DataFrame, right: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """For each key of both tables the first row of each side, by `order`."""

    def first(rows: DataFrame, side: str) -> DataFrame:
        # The least of structs is summed up before the shuffle, so a frequent key costs a row per task.
        least = rows.groupBy(key).agg(F.min(F.struct(order, *columns)).alias("f"))
        return least.select(key, *(F.col(f"f.{c}").alias(f"{side}_{c}") for c in (order, *columns)))

    return first(left, "left").join(first(right, "right"), key)


def ends(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first and the last n rows by `order`, with `place` ('first' or 'last'). Each is a bounded top-n."""
    head, tail = rows.orderBy(F.asc(order)).limit(n), rows.orderBy(F.desc(order)).limit(n)
    return head.withColumn("place", F.lit("first")).unionByName(tail.withColumn("place", F.lit("last")))


def distinct_by(items: Column, key: str) -> Column:
    """An array of structs without those whose `key` an earlier one has."""
    keys = F.transform(items, lambda x: x[key])
    return F.filter(items, lambda x, i: F.array_position(keys, x[key]) == i + 1)


def filled_templates(templates: DataFrame, slots: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each template with every combination of the slots' values: `{name}` stands for a slot. Both are small tables."""
    out = templates
    for name, values in slots.items():
        filled = F.explode(F.when(F.contains("text", F.lit("{" + name + "}")), F.array(*map(F.lit, values))).otherwise(F.array(F.lit(""))))
        out = out.withColumn("_v", filled).withColumn("text", F.replace("text", F.lit("{" + name + "}"), F.col("_v"))).drop("_v")
    return out


def side_logs(rows: DataFrame, key: str, label: str, language: str, id: str) -> dict[str, DataFrame]:
    """What a build leaves out or doubts: keys with several labels, rows of mixed or unknown language, and copies removed.

    conflicts: a row for each key with its labels; mixed: rows; removed: rows that an earlier one (by id) has the key of.
    """
    conflicts = rows.groupBy(key).agg(F.sort_array(F.collect_set(label)).alias("labels"), F.count("*").alias("n")).filter(F.size("labels") > 1)
    mixed = rows.filter(F.coalesce(F.col(language).isin("mixed", "unknown"), F.lit(True)))
    first = rows.groupBy(key).agg(F.min(id).alias("_first"))
    removed = rows.join(first, key).filter(F.col(id) > F.col("_first")).drop("_first")
    return {"conflicts": conflicts, "mixed": mixed, "removed": removed}


def keep_trimmed(table: DataFrame, fresh: DataFrame, id: str, ts: str, days: int, now: Column) -> DataFrame:
    """`table` with the rows of `fresh` in place of those with their ids, without what is older than so many days."""
    new = fresh.withColumn("_new", F.lit(1)).unionByName(table.withColumn("_new", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(id).orderBy(F.desc("_new"), F.desc(ts)))
    return new.withColumn("_k", rank).filter("_k = 1").drop("_k", "_new").filter(F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS"))


#: Bytes of a dictionary up to which it is sent to every executor; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def looked_up(rows: DataFrame, names: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """`rows` with the `value` that the dictionary `names` (each `key` once) has for their key, else the default."""
    size = names.agg(F.sum(F.octet_length(F.concat_ws("", key, value)) + 64)).first()[0] or 0
    table = F.broadcast(names) if size <= BROADCAST_BYTES else names
    return rows.join(table, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))
