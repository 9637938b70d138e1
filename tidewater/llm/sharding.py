"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import written
from tidewater.session import load

#: Rows that share a slot block on average; blocks keep the numbering of a shard out of a single task.
ROWS_PER_BLOCK = 4_000
#: Copies of a row that are numbered at once.
COPIES_PER_RUN = 10_000


def rendezvous(key: Column, weights: Sequence[float], seed: int = 7) -> Column:
    """The shard of `key`: the shard with the least -ln(u)/weight, u hashed from key and shard.

    A shard's score depends on the key and that shard alone. A new shard hence takes rows only into
    itself, a removed one gives up only its own, and a weight changed moves only what it must. Shards
    of weight zero get nothing. A null key hashes like any other value.
    """

    def score(shard: int) -> Column:
        # The upper 53 bits as a number in (0, 1).
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(shard)), 11)
        return -F.log((bits.cast("double") + 0.5) / float(2**53)) / F.lit(float(weights[shard]))

    live = [shard for shard, weight in enumerate(weights) if weight > 0]
    if not live:
        raise ValueError("no shard has a weight")
    if len(live) == 1:
        return F.lit(live[0])
    return F.least(*(F.struct(score(shard).alias("score"), F.lit(shard).alias("shard")) for shard in live))["shard"]


def number_slots(groups: DataFrame, shard: str, keys: Sequence[str], n: str) -> DataFrame:
    """`groups` (each combination of shard and keys once) with `start`, where their n slots begin: gapless from
    0 within each shard, in the order of blocks of keys, then of keys.

    Blocks are counted first; each group then adds its place in its block to the rows of the blocks before.
    No task sees a whole shard, and what is joined has a row for each shard and block.
    """
    n_blocks = max(64, (groups.agg(F.sum(n)).first()[0] or 0) // ROWS_PER_BLOCK)
    block = F.pmod(F.xxhash64(*keys, F.lit("block")), F.lit(n_blocks))
    blocked = groups.withColumn("_block", block)
    counts = blocked.groupBy(shard, "_block").agg(F.sum(n).alias("_n"))
    earlier = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy(shard, "_block").orderBy(*(F.col(k).asc_nulls_first() for k in keys)).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.withColumn("_place", F.coalesce(F.sum(n).over(within), F.lit(0)))
        .join(starts, [shard, "_block"])
        .withColumn("start", (F.col("_start") + F.col("_place")).cast("long"))
        .drop("_block", "_place", "_start")
    )


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float]) -> DataFrame:
    """Shard, slot, size and checksum of each document, and its shard under the weights `grown`.

    Null text has size 1 and the checksum of the empty string. Rows with one doc_id share a shard, a null
    doc_id being a key like any other. Slots follow from the rows alone: within a block they go by doc_id,
    then checksum and size, and rows equal in these are one group until the end, so neither a key with very
    many texts nor a row with very many copies meets in one task. Each copy gets a slot of its own. Other
    columns are ignored.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keys = ["doc_id", "text_crc32", "size"]
    rows = docs.select("doc_id", (F.octet_length(data) + F.lit(1)).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    # Written, as they are counted before they are numbered: texts are read once.
    groups = written(rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("shard", rendezvous(F.col("doc_id"), weights).cast("int")), "groups")
    numbered = number_slots(groups, "shard", keys, "n")
    # Copies in runs, so that no array is longer than one.
    run = F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(COPIES_PER_RUN)))
    runs = numbered.withColumn("from", run)
    copy = F.explode(F.sequence(F.col("from"), F.least(F.col("from") + COPIES_PER_RUN, F.col("n")) - 1))
    return runs.withColumn("copy", copy).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("copy")).alias("slot"),
        rendezvous(F.col("doc_id"), grown).cast("int").alias("grown_shard"),
    )


def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 shards of equal weight, and over 17."""
    return assign(load(spark, sf_dir, "documents"), [1.0] * 16, [1.0] * 17)
