"""Balancing and splitting: exact counts per stratum, membership by a seeded digest.

Places are counted in buckets of the digest, so no task holds a whole stratum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a stratum: the first three hex digits of the digest.
BUCKET_DIGITS = 3


def shuffled(seed: int, key: str) -> list[Column]:
    """A seeded order that any engine can repeat."""
    return [F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]


def ranked(df: DataFrame, strata: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    """`df` with _place of a row in its stratum's seeded order, _of (rows of the stratum) and _all (rows).

    Null strata are strata of their own. Rows are shuffled once, by stratum and bucket of the digest; the counts of the
    buckets, at most 4,096 for each stratum, are summed on their own.
    """
    digest, _ = shuffled(seed, key)
    marked = df.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, BUCKET_DIGITS))
    sizes = marked.groupBy(*strata, "_bucket").agg(F.count("*").alias("_n"))
    stratum = Window.partitionBy(*strata)
    before = F.sum("_n").over(stratum.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(
        *(F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)),
        F.col("_bucket").alias("_b"),
        F.coalesce(before, F.lit(0)).alias("_before"),
        F.sum("_n").over(stratum).alias("_of"),
        F.sum("_n").over(Window.partitionBy()).alias("_all"),
    )
    same = F.col("_bucket") == F.col("_b")
    for i, c in enumerate(strata):
        same &= marked[c].eqNullSafe(F.col(f"_s{i}"))
    joined = marked.join(offsets, same).drop("_b", *(f"_s{i}" for i in range(len(strata))))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*strata, "_bucket").orderBy("_digest", key))
    return joined.withColumn("_place", place).drop("_before", "_bucket", "_digest")


def unranked(df: DataFrame) -> DataFrame:
    return df.drop("_place", "_of", "_all")


def stratified(df: DataFrame, strata: Sequence[str], key: str, seed: int = 42, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """`split` of each row: train, valid or test by its place in its stratum; strata under 3 rows train."""
    place, n = F.col("_place"), F.col("_of")
    first, second = F.floor(n * train), F.floor(n * (train + valid))
    part = F.when(n < 3, "train").when(place <= first, "train").when(place <= second, "valid").otherwise("test")
    return unranked(ranked(df, strata, key, seed).withColumn("split", part))


def capped(df: DataFrame, stratum: str, caps: Mapping[str, int], key: str, seed: int = 42) -> DataFrame:
    """At most so many rows of each stratum; strata without a cap go."""
    cap = F.create_map(*(F.lit(x) for pair in caps.items() for x in pair))[F.col(stratum)]
    return unranked(ranked(df.filter(F.col(stratum).isin(*caps)), [stratum], key, seed).filter(F.col("_place") <= cap))


def share_capped(df: DataFrame, stratum: str, shares: Mapping[str, float], key: str, seed: int = 42) -> DataFrame:
    """At most such shares of all rows of each stratum, rounded down; strata without a share count among all rows and go."""
    share = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))[F.col(stratum)]
    return unranked(ranked(df, [stratum], key, seed).filter(F.col("_place") <= F.floor(F.col("_all") * share)))


def flagged(df: DataFrame, flag: Column, key: str, seed: int) -> DataFrame:
    """`df` ranked within the rows with and without a flag (null: without), which is _flag."""
    return ranked(df.withColumn("_flag", F.coalesce(flag, F.lit(False))), ["_flag"], key, seed)


def limit_share(df: DataFrame, flag: Column, share: float, key: str, seed: int = 42) -> DataFrame:
    """All rows without the flag, and so many with it that they are at most that share of what is kept."""
    rest = F.col("_all") - F.col("_of")
    most = F.when(F.col("_of") / F.col("_all") > share, F.floor(rest * (share / (1.0 - share)))).otherwise(F.col("_of"))
    return unranked(flagged(df, flag, key, seed).filter(~F.col("_flag") | (F.col("_place") <= most))).drop("_flag")


def raise_share(df: DataFrame, flag: Column, share: float, key: str, seed: int = 42) -> DataFrame:
    """All rows with the flag, and the others thinned until the flagged ones are about that share."""
    wanted = (F.col("_all") - F.col("_of")) / share
    most = F.when(F.col("_all") > wanted, F.floor(wanted * (1.0 - share))).otherwise(F.col("_of"))
    return unranked(flagged(df, flag, key, seed).filter(F.col("_flag") | (F.col("_place") <= most))).drop("_flag")


def limit_flagged(df: DataFrame, flag: Column, most: int, key: str, seed: int = 42) -> DataFrame:
    """All rows without the flag and at most so many with it."""
    return unranked(flagged(df, flag, key, seed).filter(~F.col("_flag") | (F.col("_place") <= most))).drop("_flag")


def edge_part(df: DataFrame, edge: Column, key: str, seed: int = 42, overflow: float = 0.15, keep: float = 0.1, back: float = 0.2) -> DataFrame:
    """`part` of each row, edge or main: edge cases beyond an overflow share are cut to a kept share of all rows,
    and a share of the kept ones, the first in seeded order, goes back to the main part."""
    kept = F.when(F.col("_of") > F.col("_all") * overflow, F.floor(F.col("_all") * keep)).otherwise(F.col("_of"))
    part = F.when(F.col("_flag") & (F.col("_place") <= kept) & (F.col("_place") > F.floor(kept * back)), "edge").otherwise("main")
    return unranked(flagged(df, edge, key, seed).withColumn("part", part)).drop("_flag")
