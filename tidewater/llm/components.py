"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import join_counted, put, remove


def star(links: DataFrame, n_links: int, large: bool) -> tuple[DataFrame, str]:
    """Distinct new edges (a, b), a > b: the neighbours `b` of each `a` tied to the smallest of them and itself.

    A large star ties the larger neighbours alone. A small star gets none but smaller ones, and ties the node
    too. Nodes with very many neighbours are tied where their links are, by join_counted. The smallest neighbours are
    written, as they are read several times; their folder can go once the edges are written.
    """
    smallest = links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"), F.count("*").alias("_n"))
    path = put(smallest, "least")
    least = links.sparkSession.read.schema(smallest.schema).parquet(path)
    tied = join_counted(links, least, "a", n_links)
    kept = tied.filter(F.col("b") > F.col("a")) if large else tied
    out = kept.select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not large:
        out = out.union(least.select("a", F.col("least").alias("b")))
    return out.filter("a <> b").distinct(), path


def least_reachable(edges: DataFrame) -> DataFrame:
    """node and `least`, the smallest node of its component, for each node of the edges (a, b) of longs.

    Alternates a large and a small star until neither changes an edge. Both keep the components, and end
    with each node tied to the smallest; the rounds grow with the logarithm of the nodes. Each step is one
    grouping and one join by node, and is written to the shared folder, where the step before is deleted.
    """
    spark = edges.sparkSession
    last_path = None

    def step(table: DataFrame) -> tuple[DataFrame, tuple]:
        """`table` written, with its number of rows and a checksum."""
        nonlocal last_path
        path = put(table, "edges")
        out = spark.read.schema("a long, b long").parquet(path)
        told = tuple(out.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        if last_path is not None:
            remove(spark, last_path)
        last_path = path
        return out, told

    current, told = step(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while told[0]:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large, large_path = star(both, 2 * told[0], True)
        larger, now = step(large)
        small, small_path = star(larger, now[0], False)
        current, now = step(small)
        for path in (large_path, small_path):
            remove(spark, path)
        if now == told:
            break
        told = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("least"))
