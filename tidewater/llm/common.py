"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space besides the blank, ASCII capitals.
OTHER_SPACES = "\t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(text: Column) -> Column:
    """The runs of characters other than \\x20 and \\x09-\\x0D; null text has none."""
    blanks = F.coalesce(text, F.lit(""))
    for space in OTHER_SPACES:
        blanks = F.replace(blanks, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(blanks, " "), "")


def window_hash(words: Column, at: Column, length: int) -> Column:
    """The 64-bit hash of `length` words from place `at` (from 0). Reads each word in place: slice() would copy the text."""
    return F.xxhash64(*(F.get(words, at + k) for k in range(length)))


def let(value: Column, body) -> Column:
    """`body` of `value`, which is computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def boxed(docs: DataFrame, *apart: str | Column) -> DataFrame:
    """The columns `apart` (names, or columns that are made of docs), and all others as one struct `row`, so that no name of theirs meets one of an operator's."""
    names = {a for a in apart if isinstance(a, str)}
    others = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in names]
    return docs.select(*apart, F.struct(*others, *([] if others else [F.lit(True).alias("none")])).alias("row"))


def unboxed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a table that was boxed, in their order."""
    within = rows.schema["row"].dataType.names
    return rows.select(*(F.col("row").getField(c).alias(c) if c in within else F.col(c) for c in columns))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder. Where none is configured, one of this machine for a
    session that runs in this process alone; any other session has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def put(df: DataFrame, name: str) -> str:
    """Writes `df` to a new folder and returns its path."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: a short lineage that outlives lost executors."""
    path = put(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that `put` wrote and nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: A key is hot if it has more than HOT_ROWS rows and more than that share of all: there are at most 1 / HOT_SHARE.
HOT_SHARE, HOT_ROWS = 0.001, 1_000


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, n_rows: int) -> DataFrame:
    """`rows` (n_rows of them) joined to `keyed`, which has each key once, with its number of rows in `_n`.

    Hot keys would send all their rows to one task. They are few, so what belongs to them is broadcast, and
    their rows stay where they are; the other rows are joined by a shuffle. Both tables are read for each
    of the two ways, so they should be written ones.
    """
    most = max(HOT_ROWS, int(HOT_SHARE * n_rows))
    hot = keyed.filter(F.col("_n") > most).drop("_n")
    cold = keyed.filter(F.col("_n") <= most).drop("_n")
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(others.join(cold, key))


def release_memory() -> None:
    """Gives freed memory, Arrow's too, back to the system at the end of a task, whose worker goes on to serve others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
