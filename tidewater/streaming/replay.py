"""Tables replayed as streams: slices in order of a time column, the query stopped and started again after each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidewater.session import scratch

#: State of `transformWithState` lives in this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def cut_points(rows: DataFrame, ts: str, slices: int) -> list[int]:
    """Milliseconds that part the time of `rows` into slices of equal length."""
    first, last = rows.agg(*(F.unix_millis(f(F.col(ts).cast("timestamp"))) for f in (F.min, F.max))).first()
    return [] if first is None else [first + (last - first) * k // slices for k in range(1, slices)]


def replay(rows: DataFrame, ts: str, start: Callable[[DataFrame, str], DataStreamWriter], slices: int = 3, after: list[DataFrame] | None = None) -> None:
    """Feeds `rows` to a streaming query, a slice of time after the other, then the tables `after` one by one.

    `start` makes the writer of the query from the stream and a checkpoint folder. Each slice is appended to the folder
    that the stream reads, and the query runs until it has read all: so it stops after each slice and takes up its
    state and its place in the input from the checkpoint again. Rows without a time come with the first slice.
    """
    spark = rows.sparkSession
    folder = scratch(spark, "replay")
    ms = F.coalesce(F.unix_millis(F.col(ts).cast("timestamp")), F.lit(-(1 << 62)))
    ends = [-(1 << 63), *cut_points(rows, ts, slices), (1 << 63) - 1]
    parts = [rows.filter((ms >= low) & (ms < high)) for low, high in zip(ends, ends[1:])]
    for part in parts + (after or []):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        run(start(stream, f"{folder}/checkpoint"))


def run(writer: DataStreamWriter) -> StreamingQuery:
    """Runs a streaming query over all there is to read, with the state store that it needs."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def replayed(rows: DataFrame, ts: str, build: Callable[[DataFrame], DataFrame], slices: int = 3, after: list[DataFrame] | None = None) -> DataFrame:
    """What the stream `build` appends to a table of files while `rows` are replayed."""
    spark = rows.sparkSession
    out = scratch(spark, "stream")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    schema = {}

    def start(stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        made = build(stream)
        schema["out"] = made.schema
        return made.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)

    try:
        replay(rows, ts, start, slices, after)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(schema["out"]).parquet(out)
