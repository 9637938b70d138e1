"""Repeats of messages with state by groups of messages, against plain Python, the stream stopped between slices."""

import random

from pyspark.sql import functions as F

from tidewater.streaming import limits
from tidewater.streaming.replay import replayed

START = 1_704_067_200_000


def test_repeats_by_groups_of_messages(spark):
    rng, ms, rows, first, want = random.Random(3), START, [], {}, {}
    for i in range(300):
        ms += rng.choice([0, 1, 500, 1_000, 2_500, 40_000 if i % 50 == 0 else 0])
        rows.append((rng.choice([None, *(f"m{k}" for k in range(12))]), i, ms))
    for message, i, at in rows:
        want[i] = message in first and at - first[message] <= 5_000
        if not want[i]:
            first[message] = at
    stream = spark.createDataFrame(rows, "message string, id long, ms long").withColumn("at", F.timestamp_millis("ms"))
    build = lambda s: limits.repeats(limits.stream_rows(s, F.col("message"), F.col("id"), "at", F.lit("")), 5_000, 3, "1 second")
    found = replayed(stream, "at", build, 3).collect()
    assert len(found) == 300 and {r["id"]: r["repeated"] for r in found} == want
    assert {r["device"] for r in found} == {m or "" for m, _, _ in rows}
