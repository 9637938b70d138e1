"""Streams of messages and alerts: duplicates with a time to live, limits on alerts, routing, live counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Limits (accepted alerts, milliseconds) and the score from which chat messages raise alerts.
BURST = (10, 60_000)
FULL_SCREEN = (1, 10_000)
SPACING = (1, 3_000)
CHAT_THRESHOLD = 40


def drop_repeats(messages: DataFrame, keys: list[str], ts: str = "ts", ttl: str = "15 minutes") -> DataFrame:
    """First message of each key within the time to live, counted from the first; repeats don't prolong it. State is bounded by the watermark."""
    return messages.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def limit_alerts(alerts: DataFrame, key: str, event_id: str, limit: tuple[int, int], ts: str = "ts", edge: bool = True, late: str = "1 hour") -> DataFrame:
    """`key`, `event_id`, ts and accepted: at most so many accepted alerts per key in so many milliseconds.

    With `edge`, an accepted alert exactly as old as the window still counts. The state of a key is the times of its last
    accepted alerts, as many as the limit, and goes once the watermark, which follows by `late`, has passed the window of
    the last. Within a batch alerts go by time, then id; a late one is judged against what was accepted, one behind the
    watermark goes. Rows without a key share one state, rows without a time are refused. A task holds one key's rows of
    one batch: the source's rate per trigger bounds them.
    """
    most, span = limit

    def judge(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ms", "id"], kind="stable")
        accepted = []
        for ms in rows["ms"]:
            last = [t for t in last if ms - t < span or (edge and ms - t == span)]
            accepted.append(len(last) < most)
            if accepted[-1]:
                last.append(int(ms))
        state.update((last,))
        if last:
            state.setTimeoutTimestamp(max(max(last) + span, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"key": [group[0]] * len(rows), "id": rows["id"], "ms": rows["ms"], "accepted": accepted})

    time = F.col(ts).cast("timestamp")
    columns = F.col(key).cast("string").alias("key"), F.col(event_id).cast("long").alias("id"), F.unix_millis(time).alias("ms")
    timed = alerts.filter(time.isNotNull()).select(*columns, time.alias("_time")).withWatermark("_time", late)
    judged = timed.groupBy("key").applyInPandasWithState(
        judge, "key string, id long, ms long, accepted boolean", "last array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return judged.unionByName(alerts.filter(time.isNull()).select(*columns, F.lit(False).alias("accepted")))


def route(score: Column, channel: Column, threshold: Column | None = None) -> Column:
    """Where an alert goes: 'persistent' from 40 to 69, 'security' from 70 on, null below the threshold.

    SMS goes by the user's threshold (40 where there is none), chat by 40. An SMS below 40 that passes a lower threshold
    goes to the security path, which rejects it: 'rejected'.
    """
    least = F.when(channel == "sms", F.coalesce(threshold, F.lit(CHAT_THRESHOLD)) if threshold is not None else CHAT_THRESHOLD).otherwise(CHAT_THRESHOLD)
    return F.when(score >= least, F.when(score >= 70, "security").when(score >= 40, "persistent").otherwise("rejected"))


def enrich_chat(score: Column, attachment: Column, scam_words: Column, curiosity: Column, link: Column) -> Column:
    """Score of a chat message: 40 more for an attachment, 30 for scam words, and 50 or 40 for curiosity with a file or else a link."""
    lure = F.when(curiosity & attachment, 50).when(curiosity & link, 40).otherwise(0)
    total = score + F.when(attachment, 40).otherwise(0) + F.when(scam_words, 30).otherwise(0) + lure
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def live_counts(history: DataFrame, score: str = "score") -> DataFrame:
    """Total and counts by band in one aggregate; as a stream, run it in complete or update mode."""
    s = F.col(score)
    return history.groupBy().agg(
        F.count("*").alias("total"),
        F.count_if(s < 40).alias("safe"),
        F.count_if((s >= 40) & (s < 70)).alias("suspicious"),
        F.count_if(s >= 70).alias("danger"),
    )


def joined_parts(parts: DataFrame, ts: str | None = None, open_for: str = "1 hour") -> DataFrame:
    """One message per message_id from its numbered parts; blank messages go, a missing sender is 'Unknown'.

    With a time column `ts`, for streams in append mode: the parts of a message come within `open_for` of its first, and
    the message leaves once the watermark is past that.
    """
    body = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "body"))), lambda p: F.coalesce(p["body"], F.lit(""))), ""))
    by = ["message_id"]
    if ts is not None:
        parts = parts.withWatermark(ts, open_for)
        by.append(F.session_window(ts, open_for))
    rows = parts.groupBy(*by).agg(body.alias("text"), F.min("sender").alias("sender"))
    return rows.filter("text != ''").withColumn("sender", F.coalesce(F.nullif(F.trim("sender"), F.lit("")), F.lit("Unknown")))
