"""Bounded state by key: an id registry, the limiter of persistent alerts, and the cache of messages seen.

Each is a stateful processor over a stream with a watermark. A key is a device: its rows of a batch are taken in order of
time, then id, and its state is bounded by the rules themselves. Rows without a time get a null result at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: First number, age in milliseconds, and size of the registry; spacing, band and number of persistent
#: alerts; age and size of the cache, and how many leave it at once.
FIRST_NUMBER, REGISTRY_MS, REGISTRY_MOST = 10_000, 24 * 60 * 60 * 1000, 200
SPACING_MS, BAND, ACTIVE_MOST = 3_000, (40, 70), 3
CACHE_MS, CACHE_MOST, CACHE_EVICTED = 15 * 60 * 1000, 200, 50
#: Groups that messages are dealt into by hash.
MESSAGE_GROUPS = 1024
#: Columns that every processor reads.
INPUT = ("device", "id", "ms", "action", "item", "score")
NAMES = "item string"
NUMBER = "n long"


class Ordered(StatefulProcessor):
    """Takes the rows of a key in order; `judge` gives the result of one."""

    result = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: When each item was last seen or registered.
        self.seen = handle.getMapState("seen", NAMES, "ms long, n long")
        self.count = handle.getValueState("count", NUMBER)

    def judge(self, held: dict[str, tuple[int, int]], row, counter: int) -> tuple[object, int]:
        raise NotImplementedError

    def lifetime(self) -> int | None:
        """Milliseconds after which an item can't change a result; None: never."""
        return None

    def held(self) -> dict[str, tuple[int, int]]:
        return {key[0]: (value[0], value[1]) for key, value in self.seen.iterator()} if self.seen.exists() else {}

    def keep(self, before: dict, after: dict, counter: int) -> None:
        """Writes what changed, and sets a timer for the last of what expires."""
        for item in before.keys() - after.keys():
            self.seen.removeKey((item,))
        for item, value in after.items():
            if before.get(item) != value:
                self.seen.updateValue((item,), value)
        self.count.update((counter,))
        if self.lifetime() is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if after:
                self.handle.registerTimer(min(ms for ms, _ in after.values()) + self.lifetime() + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["ms", "id"], kind="stable")
        before = self.held()
        held, counter = dict(before), self.count.get()[0] if self.count.exists() else 0
        told = []
        for row in every.itertuples(index=False):
            result, counter = self.judge(held, row, counter)
            told.append((key[0], int(row.id), int(row.ms), result))
        self.keep(before, held, counter)
        yield pd.DataFrame(told, columns=["device", "id", "ms", self.result])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Frees what has expired by the watermark; rows to come are later, so no result depends on it."""
        before, now = self.held(), expiredTimerInfo.getExpiryTimeInMs()
        held = {item: value for item, value in before.items() if now - value[0] <= self.lifetime()}
        self.keep(before, held, self.count.get()[0] if self.count.exists() else 0)
        yield pd.DataFrame({"device": [], "id": [], "ms": [], self.result: []})

    def close(self) -> None:
        pass


class IdRegistry(Ordered):
    """Numbers for items: an item that is registered keeps its number, and registering it again renews its age.

    Items older than `age_ms` are gone; if a new one makes more than `most`, the oldest leave (ties: the smaller number).
    The action 'remove' takes an item out and gives its number, null if it had none. Numbers are never given twice.
    """

    result = "number"

    def __init__(self, most: int = REGISTRY_MOST, age_ms: int = REGISTRY_MS) -> None:
        self.most, self.age_ms = most, age_ms

    def lifetime(self) -> int:
        return self.age_ms

    def judge(self, held, row, counter):
        now = int(row.ms)
        for item in [i for i, (ms, _) in held.items() if now - ms > self.age_ms]:
            del held[item]
        if row.action == "remove":
            return held.pop(row.item, (None, None))[1], counter
        if row.item in held:
            number = held[row.item][1]
        else:
            number, counter = FIRST_NUMBER + counter, counter + 1
        held[row.item] = (now, number)
        while len(held) > self.most:
            del held[min(held, key=lambda i: held[i])]
        return number, counter


class PersistentLimiter(Ordered):
    """Verdicts on alerts of the middle band: 'band' outside it, 'spacing' within 3 s of the last that came as far as
    this rule, 'full' while three are active, 'duplicate' if active already, else 'shown', and active until 'remove'.

    An alert that is refused as full or duplicate still moves the clock of the spacing.
    """

    result = "verdict"

    def __init__(self, most: int = ACTIVE_MOST, spacing_ms: int = SPACING_MS) -> None:
        self.most, self.spacing_ms = most, spacing_ms

    def judge(self, held, row, last):
        if row.action == "remove":
            return "removed" if held.pop(row.item, None) else "unknown", last
        if pd.isna(row.score) or not BAND[0] <= row.score < BAND[1]:
            return "band", last
        now = int(row.ms)
        if last and now - last < self.spacing_ms:
            return "spacing", last
        if len(held) >= self.most:
            return "full", now
        if row.item in held:
            return "duplicate", now
        held[row.item] = (now, 0)
        return "shown", now


class SeenCache(Ordered):
    """Whether a message was seen in the last 15 minutes, counted from its first time; repeats don't prolong it.

    Before each message those that are older leave the cache, and then, if it holds more than `most`, its oldest
    `evicted` (ties: the smaller key).
    """

    result = "repeated"

    def __init__(self, most: int = CACHE_MOST, evicted: int = CACHE_EVICTED, age_ms: int = CACHE_MS) -> None:
        self.most, self.evicted, self.age_ms = most, evicted, age_ms

    def lifetime(self) -> int:
        return self.age_ms

    def judge(self, held, row, counter):
        now = int(row.ms)
        for item in [i for i, (ms, _) in held.items() if now - ms > self.age_ms]:
            del held[item]
        if len(held) > self.most:
            for item in sorted(held, key=lambda i: (held[i][0], i))[: self.evicted]:
                del held[item]
        repeated = row.item in held
        if not repeated:
            held[row.item] = (now, 0)
        return repeated, counter


class MessageRepeats(StatefulProcessor):
    """Whether a message was seen within `age_ms` of its first time; repeats don't prolong it.

    A key is a group of messages, whose first times are one value: reading and writing state costs a round trip a group
    of a batch, not several a message. What has expired by the watermark leaves with the next rows or by a timer.
    """

    def __init__(self, age_ms: int = CACHE_MS) -> None:
        self.age_ms = age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "firsts string")

    def held(self) -> dict[str, int]:
        return json.loads(self.seen.get()[0]) if self.seen.exists() else {}

    def keep(self, held: dict[str, int], now: int) -> None:
        held = {message: first for message, first in held.items() if now - first <= self.age_ms}
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.seen.update((json.dumps(held),))
            self.handle.registerTimer(max(held.values()) + self.age_ms + 1)
        else:
            self.seen.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["ms", "id"], kind="stable")
        held, told = self.held(), []
        for message, ms in zip(every["device"], every["ms"].tolist()):
            first = held.get(message)
            told.append(first is not None and ms - first <= self.age_ms)
            if not told[-1]:
                held[message] = ms
        self.keep(held, timerValues.getCurrentWatermarkInMs())
        yield every[["device", "id", "ms"]].assign(repeated=told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.keep(self.held(), expiredTimerInfo.getExpiryTimeInMs())
        yield pd.DataFrame({"device": [], "id": [], "ms": [], "repeated": []})

    def close(self) -> None:
        pass


def stream_rows(stream: DataFrame, device: Column, row_id: Column, ts: str, item: Column, action: Column | None = None, score: Column | None = None) -> DataFrame:
    """The columns that processors read; missing devices and items are empty strings. Rows without a time go."""
    return stream.filter(F.col(ts).isNotNull()).select(
        F.coalesce(device.cast("string"), F.lit("")).alias("device"),
        row_id.cast("long").alias("id"),
        F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"),
        (F.lit("add") if action is None else action).alias("action"),
        F.coalesce(item.cast("string"), F.lit("")).alias("item"),
        (F.lit(None) if score is None else score).cast("double").alias("score"),
        F.col(ts).cast("timestamp").alias("_time"),
    )


def judged(rows: DataFrame, processor: Ordered, kind: str, late: str = "1 hour") -> DataFrame:
    """device, id, ms and the processor's result (of type `kind`) of each row of `stream_rows`, in append mode."""
    marked = rows.withWatermark("_time", late).groupBy("device")
    return marked.transformWithStateInPandas(processor, f"device string, id long, ms long, {processor.result} {kind}", "append", "eventTime")


def repeats(rows: DataFrame, age_ms: int = CACHE_MS, groups: int = MESSAGE_GROUPS, late: str = "1 hour") -> DataFrame:
    """device, id, ms and repeated of each row of `stream_rows` whose device is a message, in append mode."""
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("device"), F.lit(groups)).cast("int"))
    marked = dealt.withWatermark("_time", late).groupBy("_group")
    return marked.transformWithStateInPandas(MessageRepeats(age_ms), "device string, id long, ms long, repeated boolean", "append", "eventTime")
