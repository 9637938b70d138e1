"""Chat posts that belong together merged into one message, as a stream and over a table.

A post opens an entry of its key (sender, else package). Posts of the same message within 1.5 s of its opening merge into it
and don't prolong it; a different post closes it and opens another. Time is that of arrival, so results can be repeated.

Posts carry id (orders equal times), arrived (timestamp), post_ms, package, sender, title, notification_key, parts, caption, file
and urls. Any may be null: texts count as missing, arrays as empty, a missing post_ms as 0; posts without arrival go.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Milliseconds that an entry stays open, and that posts of one message lie apart at most.
OPEN_MS, CLOSE_MS = 1500, 3500
TEXTS = ("package", "sender", "title", "notification_key", "caption", "file")
LISTS = ("parts", "urls")
MERGED = (
    "key string, opened_ms long, n_posts long, post_ms long, package string, sender string, title string, notification_key string, "
    "caption string, file string, parts array<string>, urls array<string>"
)


def post_rows(posts: DataFrame) -> DataFrame:
    """Posts with the columns that the fold reads."""
    arrived = F.unix_millis(F.col("arrived").cast("timestamp"))
    key = F.coalesce("sender", "package", F.lit(""))
    texts = (F.col(c).cast("string").alias(c) for c in TEXTS)
    lists = (F.array_compact(F.coalesce(F.col(c), F.array().cast("array<string>"))).alias(c) for c in LISTS)
    rows = posts.select(key.alias("key"), "arrived", arrived.alias("ms"), F.col("id").cast("long").alias("id"), F.coalesce(F.col("post_ms").cast("long"), F.lit(0)).alias("post_ms"), *texts, *lists)
    return rows.filter("arrived IS NOT NULL")


def as_posts(rows: pd.DataFrame) -> Iterator[dict]:
    """Plain values of each row."""
    for row in rows.to_dict("records"):
        post = {c: row[c] if isinstance(row[c], str) else None for c in TEXTS} | {c: list(row[c]) for c in LISTS}
        yield post | {"key": row["key"], "ms": int(row["ms"]), "post_ms": int(row["post_ms"])}


def comparable(post: dict) -> str:
    """All of a post's texts in lower case."""
    texts = [post["caption"], *post["parts"], post["file"], *post["urls"]]
    return " | ".join(t.lower() for t in texts if t is not None)


def same_message(old: dict, new: dict) -> bool:
    """Close in time, and the same notification, or of one sender and title with the same file or one text within the other."""
    if abs(old["post_ms"] - new["post_ms"]) > CLOSE_MS:
        return False
    if (old["notification_key"] or "").strip() and old["notification_key"] == new["notification_key"]:
        return True
    if (old["sender"], old["title"]) != (new["sender"], new["title"]):
        return False
    if (old["file"] or "").strip() and old["file"].lower() == (new["file"] or "").lower():
        return True
    a, b = comparable(old), comparable(new)
    return bool(a.strip() and b.strip()) and (a in b or b in a)


def distinct(texts: Iterable[str | None]) -> list[str]:
    return list(dict.fromkeys(t.strip() for t in texts if t and t.strip()))


def merge(old: dict, new: dict) -> dict:
    """Both posts as one: distinct parts and links, the newer value of the rest where there is one, the later time."""
    filled = {c: old[c] if new[c] is None else new[c] for c in TEXTS}
    filled["package"] = new["package"] if (new["package"] or "").strip() else old["package"]
    filled["caption"] = next((c for c in (new["caption"], old["caption"]) if c and c.strip()), None)
    parts = distinct([old["caption"], *old["parts"], new["caption"], *new["parts"]])
    return filled | {"parts": parts, "urls": distinct([*old["urls"], *new["urls"]]), "post_ms": max(old["post_ms"], new["post_ms"])}


def fold(entry: dict | None, posts: Iterable[dict], closed: list[dict]) -> dict | None:
    """The entry that is open after the posts, in order of arrival; entries closed on the way are added to `closed`."""
    for post in posts:
        if entry and entry["key"] == post["key"] and post["ms"] - entry["opened_ms"] < OPEN_MS and same_message(entry, post):
            entry = entry | merge(entry, post) | {"n_posts": entry["n_posts"] + 1}
            continue
        if entry:
            closed.append(entry)
        entry = {c: v for c, v in post.items() if c != "ms"} | {"opened_ms": post["ms"], "n_posts": 1}
    return entry


def frame(entries: list[dict]) -> pd.DataFrame:
    names = [part.split(" ")[0] for part in MERGED.split(", ")]
    return pd.DataFrame([[e[c] for c in names] for e in entries], columns=names)


def merge_table(posts: DataFrame) -> DataFrame:
    """Merged messages of a table. A task reads its keys in order and holds one open entry, however many posts a key has."""
    rows = post_rows(posts).drop("arrived")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entry = None
        for batch in batches:
            closed: list[dict] = []
            entry = fold(entry, as_posts(batch), closed)
            if closed:
                yield frame(closed)
        if entry:
            yield frame([entry])

    return rows.repartition("key").sortWithinPartitions("key", "ms", "id").mapInPandas(run, MERGED)


def merge_stream(posts: DataFrame, late: str = "5 seconds") -> DataFrame:
    """Merged messages of a stream, in append mode; an entry leaves once the watermark has passed its end.

    A key's state is its open entry. Posts of one batch go by arrival, then id; later ones than the watermark go.
    """

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entry = json.loads(state.get[0]) if state.exists else None
        closed: list[dict] = []
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values(["ms", "id"], kind="stable")
            entry = fold(entry, as_posts(rows), closed)
        mark = state.getCurrentWatermarkMs()
        if entry and (state.hasTimedOut or entry["opened_ms"] + OPEN_MS <= mark):
            closed.append(entry)
            entry = None
        if entry:
            state.update((json.dumps(entry),))
            state.setTimeoutTimestamp(entry["opened_ms"] + OPEN_MS)
        elif state.exists:
            state.remove()
        yield frame(closed)

    rows = post_rows(posts.withWatermark("arrived", late))
    return rows.groupBy("key").applyInPandasWithState(run, MERGED, "entry string", "append", GroupStateTimeout.EventTimeTimeout)
