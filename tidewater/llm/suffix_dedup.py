"""Exact removal of repeated byte strings across documents, by suffix arrays of shards.

A string of 50 bytes is filed under its anchor: the one of its 24-byte substrings that has the least hash,
the leftmost of equals. Equal strings have equal anchors and so meet in one shard; strings that follow
each other and share an anchor are filed as one record of 50 to 76 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import boxed, release_memory, unboxed
from tidewater.llm.suffix_array import permuted_prefixes, suffix_array
from tidewater.session import load

#: Bytes of a match and of an anchor, and anchors in a match.
MATCH, ANCHOR = 50, 24
SPAN = MATCH - ANCHOR + 1
#: Bytes of text that a task works on at once; longer documents are cut into overlapping pieces.
PIECE = 1 << 20
#: Positions take the lower bits when anchors are compared, hashes the upper.
PLACE_BITS = 28
#: Odd multipliers for hashing.
M1, M2, M3, M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def cut(docs: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """Pieces of about PIECE bytes: (document, offset in it, start in the piece) of each segment, and the bytes."""
    where: list[tuple[int, int, int]] = []
    parts: list[bytes] = []
    size = 0

    def close():
        d, o, s = (np.array(x, np.int64) for x in zip(*where))
        return d, o, s, b"".join(parts)

    for d, data in enumerate(docs):
        for offset in range(0, max(1, len(data) - MATCH + 1), PIECE):
            segment = data[offset : offset + PIECE + MATCH - 1]
            if len(segment) < MATCH:
                continue
            where.append((d, offset, size))
            parts.append(segment)
            size += len(segment)
            if size >= PIECE:
                yield close()
                where, parts, size = [], [], 0
    if where:
        yield close()


#: Places of a piece that are hashed at once: what a hash needs is several times as long as the text.
BLOCK = 1 << 16


def hashed(words: np.ndarray, middle: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of anchors by their 8 bytes each at 0, 8 and 16."""
    hashes = words * M1
    hashes += middle * M2
    hashes ^= hashes >> np.uint64(31)
    hashes += last * M3
    hashes ^= hashes >> np.uint64(29)
    hashes *= M4
    hashes ^= hashes >> np.uint64(32)
    return hashes


def anchors_of(words: np.ndarray, n: int) -> np.ndarray:
    """The anchor's start of each of the `n` strings of a piece; words: the 8 bytes from each place on."""
    anchors = np.empty(n, np.int32)
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n) + SPAN - 1
        least = hashed(words[a:b], words[a + 8 : b + 8], words[a + 16 : b + 16])
        least &= ~np.uint64((1 << PLACE_BITS) - 1)
        least |= np.arange(a, b, dtype=np.uint64)
        for step in (1, 2, 4, 8):
            least = np.minimum(least[:-step], least[step:])
        least = np.minimum(least[: -(SPAN - 16)], least[SPAN - 16 :])
        anchors[a : a + BLOCK] = least & np.uint64((1 << PLACE_BITS) - 1)
    return anchors


def records(starts: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, end, anchor's start, key) of each record of a piece; key: 40 bits of the anchor's hash."""
    text = np.frombuffer(data + bytes(8), np.uint8)
    words = np.lib.stride_tricks.as_strided(text[:8].view("<u8"), (len(data), ), (1,))
    anchors = anchors_of(words, len(data) - MATCH + 1)
    # Strings that lie in one segment.
    ends = np.append(starts[1:], len(data))
    step = np.zeros(len(anchors) + 1, np.int8)
    step[starts] = 1
    step[ends - MATCH + 1] = -1
    inside = np.cumsum(step, dtype=np.int8)[: len(anchors)] > 0
    change = np.ones(len(anchors), bool)
    change[1:] = (anchors[1:] != anchors[:-1]) | ~inside[:-1]
    begin = np.flatnonzero(change & inside)
    stop = np.ones(len(anchors), bool)
    stop[:-1] = change[1:] | ~inside[1:]
    end = np.flatnonzero(stop & inside) + MATCH
    anchor = anchors[begin].astype(np.int64)
    key = (hashed(words[anchor], words[anchor + 8], words[anchor + 16]) * M1) >> np.uint64(24)
    return np.searchsorted(starts, begin, "right") - 1, begin, end, anchor, key


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))


def pack_keys(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def merge(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each owner (small numbers), overlapping and adjoining ones merged, in order."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    if not len(owner):
        return owner, start, end
    shift = owner.astype(np.int64) << 33
    reach = np.maximum.accumulate(shift + end)
    fresh = np.concatenate(([True], shift[1:] + start[1:] > reach[:-1]))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], start[first], reach[last] - shift[first]


def span_rows(docs: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(document, spans as pairs of 32-bit numbers) for each document that has spans."""
    names, owner = np.unique(docs, return_inverse=True)
    owner, start, end = merge(owner, start, end)
    pairs = np.stack((start, end), 1).astype("<u4")
    cuts = runs(owner)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(names[owner[a]]), pairs[a:b].tobytes()


def frame(rows: list[tuple[int, int | None, bytes]], dealt_by: str) -> pd.DataFrame:
    """Rows that are told to a document have `direct`; the others have 0 for it (a null would make pandas round the names)."""
    dealt, docs, data = zip(*rows)
    return pd.DataFrame({dealt_by: dealt, "direct": [x is not None for x in docs], "doc": [x or 0 for x in docs], "data": data})


#: Keys that a task remembers while it files keys, one a place; and bits of a key.
REMEMBERED, KEY_BITS = 1 << 19, 40


def new_memory(size: int = REMEMBERED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places for `size` keys (a power of two): the key, the document that was sent with it, and whether several have it."""
    return np.full(size, np.iinfo(np.uint64).max), np.zeros(size, np.int64), np.zeros(size, bool)


def sent_before(memory: tuple[np.ndarray, ...], key: np.ndarray, name: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which of distinct keys, with the name of a document each, a task has sent already; and keys and names to be told.

    A key that is met again needs no second row in its bucket: where its documents differ both are told. The
    others are remembered. A place whose key several documents have is kept, so that a key which is in every
    piece of a corpus is sent about once a task; all others may be taken by later keys.
    """
    keys, names, hot = memory
    at = (key >> np.uint64(KEY_BITS - (len(keys).bit_length() - 1))).astype(np.int64)
    known = keys[at] == key
    again = known & (names[at] != name)
    first = again & ~hot[at]
    told = np.concatenate((key[again], key[first])), np.concatenate((name[again], names[at[first]]))
    hot[at[again]] = True
    free = ~known & ~hot[at]
    place = at[free]
    keys[place], names[place], hot[place] = key[free], name[free], several[free]
    return known, *told


def nominate(batches: Iterator[pd.DataFrame], n_buckets: int, remembered: int = REMEMBERED) -> Iterator[pd.DataFrame]:
    """Files the keys of each document in buckets. Keys that a piece has in several documents, or that the task
    has met in another one, are told to them at once (rows with `doc`); to its bucket a piece sends only
    keys that the task does not remember to have sent, each but once."""
    memory = new_memory(remembered)
    for batch in batches:
        names = batch["_tw_key"].to_numpy(np.int64)
        for doc, _, starts, data in cut(t.encode("utf-8", "surrogatepass") for t in batch["text"]):
            segment, _, _, _, key = records(starts, data)
            owner = doc[segment]
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            key, owner = key[fresh], owner[fresh]
            cuts = runs(key)
            several = np.diff(cuts) > 1
            shared = np.repeat(several, np.diff(cuts))
            told_key, told = key[shared], names[owner[shared]]
            key, owner = key[cuts[:-1]], owner[cuts[:-1]]
            known, more_keys, more = sent_before(memory, key, names[owner], several)
            told_key, told = np.concatenate((told_key, more_keys)), np.concatenate((told, more))
            out = []
            by_doc = np.argsort(told, kind="stable")
            told_key, told = told_key[by_doc], told[by_doc]
            ends = runs(told)
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                name = int(told[a])
                out.append((name % n_buckets, name, pack_keys(told_key[a:b])))
            key, owner = key[~known], owner[~known]
            bucket = (key % np.uint64(n_buckets)).astype(np.int64)
            order = np.lexsort((owner, bucket))
            key, owner, bucket = key[order], owner[order], bucket[order]
            ends = runs(bucket)
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                within = runs(owner[a:b])
                counts, docs = np.diff(within), names[owner[a:b][within[:-1]]]
                head = np.array([len(docs)], "<u4").tobytes() + docs.astype("<i8").tobytes() + counts.astype("<u4").tobytes()
                out.append((int(bucket[a]), None, head + pack_keys(key[a:b])))
            if out:
                yield frame(out, "bucket")


def shared_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The keys of a partition's buckets that several documents have, told to each of these. Keys are sorted
    by ranges, since a sort takes several times the memory of what it sorts."""
    keys, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for batch in batches:
        told = batch[batch["direct"]]
        if len(told):
            yield told[["doc", "data"]]
        for data in batch.loc[~batch["direct"], "data"]:
            n = int.from_bytes(data[:4], "little")
            docs.append(np.repeat(np.frombuffer(data, "<i8", n, 4), np.frombuffer(data, "<u4", n, 4 + 8 * n)))
            keys.append(unpack_keys(data[4 + 12 * n :]))
    # Each list goes before the next is joined.
    key = np.concatenate(keys)
    keys.clear()
    doc = np.concatenate(docs)
    docs.clear()
    found = [shared_among(key[part], doc[part]) for part in ranges(key)]
    if not found:
        return
    del key, doc
    key, doc = (np.concatenate(x) for x in zip(*found))
    found.clear()
    order = np.argsort(doc, kind="stable")
    key, doc = key[order], doc[order]
    del order
    cuts = runs(doc)
    rows = [(int(doc[a]), pack_keys(key[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    yield pd.DataFrame(rows, columns=["doc", "data"])


#: Keys that are sorted at once, about.
SORTED = 1 << 17


def ranges(key: np.ndarray) -> Iterator[np.ndarray]:
    """Where in `key` the keys of each range are, in order; ranges by the keys' upper bits, of about SORTED keys each."""
    bits = (len(key) // SORTED).bit_length()
    upper = (key >> np.uint64(KEY_BITS - bits)).astype(np.uint32)
    for value in range(1 << bits if len(key) else 0):
        yield np.flatnonzero(upper == value)


def shared_among(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys that several documents have, each with each of these."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    cuts = runs(key)
    several = np.repeat(doc[cuts[:-1]] != doc[cuts[1:] - 1], np.diff(cuts))
    return key[several], doc[several]


def file_records(batches: Iterator[pd.DataFrame], n_shards: int) -> Iterator[pd.DataFrame]:
    """Files the records under shared keys in shards. Of equal records of a piece, only those of the
    smallest id go on; the others are spans to be removed at once (rows with `doc`)."""
    for batch in batches:
        names, ids = batch["_tw_key"].to_numpy(np.int64), batch["_tw_id"].to_numpy(np.int64)
        told = [np.unique(unpack_keys(b"".join(x))) for x in batch["_tw_told"]]
        wanted = np.concatenate([*told, np.empty(0, np.uint64)])
        wanted |= np.repeat(np.arange(len(told), dtype=np.uint64), list(map(len, told))) << np.uint64(40)
        for doc, offset, starts, data in cut(t.encode("utf-8", "surrogatepass") for t in batch["text"]):
            segment, begin, end, anchor, key = records(starts, data)
            full = key | doc[segment].astype(np.uint64) << np.uint64(40)
            at = np.minimum(np.searchsorted(wanted, full), max(0, len(wanted) - 1))
            good = wanted[at] == full if len(wanted) else np.zeros(len(full), bool)
            segment, begin, end, anchor, key = (x[good] for x in (segment, begin, end, anchor, key))
            owner = doc[segment]
            place = begin - starts[segment] + offset[segment]
            length = end - begin
            content = [data[a:b] for a, b in zip(begin.tolist(), end.tolist())]
            seen: dict[bytes, int] = {}
            same = np.fromiter((seen.setdefault(x, len(seen)) for x in content), np.int64, len(content))
            least = np.full(len(seen), np.iinfo(np.int64).max)
            np.minimum.at(least, same, ids[owner])
            later = ids[owner] > least[same]
            out = [(name % n_shards, name, x) for name, x in span_rows(names[owner[later]], place[later], (place + length)[later])]
            stay = np.flatnonzero(~later)
            shard = (key[stay] % np.uint64(n_shards)).astype(np.int64)
            stay = stay[np.argsort(shard, kind="stable")]
            shard = np.sort(shard)
            cuts = runs(shard)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = stay[a:b]
                head = (
                    np.array([b - a], "<u4"), ids[owner[part]].astype("<i8"), names[owner[part]].astype("<i8"), place[part].astype("<u4"),
                    (key[part] >> np.uint64(8)).astype("<u4"), (anchor - begin)[part].astype(np.uint8), length[part].astype(np.uint8),
                )
                out.append((int(shard[a]), None, b"".join([*(x.tobytes() for x in head), *(content[i] for i in part.tolist())])))
            if out:
                yield frame(out, "shard")


#: Ids, names, places, keys (their upper 32 bits), anchors and lengths of packed records.
RECORD = ("<i8", "<i8", "<u4", "<u4", "u1", "u1")
#: What parts records in a shard's text; bytes follow from 2 up, 0 ends the text.
APART = 1


def matches(content: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(record, offset) of each 50-byte string that also is in a record with a smaller id, by a suffix array."""
    lengths = np.fromiter(map(len, content), np.int64, len(content))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    raw = np.frombuffer(b"\0".join([*content, b""]), np.uint8)
    text = raw.astype(np.int64) + 2
    text[starts + lengths] = APART
    text = np.append(text, 0)
    array = suffix_array(text, 258, APART)
    record = np.repeat(np.arange(len(content)), lengths + 1)
    left = np.append((starts + lengths)[record] - np.arange(len(record)), 0)
    common = permuted_prefixes(text, array, left, MATCH)
    # Neighbours in the array with 50 bytes in common form groups.
    ordered = common[array] >= MATCH
    group = np.cumsum(~ordered)
    at = np.flatnonzero(left[array] >= MATCH)
    group, places = group[at], array[at]
    cuts = runs(group)
    if len(cuts) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    owner = record[places]
    least = np.repeat(np.minimum.reduceat(ids[owner], cuts[:-1]), np.diff(cuts))
    later = ids[owner] > least
    return owner[later], places[later] - starts[owner[later]]


def candidates(content: list[bytes], keys: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """The records that can have a match: a common string of 50 bytes around an anchor of 24 has 13 more
    of them on its left or on its right, so another record has the same anchor with those."""
    reach = (MATCH - ANCHOR) // 2
    side = np.zeros((2, len(content)), np.int64)
    for i in np.flatnonzero(np.isin(keys, [k for k, n in zip(*np.unique(keys, return_counts=True)) if n > 1])).tolist():
        a, data = int(anchors[i]), content[i]
        if a >= reach:
            side[0, i] = hash(data[a - reach : a + ANCHOR]) or 1
        if a + ANCHOR + reach <= len(data):
            side[1, i] = hash(data[a : a + ANCHOR + reach]) or 1
    keep = np.zeros(len(content), bool)
    for hashes in side:
        values, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        keep |= (hashes != 0) & (counts[inverse] > 1)
    return np.flatnonzero(keep)


def unpack_spans(docs: np.ndarray, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of each span."""
    pairs = np.frombuffer(b"".join(spans), "<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(docs, [len(x) // 8 for x in spans]), pairs[:, 0], pairs[:, 1]


def pack_spans(docs: np.ndarray, start: np.ndarray, end: np.ndarray, n_buckets: int) -> pd.DataFrame:
    """A row for each bucket of documents: their spans, merged."""
    rows: dict[int, list[tuple[int, bytes]]] = {}
    for doc, data in span_rows(docs, start, end):
        rows.setdefault(doc % n_buckets, []).append((doc, data))
    packed = []
    for bucket, each in rows.items():
        names, data = zip(*each)
        head = np.array([len(names)], "<u4").tobytes() + np.array(names, "<i8").tobytes()
        packed.append((bucket, head + np.array([len(x) for x in data], "<u4").tobytes() + b"".join(data)))
    return pd.DataFrame(packed, columns=["bucket", "data"])


def gather_spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each document of a partition's buckets: all its spans, merged."""
    docs, spans = [np.empty(0, np.int64)], []
    for batch in batches:
        for data in batch.loc[batch["bucket"] >= 0, "data"]:
            n = int.from_bytes(data[:4], "little")
            docs.append(np.frombuffer(data, "<i8", n, 4))
            ends = 4 + 12 * n + np.cumsum(np.frombuffer(data, "<u4", n, 4 + 8 * n), dtype=np.int64)
            spans += [data[a:b] for a, b in zip([4 + 12 * n, *ends[:-1].tolist()], ends.tolist())]
    rows = list(span_rows(*unpack_spans(np.concatenate(docs), spans)))
    if rows:
        yield pd.DataFrame(rows, columns=["doc", "_tw_spans"])


def read_records(data: bytes) -> tuple[list[np.ndarray], list[bytes]]:
    """ids, names, places, keys, anchors and lengths of packed records, and their contents."""
    n, at = int.from_bytes(data[:4], "little"), 4
    parts = []
    for kind in RECORD:
        parts.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    ends = at + np.cumsum(parts[5], dtype=np.int64)
    return parts, [data[a:b] for a, b in zip([at, *ends[:-1].tolist()], ends.tolist())]


def pack_records(parts: list[np.ndarray], content: list[bytes]) -> bytes:
    head = [np.array([len(content)], "<u4"), *(x.astype(kind) for x, kind in zip(parts, RECORD))]
    return b"".join([*(x.tobytes() for x in head), *content])


def chosen_records(parts: list[np.ndarray], content: list[bytes], good: np.ndarray) -> tuple[list[np.ndarray], list[bytes]]:
    return [x[good] for x in parts], [content[i] for i in np.flatnonzero(good).tolist()]


def set_apart(batches: Iterator[pd.DataFrame], n_buckets: int, most: int, held: list) -> Iterator[pd.DataFrame]:
    """Fills `held` with a partition's records, (parts, contents), but for those of keys with more than `most`:
    these go on at once, packed, in rows of negative buckets. Spans that are known already go on too."""
    hot = np.empty(0, np.uint32)
    fresh = passed = 0

    def recount() -> Iterator[pd.DataFrame]:
        nonlocal hot, passed
        values, counts = np.unique(np.concatenate([np.empty(0, np.uint32), *(p[3] for p, _ in held)]), return_counts=True)
        if (counts > most).any():
            hot = np.union1d(hot, values[counts > most])
            out = []
            for i, (parts, content) in enumerate(held):
                away = np.isin(parts[3], hot)
                if away.any():
                    out.append(pack_records(*chosen_records(parts, content, away)))
                    held[i] = chosen_records(parts, content, ~away)
            yield away_rows(out)

    def away_rows(out: list[bytes]) -> pd.DataFrame:
        nonlocal passed
        passed += len(out)
        return pd.DataFrame({"bucket": [-1 - (passed + i) % n_buckets for i in range(len(out))], "data": out})

    for batch in batches:
        known = batch[batch["direct"]]
        if len(known):
            yield pack_spans(*unpack_spans(known["doc"].to_numpy(np.int64), known["data"].tolist()), n_buckets)
        out = []
        for data in batch.loc[~batch["direct"], "data"]:
            parts, content = read_records(data)
            away = np.isin(parts[3], hot)
            if away.any():
                out.append(pack_records(*chosen_records(parts, content, away)))
                parts, content = chosen_records(parts, content, ~away)
            held.append((parts, content))
            fresh += len(content)
            if fresh > most:
                yield from recount()
                fresh = 0
        if out:
            yield away_rows(out)
    yield from recount()


def search_shards(batches: Iterator[pd.DataFrame], n_buckets: int, most: int) -> Iterator[pd.DataFrame]:
    """The spans to remove that a partition's shards show, and those that are known already; and, in rows of
    negative buckets, the records of keys that have more than `most`."""
    held: list[tuple[list[np.ndarray], list[bytes]]] = []
    yield from set_apart(batches, n_buckets, most, held)
    parts = list(zip(*(p for p, _ in held)))
    content = [x for _, each in held for x in each]
    held.clear()
    if not content:
        return
    ids, names, place, key, anchor, length = (np.concatenate(x) for x in parts)
    place, length = place.astype(np.int64), length.astype(np.int64)
    seen: dict[bytes, int] = {}
    same = np.fromiter((seen.setdefault(x, len(seen)) for x in content), np.int64, len(content))
    distinct = list(seen)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, same, ids)
    later = ids > least[same]
    docs, start, end = [names[later]], [place[later]], [(place + length)[later]]
    first = np.unique(same, return_index=True)[1]
    chosen = candidates(distinct, key[first], anchor[first])
    if len(chosen):
        owner, offset = matches([distinct[i] for i in chosen.tolist()], least[chosen])
        # To each place of that record that was not removed as a whole.
        stay = np.flatnonzero(~later)
        stay = stay[np.argsort(same[stay], kind="stable")]
        low, high = (np.searchsorted(same[stay], chosen[owner], side) for side in ("left", "right"))
        times = high - low
        which = stay[np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        begin = place[which] + np.repeat(offset, times)
        docs, start, end = [*docs, names[which]], [*start, begin], [*end, begin + MATCH]
    yield pack_spans(*map(np.concatenate, (docs, start, end)), n_buckets)


def records_apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The records in rows of negative buckets, a row each."""
    for batch in batches:
        for data in batch.loc[batch["bucket"] < 0, "data"]:
            (ids, names, place, *_), content = read_records(data)
            yield pd.DataFrame({"id": ids, "doc": names, "place": place.astype(np.int64), "content": content})


def spans_apart(packed: DataFrame, n_buckets: int) -> DataFrame:
    """doc and `_tw_more`, the spans to remove, from the records in rows of negative buckets.

    A key of very many records is not held by any task: each 50-byte string (128 bits of hash) is a row, its
    smallest id is found with partial aggregates, and joined back in slices, since strings may be hot too.
    """
    records_ = packed.mapInPandas(records_apart, "id long, doc long, place long, content binary")
    each = records_.withColumn("at", F.explode(F.sequence(F.lit(0), F.octet_length("content") - MATCH)))
    string = F.substring("content", F.col("at") + 1, F.lit(MATCH))
    each = each.select("id", "doc", (F.col("place") + F.col("at")).alias("start"), *(F.xxhash64(F.lit(i), string).alias(f"s{i}") for i in (1, 2)))
    shared = each.groupBy("s1", "s2").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").drop("most")
    n_slices = 16
    shared = shared.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))))
    salted = each.withColumn("slice", F.pmod(F.col("doc"), F.lit(n_slices)).cast("int"))
    hits = salted.join(shared, ["s1", "s2", "slice"]).filter("id > least").select("doc", "start")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            start = batch["start"].to_numpy(np.int64)
            yield pack_spans(batch["doc"].to_numpy(np.int64), start, start + MATCH, n_buckets)

    found = hits.mapInPandas(pack, "bucket int, data binary").repartition(n_buckets, "bucket")
    return found.mapInPandas(gather_spans, "doc long, _tw_spans binary").withColumnRenamed("_tw_spans", "_tw_more")


#: Records of a key that a task holds at once.
MOST_RECORDS = 50_000
#: Keys that a bucket gets on average.
KEYS_PER_BUCKET = 2_000_000
NO_ID = (1 << 63) - 1


def find_repeats(docs: DataFrame, most_records: int = MOST_RECORDS) -> DataFrame:
    """`docs` (text: null as empty) with `_tw_first`, null for a later copy of a whole text, and `_tw_spans`,
    arrays of spans of bytes to remove.

    1. Of equal texts all but that of the smallest id go as a whole.
    2. Of the others' keys, those in several documents are found in buckets.
    3. Records under such keys are filed in shards, where suffix arrays show the strings that documents with
       smaller ids have too. Keys with more than most_records go on as rows for each string instead.
    Each text is shuffled once, by a hash of id and text; keys take 5 to 15 bytes of shuffle for 14 bytes of
    text, records 90 bytes each.
    """
    text = F.coalesce("text", F.lit(""))
    tagged = docs.withColumn("text", text).withColumn("_tw_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    prints = (F.xxhash64("text").alias("h"), (F.crc32(F.col("text").cast("binary")) * (1 << 31) + F.octet_length("text")).alias("g"))
    name: Column = F.xxhash64("_tw_id", *prints)
    tagged = tagged.withColumn("_tw_key", name)
    firsts = tagged.select("_tw_id", *prints).groupBy("h", "g").agg(F.min("_tw_id").alias("_tw_id"))
    firsts = firsts.select(F.xxhash64("_tw_id", "h", "g").alias("_tw_key"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, 2 * n_bytes // (SPAN + 1) // KEYS_PER_BUCKET)
    n_shards = 8 * n_buckets

    def keys(batches):
        yield from nominate(batches, n_buckets)
        release_memory()

    def told_keys(batches):
        yield from shared_keys(batches)
        release_memory()

    def searched(batches):
        yield from search_shards(batches, n_buckets, most_records)
        release_memory()

    def filed(batches):
        yield from file_records(batches, n_shards)
        release_memory()

    nominated = tagged.join(firsts, "_tw_key", "left_semi").mapInPandas(keys, "bucket int, direct boolean, doc long, data binary")
    told = nominated.repartition(n_buckets, "bucket").mapInPandas(told_keys, "doc long, data binary")
    told = told.groupBy(F.col("doc").alias("_tw_key")).agg(F.collect_list("data").alias("_tw_told"))
    records_ = tagged.join(told, "_tw_key").mapInPandas(filed, "shard int, direct boolean, doc long, data binary")
    packed = records_.repartition(n_shards, "shard").mapInPandas(searched, "bucket int, data binary")
    # Both readers take the same shuffle: neither puts a filter before it.
    packed = packed.repartition(n_buckets, "bucket")
    spans = packed.mapInPandas(gather_spans, "doc long, _tw_spans binary").withColumnRenamed("doc", "_tw_key")
    more = spans_apart(packed, n_buckets).withColumnRenamed("doc", "_tw_key")
    marks = firsts.join(spans, "_tw_key", "left").join(more, "_tw_key", "left")
    both = F.when(F.col("_tw_more").isNull(), F.col("_tw_spans")).when(F.col("_tw_spans").isNull(), F.col("_tw_more"))
    marks = marks.select("_tw_key", both.otherwise(F.concat("_tw_spans", "_tw_more")).alias("_tw_spans"), F.lit(True).alias("_tw_first"))
    return tagged.join(marks, "_tw_key", "left")


def cut_out(data: bytes, first: bool, spans: bytes | None) -> tuple[bytes, int]:
    """What is left of a text, and the number of its removed runs."""
    if not first:
        return (b"", 1) if len(data) >= MATCH else (data, 0)
    if not spans:
        return data, 0
    start, end = np.frombuffer(spans, "<u4").reshape(-1, 2).astype(np.int64).T
    if (start[1:] <= end[:-1]).any():
        _, start, end = merge(np.zeros(len(start), np.int64), start, end)
    kept = [data[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(data)])]
    return b"".join(kept), len(start)


def remove_repeats(docs: DataFrame, most_records: int = MOST_RECORDS) -> DataFrame:
    """`docs`, each text without the bytes covered by a 50-byte string that also starts in a document with a
    smaller doc_id.

    Texts are UTF-8; where a cut leaves part of a character, that part goes too. Null texts stay null and
    empty ones empty. Null doc_ids count as 2^63-1, the largest. Rows with equal doc_ids don't remove
    from each other, and equal rows give equal rows. Other columns stay as they are, whatever their names.
    """
    apart = boxed(docs, "doc_id", "text").withColumn("null", F.col("text").isNull())
    found = find_repeats(apart, most_records)
    names = ["doc_id", "text", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = batch.column("null").to_pylist()
            texts = [
                None if no else cut_out(data, first, spans)[0].decode("utf-8", "ignore")
                for (data, first, spans), no in zip(texts_and_spans(batch), null)
            ]
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)
        release_memory()

    return unboxed(found.mapInArrow(run, apart.drop("null").schema), docs.columns)


def texts_and_spans(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bool, bytes | None]]:
    """What `cut_out` takes, of each row that find_repeats gives."""
    for text, first, spans in zip(batch.column("text"), batch.column("_tw_first"), batch.column("_tw_spans")):
        yield text.as_py().encode("utf-8", "surrogatepass"), first.as_py() is True, spans.as_py()


def digests(docs: DataFrame, most_records: int = MOST_RECORDS) -> DataFrame:
    """doc_id, bytes, bytes and runs removed, and digest of the bytes left, of each row."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs_, hashes = [], [], [], []
            for data, first, spans in texts_and_spans(batch):
                kept, n_spans = cut_out(data, first, spans)
                sizes.append(len(data))
                removed.append(len(data) - len(kept))
                runs_.append(n_spans)
                hashes.append(hashlib.sha256(kept).hexdigest())
            numbers = [pa.array(x, pa.int64()) for x in (sizes, removed, runs_)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, pa.array(hashes, pa.string())], names)
        release_memory()

    found = find_repeats(docs.select(F.col("doc_id").cast("long"), "text"), most_records)
    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in the order of their doc_ids."""
    return digests(load(spark, sf_dir, "documents"))
