"""Words and word pairs of a table's groups, counted in batches: Arrow numbers the words, pairs are pairs of numbers, and only
terms that may be frequent become strings again."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a group's terms by hash that are counted before the terms, and how many of them make a row.
BUCKETS, ROW = 1 << 18, 1 << 12
#: Rows and bytes of words that are counted at once; a longer text is counted by itself.
SLICE_ROWS, SLICE_BYTES = 1 << 14, 1 << 23
#: Hash buckets of a group's terms that are ranked apart.
RANKED = 64


def joined(words: Column) -> Column:
    """An array of words, which have no blanks, as one string."""
    return F.array_join(words, " ")


@dataclass
class Numbered:
    """The words of some rows: `names`, the distinct ones; each word's place there and its row."""

    names: pa.Array
    ids: np.ndarray
    rows: np.ndarray

    def runs(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
        """First and second word and row of all single words, then of all pairs."""
        yield self.ids, None, self.rows
        if longest > 1:
            both = self.rows[1:] == self.rows[:-1]
            yield self.ids[:-1][both], self.ids[1:][both], self.rows[1:][both]

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(zlib.crc32, self.names.cast(pa.binary()).to_pylist()), np.uint64, len(self.names))


def numbered(words: pa.ChunkedArray) -> Numbered:
    lists = pc.split_pattern(words.combine_chunks(), " ")
    coded = lists.flatten().dictionary_encode()
    rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    return Numbered(coded.dictionary, coded.indices.to_numpy().astype(np.int64), rows)


def slices(batches: Iterator[pa.RecordBatch], group: str, every: bool = False) -> Iterator[tuple[str, pa.Table]]:
    """Rows of one group at a time, a few; rows without words, but for `every`, or group are left out."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if every else table.filter(pc.field("words") != "")
        for value in pc.unique(table[group]).to_pylist():
            own = table.filter(pc.field(group) == pa.scalar(value, table.schema.field(group).type))
            ends, start = np.cumsum(pc.binary_length(own["words"]).to_numpy(), dtype=np.int64), 0
            while start < own.num_rows:
                most = SLICE_BYTES + (ends[start - 1] if start else 0)
                stop = min(max(start + 1, int(np.searchsorted(ends, most, "right"))), start + SLICE_ROWS)
                yield value, own.slice(start, stop - start)
                start = stop


def buckets_of(hashes: np.ndarray, first: np.ndarray, second: np.ndarray | None, n: int) -> np.ndarray:
    mixed = hashes[first] * np.uint64(0x9E3779B97F4A7C15)
    if second is not None:
        mixed += hashes[second] * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed >> np.uint64(24)) % np.uint64(n)).astype(np.int64)


def bucket_totals(docs: DataFrame, group: str, longest: int) -> dict[str, np.ndarray]:
    """How many terms each bucket has, by group: BUCKETS numbers a group."""
    n, row = BUCKETS, ROW

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for value, rows in slices(batches, group):
            words = numbered(rows["words"])
            hashes = words.hashes()
            for first, second, _ in words.runs(longest):
                own = np.bincount(buckets_of(hashes, first, second, n), minlength=n)
                found[value] = found[value] + own if value in found else own
        for value, own in found.items():
            parts = [(i, part.astype("<i8").tobytes()) for i in range(0, n, row) if (part := own[i : i + row]).any()]
            yield pa.RecordBatch.from_pydict({"own": [value] * len(parts), "at": [i for i, _ in parts], "n": [p for _, p in parts]}, schema=form)

    def summed(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, "<i8") for x in table["n"].to_pylist()], axis=0)
        return pa.table([table["own"][:1], table["at"][:1], pa.array([total.astype("<i8").tobytes()], pa.binary())], schema=form)

    form = pa.schema([("own", pa.string()), ("at", pa.int32()), ("n", pa.binary())])
    shape = "own string, at int, n binary"
    totals: dict[str, np.ndarray] = {}
    for r in docs.select(group, "words").mapInArrow(counts, shape).groupBy("own", "at").applyInArrow(summed, shape).collect():
        part = np.frombuffer(r["n"], "<i8")
        totals.setdefault(r["own"], np.zeros(n, np.int64))[r["at"] : r["at"] + len(part)] = part
    return totals


def frequent(docs: DataFrame, group: str, size: int, longest: int = 2) -> dict[str, list[tuple[str, int, int]]]:
    """term, freq and df of the `size` most frequent terms of each group, the smaller of equals first; `docs` (group, words).

    No term is more frequent than all terms of its hash bucket together. So buckets are counted first, and only terms of
    the fullest are counted themselves; if those of other buckets could still be as frequent as the last term found, once
    more with all of these. Groups are few, so what the driver gets, BUCKETS numbers and `size` terms a group, is bounded.
    """
    totals = bucket_totals(docs, group, longest)
    least = {g: int(np.partition(n, -2 * size)[-2 * size]) if np.count_nonzero(n) > 2 * size else 0 for g, n in totals.items()}
    found = counted(docs, group, size, longest, totals, least)
    needed = {g: found[g][-1][1] if len(found[g]) == size else 0 for g in totals}
    again = {g for g in totals if needed[g] < least[g]}
    if again:
        found |= counted(docs.filter(F.col(group).isin(list(again))), group, size, longest, totals, needed)
    return found


def counted(docs: DataFrame, group: str, size: int, longest: int, totals: dict[str, np.ndarray], least: dict[str, int]) -> dict[str, list[tuple[str, int, int]]]:
    """The `size` most frequent terms of each group's buckets of at least `least` terms."""
    chosen, buckets = {g: np.packbits(n >= least[g]) for g, n in totals.items()}, BUCKETS

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, rows in slices(batches, group):
            words, known = numbered(rows["words"]), np.unpackbits(chosen[value]).astype(bool)
            hashes, many = words.hashes(), len(words.names)
            for first, second, row in words.runs(longest):
                on = known[buckets_of(hashes, first, second, buckets)]
                code = first[on] if second is None else first[on] * many + second[on]
                # The distinct codes, then the distinct pairs of row and code.
                codes, code = np.unique(code, return_inverse=True)
                both, times = np.unique(row[on] * len(codes) + code, return_counts=True)
                code = both % max(1, len(codes))
                names = words.names.take(pa.array(codes if second is None else codes // many))
                if second is not None:
                    names = pc.binary_join_element_wise(names, words.names.take(pa.array(codes % many)), " ")
                freq = np.bincount(code, times, len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([value] * len(codes), pa.string()), names.cast(pa.string()), pa.array(freq), pa.array(np.bincount(code, minlength=len(codes)))], ["own", "term", "freq", "df"])

    partial = docs.select(group, "words").mapInArrow(terms, "own string, term string, freq long, df long")
    every = partial.groupBy("own", "term").agg(F.sum("freq").alias("freq"), F.sum("df").alias("df"))
    # The most frequent of each bucket first, so that no task ranks all terms of a group.
    bucket = F.pmod(F.xxhash64("term"), F.lit(RANKED))
    for by in (["own", bucket], ["own"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("freq"), "term"))
        every = every.withColumn("k", place).filter(F.col("k") <= size)
    found: dict[str, list[tuple[str, int, int]]] = {g: [] for g in totals}
    for r in every.orderBy("own", "k").collect():
        found[r["own"]].append((r["term"], r["freq"], r["df"]))
    return found


def known_terms(docs: DataFrame, keep: list[str], group: str, vocabulary: dict[str, list[str]], longest: int = 2, every: bool = False) -> DataFrame:
    """`keep`, group, places, tf and same of each row of `docs` (these, words) with known terms, or of `every` row: the places of its terms in
    its group's vocabulary, ascending, and how often they occur, as arrays, and a digest of both."""
    lists = {g: pa.array(terms, pa.string()) for g, terms in vocabulary.items()}

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, rows in slices(batches, group, every):
            words, terms = numbered(rows["words"]), lists.get(value, pa.array([], pa.string()))
            size, many = max(1, len(terms)), len(words.names)
            single = pc.fill_null(pc.index_in(words.names, terms), -1).to_numpy().astype(np.int64)
            cut = [t.split(" ") for t in terms.to_pylist()]
            ahead, behind = (pc.fill_null(pc.index_in(pa.array([c[i] if len(c) == 2 else None for c in cut], pa.string()), words.names), -1).to_numpy() for i in (0, 1))
            pairs = np.flatnonzero((ahead >= 0) & (behind >= 0))
            codes = ahead[pairs].astype(np.int64) * many + behind[pairs]
            order = np.argsort(codes)
            codes, pairs = codes[order], pairs[order]
            parts = []
            for first, second, row in words.runs(longest):
                if second is None:
                    place = single[first]
                    on = place >= 0
                    parts.append(row[on] * size + place[on])
                elif len(codes):
                    begins, ends = np.zeros(many, bool), np.zeros(many, bool)
                    begins[codes // many], ends[codes % many] = True, True
                    on = begins[first] & ends[second]
                    code = first[on] * many + second[on]
                    at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                    right = codes[at] == code
                    parts.append(row[on][right] * size + pairs[at[right]])
            both, times = np.unique(np.concatenate(parts), return_counts=True)
            there = np.arange(rows.num_rows) if every else np.unique(both // size)
            starts = np.searchsorted(both // size, there)
            offsets = np.append(starts, len(both)).astype(np.int32)
            places, times = (both % size).astype(np.int32), times.astype(np.int32)
            same = [blake2b(places[a:b].tobytes() + times[a:b].tobytes(), digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            place, tf = (pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (places, times))
            own = rows.select([*keep, group]).take(pa.array(there, pa.int64()))
            yield from own.append_column("places", place).append_column("tf", tf).append_column("same", pa.array(same, pa.binary())).combine_chunks().to_batches()

    fields = [docs.schema[c] for c in (*keep, group)]
    arrays = StructType.fromDDL("places array<int>, tf array<int>, same binary").fields
    return docs.select(*keep, group, "words").mapInArrow(counts, StructType([*fields, *arrays]))
