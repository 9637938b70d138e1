"""SimHash near-duplicates: fuzzy keys from the binary Golay code, joined and verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from tidewater.llm.common import boxed, join_counted, release_memory, unboxed, written
from tidewater.llm.components import least_reachable
from tidewater.session import load

#: Words of a shingle, the seed of its hash, and the most bits that linked fingerprints differ in.
SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Fixed value: a generator polynomial of the binary Golay code [23, 12, 7].
GENERATOR = 0b101011100011
#: A fingerprint's parts: bits 0-22 and 23-45, read by the Golay code, and the 18 bits above.
PART, REST_AT, REST_BITS = 23, 46, 18
#: Fingerprints that a block compares all with all; larger blocks are parted further.
SMALL_BLOCK = 1_024


def fingerprint(text: str | None) -> int:
    """The majority of each bit over the 64-bit hashes of all 4-word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = (ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]).tolist()
    shingles = map(joined.__getitem__, map(slice, starts, stops))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_280):
        bits = np.unpackbits(hashes[at : at + 65_280].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Sums of up to 255 rows fit a byte.
        full = len(bits) // 255 * 255
        counts += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[full:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, `fp` (the 64 bits as a signed long) and the carried columns (longs) of each row; whole texts."""
    names = ["doc_id", "fp", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names)

    return docs.select(F.col("doc_id").cast("long"), "text", *carried).mapInArrow(run, ", ".join(f"{x} long" for x in names))


def nearest_codewords() -> np.ndarray:
    """For each 23-bit word the index of the one codeword that is at most 3 bits from it: the code is perfect."""
    message = np.arange(1 << 12, dtype=np.int32)
    code = np.zeros(1 << 12, np.int32)
    for bit in range(12):
        code ^= ((message >> bit) & 1) * np.int32(GENERATOR << bit)
    nearest = np.zeros(1 << PART, np.int16)
    for weight in range(4):
        for places in combinations(range(PART), weight):
            nearest[code ^ np.int32(sum(1 << p for p in places))] = message
    return nearest


class Golay:
    """The table, made once in each worker."""

    nearest: np.ndarray | None = None
    flips = np.array([0, *(1 << bit for bit in range(PART))])

    @classmethod
    def indices(cls, words: np.ndarray) -> np.ndarray:
        """For each word the codewords found when one bit or none is flipped: 1 or 6, -1 filling up.

        Words up to 2 bits apart have one in common: that of the word between them, which is at most one
        flip from either.
        """
        if cls.nearest is None:
            cls.nearest = nearest_codewords()
        found = np.sort(cls.nearest[words[:, None] ^ cls.flips], axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return np.sort(found, axis=1)[:, :-7:-1]


#: Fingerprints of a run that one task compares; longer runs are parted by fifths of the bits.
LONGEST_RUN = 50_000
#: Fifths of 64 bits, as signed masks: every fifth bit, and stretches of 13.
FIFTHS = [
    [int(np.uint64(sum(1 << b for b in range(64) if fifth(b) == k)).view(np.int64)) for k in range(5)]
    for fifth in (lambda b: b % 5, lambda b: b // 13)
]


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fps, key): two fingerprints at most 4 bits apart share a key.

    Of d errors, a fall into part A, b into part B and r into the rest of 18 bits; a + b + r <= 4.
    - a = 0 or b = 0: the part itself is a key.
    - else r = 0: a or b is at most 2: the rest with an index of that part.
    - else a, b, r >= 1, and so a and b are at most 2, r is 1 or 2: an index of A with one of B and that
      third of the rest, of 6 bits, that has no error.
    """
    a, b, rest = (fps & np.uint64((1 << PART) - 1)).astype(np.int64), ((fps >> np.uint64(PART)) & np.uint64((1 << PART) - 1)).astype(np.int64), (fps >> np.uint64(REST_AT)).astype(np.int64)
    near_a, near_b = Golay.indices(a).astype(np.int64), Golay.indices(b).astype(np.int64)
    every = np.arange(len(fps))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(kind: int, key: np.ndarray, good: np.ndarray | None = None) -> None:
        key = key | (kind << 56)
        found.append((every, key) if good is None else (every[good], key[good]))

    add(1, a)
    add(2, b)
    for i in range(6):
        add(3, near_a[:, i] << REST_BITS | rest, near_a[:, i] >= 0)
        add(4, near_b[:, i] << REST_BITS | rest, near_b[:, i] >= 0)
        for j in range(6):
            both = (near_a[:, i] >= 0) & (near_b[:, j] >= 0)
            for third in range(3):
                bits = rest >> (6 * third) & 63
                add(5 + third, (near_a[:, i] << 12 | near_b[:, j]) << 6 | bits, both)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def find_root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return int(i)


def forest(fps: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that tie together what the given pairs do, one fewer than positions at most."""
    parent = np.arange(len(fps))
    kept: list[tuple[int, int]] = []
    for i, j in zip(left.tolist(), right.tolist()):
        a, b = find_root(parent, i), find_root(parent, j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((i, j))
    out = np.array(kept, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def links_within(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the distinct fingerprints of one block.

    A large block is parted by the value of each fifth of the bits in turn: of 4 errors, one fifth has
    none. What still is large is compared in strips. Nothing is left out; a block gives less than one
    link for each fingerprint.
    """
    if len(fps) <= SMALL_BLOCK:
        apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
        left, right = np.nonzero(np.triu(apart <= MOST_BITS, 1))
        return forest(fps, left, right)
    lefts, rights = [], []
    for fifth in range(5):
        value = fps >> np.uint64(13 * fifth) & np.uint64((1 << 13) - 1)
        order = np.argsort(value, kind="stable")
        cuts = np.flatnonzero(np.diff(value[order])) + 1
        for part in np.split(order, cuts):
            for at in range(0, len(part), SMALL_BLOCK):
                strip = part[at : at + SMALL_BLOCK]
                for other_at in range(at, len(part), SMALL_BLOCK):
                    other = part[other_at : other_at + SMALL_BLOCK]
                    i, j = np.nonzero(np.bitwise_count(fps[strip][:, None] ^ fps[other][None, :]) <= MOST_BITS)
                    i, j = strip[i], other[j]
                    i, j = forest(fps, i[i != j], j[i != j])
                    lefts.append(i)
                    rights.append(j)
    return forest(fps, np.concatenate(lefts), np.concatenate(rights))


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `fp`, enough to tie together all that are at most 4
    bits apart: keys are dealt to tasks and sorted, and each run of one key is verified as a block.

    A run of more than LONGEST_RUN fingerprints isn't held: its rows are dealt anew by their key with each fifth of
    the bits in turn, since of 4 errors one fifth has none, and what is long again by fifths of another kind.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for at in range(0, len(fps), 4_000):
                part = fps[at : at + 4_000]
                place, key = keys_of(part)
                yield pd.DataFrame({"key": key, "fp": part[place].view(np.int64)})
        release_memory()

    found = tied(distinct.mapInPandas(emit, "key long, fp long"), LONGEST_RUN)
    every = found.filter("NOT longer").select("a", "b")
    for level in range(1, len(FIFTHS) + 1):
        longer = found.filter("longer")
        if longer.isEmpty():
            break
        fifths = F.array(*(F.xxhash64(F.col("b"), F.lit(k), F.col("a").bitwiseAND(F.lit(m))) for k, m in enumerate(FIFTHS[level - 1])))
        again = longer.select(F.explode(fifths).alias("key"), F.col("a").alias("fp")).distinct()
        # What two kinds of fifths have left in one run is compared in strips.
        found = tied(again, LONGEST_RUN if level < len(FIFTHS) else 1 << 62)
        every = every.unionByName(found.filter("NOT longer").select("a", "b"))
    return every.distinct()


def tied(keys: DataFrame, longest: int) -> DataFrame:
    """Written links (a, b) within the runs of equal keys; of runs that are longer than `longest` each fingerprint
    and its key, marked `longer`."""

    def tie(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_keys, open_fps, passed = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for batch in batches:
            keys_, fps = batch["key"].to_numpy(np.int64), batch["fp"].to_numpy(np.int64).view(np.uint64)
            if passed is not None:
                # The rest of a run that was too long.
                rest = int(np.searchsorted(keys_, passed, side="right"))
                yield marked(fps[:rest], keys_[:rest])
                keys_, fps = keys_[rest:], fps[rest:]
                if not len(keys_):
                    continue
                passed = None
            open_keys, open_fps = np.concatenate((open_keys, keys_)), np.concatenate((open_fps, fps))
            # The last key may go on in the next batch.
            done = int(np.searchsorted(open_keys, open_keys[-1])) if len(open_keys) else 0
            yield from within(open_keys[:done], open_fps[:done])
            open_keys, open_fps = open_keys[done:], open_fps[done:]
            if len(open_keys) > longest:
                passed = open_keys[-1]
                yield marked(open_fps, open_keys)
                open_keys, open_fps = open_keys[:0], open_fps[:0]
        yield from within(open_keys, open_fps)
        release_memory()

    def within(sorted_keys: np.ndarray, fps: np.ndarray) -> Iterator[pd.DataFrame]:
        _, run, sizes = np.unique(sorted_keys, return_inverse=True, return_counts=True)
        long = (sizes > longest)[run] if len(run) else np.empty(0, bool)
        yield marked(fps[long], sorted_keys[long])
        yield tie_runs(sorted_keys[~long], fps[~long]).assign(longer=False)

    def marked(fps: np.ndarray, sorted_keys: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"a": fps.view(np.int64), "b": sorted_keys, "longer": True})

    dealt = keys.repartition("key").sortWithinPartitions("key")
    return written(dealt.mapInPandas(tie, "a long, b long, longer boolean"), "links")


def tie_runs(keys: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
    """Links within each run of equal keys."""
    starts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)])) if len(keys) else np.array([0])
    sizes = np.diff(starts)
    lefts, rights = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    # Small runs at once: the pairs at each distance within a run.
    small = np.repeat(sizes, sizes) <= 32
    run = np.repeat(np.arange(len(sizes)), sizes)
    for apart in range(1, 32):
        if len(keys) <= apart:
            break
        pair = (run[apart:] == run[:-apart]) & small[apart:]
        if not pair.any():
            break
        i = np.flatnonzero(pair)
        i = i[np.bitwise_count(fps[i] ^ fps[i + apart]) <= MOST_BITS]
        lefts.append(fps[i])
        rights.append(fps[i + apart])
    for k in np.flatnonzero(sizes > 32):
        block = fps[starts[k] : starts[k + 1]]
        i, j = links_within(block)
        lefts.append(block[i])
        rights.append(block[j])
    a, b = np.concatenate(lefts).view(np.int64), np.concatenate(rights).view(np.int64)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def named_nodes(prints: DataFrame, first: Column) -> tuple[DataFrame, DataFrame]:
    """fp, `name` (a fingerprint that names its class) and `_rows` of each distinct fingerprint; and name,
    `first` (the smallest value of that column) and `_n` (the fingerprints) of each class."""
    nodes = prints.groupBy("fp").agg(F.min(first).alias("_first"), F.count("*").alias("_rows"))
    tied = least_reachable(links(nodes.select("fp")))
    named = nodes.join(tied, nodes["fp"] == tied["node"], "left").select("fp", "_first", "_rows", F.coalesce("least", "fp").alias("name"))
    named = written(named, "named")
    smallest = named.groupBy("name").agg(F.min("_first").alias("first"), F.count("*").alias("_n"))
    return named.select("fp", "name", "_rows"), smallest


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, `fingerprint` (16 hex digits) and `component_id` of each row.

    Rows with equal fingerprints are one node, so copies cost one row each and are never paired. Null and
    empty texts have the fingerprint 0 and link like others. component_id is the smallest doc_id of all
    that can be reached over links; null doc_ids count as larger than all others, and a class of nothing
    else has null. Repeated rows give repeated rows; further columns are ignored.
    """
    prints = written(fingerprints(docs), "fingerprints")
    named, smallest = named_nodes(prints, F.col("doc_id"))
    by_print = join_counted(named, smallest, "name", named.count())
    by_print = written(by_print.select("fp", F.col("first").alias("component_id"), F.col("_rows").alias("_n")), "classes")
    return join_counted(prints, by_print, "fp", prints.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each class: that of the smallest doc_id (nulls last), of several such rows that
    with the smallest key.

    A row's key is 128 bits of hash over all its columns, nulls marked, so that only fully equal rows share
    one; of these one is kept.
    """
    fields = [x for c in docs.schema for x in (F.col(f"`{c.name}`").isNull(), hashable(c))]
    keys = ["k1", "k2"]
    hashes = (F.xxhash64(F.lit(i), *fields).alias(f"k{i}") for i in (1, 2))
    keyed = boxed(docs, "doc_id", "text", *hashes)
    prints = written(fingerprints(keyed, *keys), "fingerprints")
    _, smallest = named_nodes(prints, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *keys))
    firsts = written(smallest.select("first.*").select(*keys), "firsts")
    repeated = prints.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    several = written(firsts.join(repeated, keys, "left_semi"), "several")
    # Only rows that have equals are grouped, each task's own first; the others' texts are shuffled once at most.
    alone = keyed.join(firsts.join(several, keys, "left_anti"), keys, "left_semi")
    grouped = keyed.join(several, keys, "left_semi").dropDuplicates(keys)
    return unboxed(alone.unionByName(grouped), docs.columns)


def hashable(field: StructField) -> Column:
    """A column as a hash takes it: maps, wherever they are in it, have no hash, so it is hashed as JSON."""
    column = F.col(f"`{field.name}`")
    return F.to_json(F.struct(column)) if "map<" in field.dataType.simpleString() or "variant" in field.dataType.simpleString() else column


def op10_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return classes(load(spark, sf_dir, "documents"))
