"""Phrase mining: frequent words become numbers, word n-grams fixed-width binary keys, which are sorted and counted by runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import LOWER, UPPER, release_memory, written
from tidewater.session import load

#: The characters that end a piece.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
#: Of the dictionary, so many of the most frequent words go to every executor, if they are no longer than
#: LONGEST characters; the others are joined.
HOT_WORDS, LONGEST = 500_000, 64
#: Characters of a text that are split at once, codes that are packed at once, and keys that a task holds.
CHUNK, CODES, KEYS = 1 << 20, 1_000_000, 4_000_000
#: A key is 12 bytes: two word numbers of 4, and 4 for none (0) or one more than the third's.
#: Codes besides numbers: the end of a piece or an infrequent word; from LOOKUP down, a word to be looked up.
BREAK, LOOKUP = -1, -2
RUNS = "part int, high binary, low binary, n binary"
#: Equal steps of word numbers, and most frequent words, whose shares of all words say where ranges of keys end.
STEPS, TALL = 4_096, 4_096
#: Buckets of a language's phrases that are ranked apart before the last round, and rows of each beyond so many buckets.
BUCKETS, BUCKET_ROWS = 32, 200_000


def cleaned(docs: DataFrame) -> DataFrame:
    """lang ('und' if null) and text of each row: A-Z in lower case, \\n for each end of a piece, blanks between words."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER + PIECE_ENDS + "\t", LOWER + "\n" * len(PIECE_ENDS) + " ")
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text"))


def word_counts(texts: DataFrame, least: int) -> DataFrame:
    """lang, word, f and m (a number of the row) of each word that occurs `least` times in its language, written; a
    row without a word has the occurrences of all others, so that a language's f add up to its words."""
    words = texts.select("lang", F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("word")).filter("word != ''")
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("f"))
    kept = counts.groupBy("lang", F.when(F.col("f") >= least, F.col("word")).alias("word")).agg(F.sum("f").alias("f"))
    return written(kept.withColumn("m", F.monotonically_increasing_id()), "words")


def dictionary(counts: DataFrame) -> DataFrame:
    """id (from 0, without wide gaps), lang, word and f of the frequent words. m counts from 0 in each partition;
    what comes before each goes to the driver, a number a partition."""
    part, at = F.shiftright("m", 33), F.col("m").bitwiseAND((1 << 33) - 1)
    sizes = sorted(counts.groupBy(part.alias("part")).agg(F.max(at) + 1).collect())
    ends = np.cumsum([size for _, size in sizes]).tolist()
    if ends and ends[-1] >= 1 << 32:
        raise ValueError("more than 2^32 frequent words: their numbers don't fit 4 bytes")
    spark = counts.sparkSession
    before = spark.createDataFrame([(p, e - s) for (p, s), e in zip(sizes, ends)], "part long, before long")
    named = counts.filter("word IS NOT NULL").withColumn("part", part).join(F.broadcast(before), "part")
    return written(named.select((F.col("before") + at).alias("id"), "lang", "word", "f"), "dictionary")


def codes_of(text: str, number: Callable[[str], int]) -> np.ndarray:
    """The code of each word and end of a piece, in reading order; a piece at a time of very long texts."""
    found, at = [np.empty(0, dtype=np.int64)], 0
    while at < len(text):
        end = text.find(" ", at + CHUNK)
        end = len(text) if end < 0 else end
        words = text[at:end].replace("\n", " \n ").split(" ")
        found.append(np.fromiter((number(w) for w in words if w), dtype=np.int64))
        at = end
    return np.concatenate(found)


def radix_order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The order of 12-byte keys, by 16 bits at a time from the lowest; numpy sorts 16-bit numbers by radix."""
    order = None
    for column, shifts in ((low, (0, 16)), (high, (0, 16, 32, 48))):
        for shift in shifts:
            digit = (column >> column.dtype.type(shift)).astype(np.uint16)
            if len(digit) and digit.min() == digit.max():
                continue
            step = np.argsort(digit if order is None else digit[order], kind="stable")
            order = step if order is None else order[step]
    return np.arange(len(high)) if order is None else order


class Tally:
    """Keys with their counts; sorted and counted by runs whenever KEYS have come together."""

    def __init__(self, most: int) -> None:
        self.most, self.held, self.size = most, [], 0

    def add(self, high: np.ndarray, low: np.ndarray, n: np.ndarray) -> None:
        self.held.append((high, low, n))
        self.size += len(high)

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct keys so far in order, with their counts; they are what is held from now on."""
        columns = [np.concatenate(c) for c in zip(*self.held)] if self.held else [np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int64)]
        self.held = []
        order = radix_order(*columns[:2])
        high, low, n = (c[order] for c in columns)
        starts = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))) if len(high) else np.empty(0, dtype=np.int64)
        runs = (high[starts], low[starts], np.add.reduceat(n, starts) if len(starts) else n)
        self.held, self.size = [runs], len(starts)
        return runs

    def overflow(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs that make room: none as long as distinct keys are few."""
        if self.size > self.most:
            runs = self.settle()
            if self.size > self.most // 2:
                self.held, self.size = [], 0
                yield runs


@dataclass
class Ranges:
    """Ranges of keys that hold about as many n-grams each, if words followed each other by chance. A key's place among
    all is the share of the words before its first one, and within its first word's share that of the words before
    its second, and so on. `base` tells the shares at equal steps of the numbers, `tall` those of the most frequent."""

    parts: int
    edges: np.ndarray
    base: np.ndarray
    tall: np.ndarray
    tall_sums: np.ndarray

    def before(self, numbers: np.ndarray) -> np.ndarray:
        return np.interp(numbers, self.edges, self.base) + self.tall_sums[np.searchsorted(self.tall, numbers)]

    def part(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The range of each key: a function of the key alone."""
        place = np.where(low > 0, self.before(low.astype(np.int64) - 1), 0.0)
        for word in (high & np.uint64(0xFFFFFFFF), high >> np.uint64(32)):
            start = self.before(word.astype(np.int64))
            place = start + (self.before(word.astype(np.int64) + 1) - start) * place
        return np.minimum(place * self.parts, self.parts - 1).astype(np.int32)


def ranges_of(words: DataFrame, parts: int) -> Ranges:
    """The ranges of the dictionary `words`: two tables of a few thousand numbers go to the driver."""
    size = words.agg(F.max("id")).first()[0]
    size = 1 if size is None else size + 1
    tall = sorted(words.orderBy(F.desc("f"), "id").limit(TALL).select("id", "f").collect())
    others = words.join(F.broadcast(words.sparkSession.createDataFrame([(i,) for i, _ in tall], "id long")), "id", "left_anti")
    steps = dict(others.groupBy(F.floor(F.col("id") * STEPS / size).alias("step")).agg(F.sum("f")).collect())
    base = np.cumsum([0] + [steps.get(k, 0) for k in range(STEPS)]).astype(float)
    sums = np.cumsum([0] + [f for _, f in tall]).astype(float)
    total = max(base[-1] + sums[-1], 1.0)
    return Ranges(parts, np.arange(STEPS + 1) * size / STEPS, base / total, np.array([i for i, _ in tall], dtype=np.int64), sums / total)


def batches_of(high: np.ndarray, low: np.ndarray, n: np.ndarray, ranges: Ranges) -> Iterator[pa.RecordBatch]:
    """Runs, a row for those of one range: their keys' first 8 and last 4 bytes, and their counts, side by side."""
    part = ranges.part(high, low)
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
    for first, last in zip(starts, [*starts[1:], len(part)]):
        for at in range(first, last, CODES):
            here = slice(at, min(at + CODES, last))
            row = [[int(part[at])], *([c[here].tobytes()] for c in (high, low, n))]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *(pa.array(c, pa.binary()) for c in row[1:])], names=["part", "high", "low", "n"])


def pack(codes: np.ndarray, tally: Tally) -> None:
    """Counts all pairs and triples of neighbours that hold no break."""
    known = codes >= 0
    a = codes.astype(np.uint64)
    pairs = np.flatnonzero(known[:-1] & known[1:])
    both = (a[pairs] << np.uint64(32)) | a[pairs + 1]
    more = pairs[(pairs + 2 < len(codes))]
    third = known[more + 2]
    tally.add(both, np.zeros(len(both), dtype=np.uint32), np.ones(len(both), dtype=np.int64))
    triples = more[third]
    tally.add(both[: len(more)][third], (codes[triples + 2] + 1).astype(np.uint32), np.ones(len(triples), dtype=np.int64))


def packed(texts: Iterator[np.ndarray], ranges: Ranges, most: int) -> Iterator[pa.RecordBatch]:
    """The runs of all n-grams of texts' codes."""
    tally, waiting, size = Tally(most), [], 0
    for codes in texts:
        waiting += [codes, np.array([BREAK])]
        size += len(codes) + 1
        if size >= CODES:
            pack(np.concatenate(waiting), tally)
            waiting, size = [], 0
            for runs in tally.overflow():
                yield from batches_of(*runs, ranges)
    if waiting:
        pack(np.concatenate(waiting), tally)
    yield from batches_of(*tally.settle(), ranges)
    release_memory()


def runs_by_broadcast(texts: DataFrame, numbers: dict[str, dict[str, int]], ranges: Ranges, most: int) -> DataFrame:
    """Runs of the n-grams of `texts` where `numbers` (by language, then word) holds the whole dictionary."""
    told = texts.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = told.value

        def each() -> Iterator[np.ndarray]:
            for batch in batches:
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    get = known.get(lang, {}).get
                    yield codes_of(text.as_py(), lambda w: get(w, BREAK))

        yield from packed(each(), ranges, most)

    return texts.mapInArrow(run, RUNS)


def runs_by_join(texts: DataFrame, numbers: dict[str, dict[str, int]], words: DataFrame, ranges: Ranges, most: int) -> DataFrame:
    """The same where other words of the dictionary, `words`, are too many for every executor: what a text has
    besides `numbers` is looked up by a join, a row a text and distinct word, and put into the text's codes."""
    told = texts.sparkSession.sparkContext.broadcast(numbers)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = told.value
        for batch in batches:
            for doc, lang, text in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                get, open_words = known.get(lang, {}).get, {}

                def number(w: str) -> int:
                    at = BREAK if w == "\n" else get(w)
                    return LOOKUP - open_words.setdefault(w, len(open_words)) if at is None else at

                codes = codes_of(text.as_py(), number)
                columns = [pa.array([doc.as_py()], pa.int64()), pa.array([lang]), pa.array([codes], pa.list_(pa.int64())), pa.array([list(open_words)], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "lang", "codes", "open"])

    coded = texts.select(F.monotonically_increasing_id().alias("doc"), "lang", "text").mapInArrow(code, "doc long, lang string, codes array<long>, open array<string>")
    coded = written(coded, "coded")
    asked = coded.select("doc", "lang", F.posexplode("open").alias("at", "word"))
    told_words = asked.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("doc").agg(F.collect_list("at").alias("at"), F.collect_list("id").alias("id"))
    met = coded.select("doc", "codes", F.size("open").alias("n")).join(told_words, "doc", "left").drop("doc")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[np.ndarray]:
            for batch in batches:
                for row in batch.to_pylist():
                    codes = np.array(row["codes"], dtype=np.int64)
                    looked = np.full(row["n"] + 1, BREAK, dtype=np.int64)
                    looked[row["at"] or []] = row["id"] or []
                    yield np.where(codes <= LOOKUP, looked[np.clip(LOOKUP - codes, 0, row["n"])], codes)

        yield from packed(each(), ranges, most)

    return met.mapInArrow(fill, RUNS)


def count_runs(runs: DataFrame, parts: int, least: int, most: int) -> DataFrame:
    """w1, w2, w3 (null for pairs) and a of each key that occurs `least` times. Keys are dealt out by ranges; a task
    sorts those of its range, counts their runs, and so holds distinct keys only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(most)
        for batch in batches:
            for row in range(batch.num_rows):
                held = (np.frombuffer(batch.column(c)[row].as_buffer(), dtype=t) for c, t in ((1, np.uint64), (2, np.uint32), (3, np.int64)))
                tally.add(*(c.copy() for c in held))
                if tally.size > 2 * most:
                    tally.settle()
        high, low, n = tally.settle()
        high, low, n = (c[n >= least] for c in (high, low, n))
        for at in range(0, len(high), 100_000):
            h, w, c = (x[at : at + 100_000] for x in (high, low, n))
            third = pa.array(w.astype(np.int64) - 1, mask=w == 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array((h >> np.uint64(32)).astype(np.int64)), pa.array((h & np.uint64(0xFFFFFFFF)).astype(np.int64)), third, pa.array(c)], names=["w1", "w2", "w3", "a"]
            )
        release_memory()

    return runs.repartitionById(parts, "part").mapInArrow(run, "w1 long, w2 long, w3 long, a long")


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly, for counts below 10^16."""
    once, one, other = (c.cast("decimal(16,0)") for c in (a, left, right))
    return F.call_function("div", once * once * F.lit(1_000_000).cast("decimal(7,0)"), one * other)


def first_of_each(scored: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language by score, a and phrase, with their rank. Buckets of phrases give their
    own first ones before, so no task ranks more than a bucket or the buckets' first rows."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    buckets = max(BUCKETS, scored.count() // BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(buckets))
    few = scored.withColumn("_at", F.row_number().over(Window.partitionBy("lang", bucket).orderBy(*order))).filter(F.col("_at") <= top).drop("_at")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def mine_phrases(docs: DataFrame, least: int = 10, inside_percent: int = 50, top: int = 2_000, hot_words: int = HOT_WORDS, most_keys: int = KEYS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's `top` phrases of two or three words.

    A phrase occurs `least` times (at least 1) within pieces; l and r are the counts of the two parts of its
    lowest-scoring cut, n its language's words. Phrases inside a longer candidate with `inside_percent` of their
    occurrences are dropped. Words that occur less often than `least` can't be in a phrase, so pieces break at
    them. Null texts are empty, null languages 'und'; repeated rows count again; other columns are ignored.
    Without a candidate, as in an empty table, there are no rows.
    """
    texts = cleaned(docs)
    counts = word_counts(texts, least)
    words = dictionary(counts)
    hot = words.filter(F.char_length("word") <= LONGEST).orderBy(F.desc("f"), "id").limit(hot_words).select("id", "lang", "word").toArrow().to_pydict()
    numbers: dict[str, dict[str, int]] = {}
    for number, lang, word in zip(hot["id"], hot["lang"], hot["word"]):
        numbers.setdefault(lang, {})[word] = number
    rest = words.join(F.broadcast(hot_ids(words.sparkSession, hot["id"])), "id", "left_anti")
    whole = words.count() == len(hot["id"])
    n_words = counts.agg(F.sum("f")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * n_words // most_keys)
    ranges = ranges_of(words, parts)
    made = runs_by_broadcast(texts, numbers, ranges, most_keys) if whole else runs_by_join(texts, numbers, rest, ranges, most_keys)
    counted = written(count_runs(made, parts, least, most_keys), "phrases")

    first, second = (words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"x{k}"), F.col("f").alias(f"f{k}"), *(["lang"] if k == 1 else [])) for k in (1, 2))
    two = written(counted.filter("w3 IS NULL").drop("w3").join(first, "w1").join(second, "w2"), "pairs")
    left = two.select("w1", "w2", "lang", "x1", "x2", "f1", F.col("a").alias("a12"))
    right = two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("x2").alias("x3"), F.col("f2").alias("f3"), F.col("a").alias("a23"))
    three = counted.filter("w3 IS NOT NULL").join(left, ["w1", "w2"]).join(right, ["w2", "w3"])

    def cut_at(k: int, a: Column, one: Column, other: Column) -> Column:
        return F.struct(score_of(a, one, other).alias("score"), F.lit(k).alias("k"), one.alias("l"), other.alias("r"))

    a = F.col("a")
    triples = three.select("lang", F.concat_ws(" ", "x1", "x2", "x3").alias("phrase"), "a", F.least(cut_at(1, a, F.col("f1"), F.col("a23")), cut_at(2, a, F.col("a12"), F.col("f3"))).alias("cut"))
    around = three.select("w1", "w2", F.col("a").alias("longer")).unionByName(three.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("a").alias("longer")))
    around = around.groupBy("w1", "w2").agg(F.max("longer").alias("longer"))
    alone = two.join(around, ["w1", "w2"], "left").filter(F.coalesce(100 * F.col("longer") < inside_percent * a, F.lit(True)))
    pairs = alone.select("lang", F.concat_ws(" ", "x1", "x2").alias("phrase"), "a", cut_at(1, a, F.col("f1"), F.col("f2")).alias("cut"))
    scored = written(pairs.unionByName(triples).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "scored")
    sums = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    best = first_of_each(scored, top).join(sums, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def hot_ids(spark: SparkSession, ids: list[int]) -> DataFrame:
    """The broadcast words' numbers as rows."""
    return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64())}))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language of all documents."""
    return mine_phrases(load(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (
  SELECT row_number() OVER () AS piece, lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM d)),
o AS (SELECT piece, lang, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM p),
f1 AS (SELECT lang, word, count(*) AS f FROM o GROUP BY ALL),
n AS (SELECT lang, count(*) AS n FROM o GROUP BY lang),
q AS (SELECT lang, word AS x, lead(word) OVER s AS y, lead(word, 2) OVER s AS z FROM o WINDOW s AS (PARTITION BY piece ORDER BY i)),
f2 AS (SELECT lang, x, y, count(*) AS a FROM q WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, x, y, z, count(*) AS a FROM q WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c3 AS (
  SELECT lang, x, y, z, f3.a AS a, g.f AS l1, t.a AS r1, b.a AS l2, h.f AS r2,
    ((1000000::HUGEINT * f3.a * f3.a) // (g.f::HUGEINT * t.a)) AS s1, ((1000000::HUGEINT * f3.a * f3.a) // (b.a::HUGEINT * h.f)) AS s2
  FROM f3 JOIN f2 b USING (lang, x, y) JOIN (SELECT lang, x AS y, y AS z, a FROM f2) t USING (lang, y, z)
    JOIN (SELECT lang, word AS x, f FROM f1) g USING (lang, x) JOIN (SELECT lang, word AS z, f FROM f1) h USING (lang, z)),
m AS (SELECT lang, x, y, max(a) AS a FROM (SELECT lang, x, y, a FROM f3 UNION ALL SELECT lang, y, z, a FROM f3) GROUP BY ALL),
s AS (
  SELECT lang, x || ' ' || y || ' ' || z AS phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END AS l, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END AS r, least(s1, s2) AS score FROM c3
  UNION ALL
  SELECT lang, x || ' ' || y, f2.a, g.f, h.f, (1000000::HUGEINT * f2.a * f2.a) // (g.f::HUGEINT * h.f)
  FROM f2 JOIN (SELECT lang, word AS x, f FROM f1) g USING (lang, x) JOIN (SELECT lang, word AS y, f FROM f1) h USING (lang, y) LEFT JOIN m USING (lang, x, y)
  WHERE m.a IS NULL OR 100 * m.a < 50 * f2.a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s) JOIN n USING (lang) WHERE rank <= 2000
"""
