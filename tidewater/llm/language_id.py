"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.llm.common import release_memory
from tidewater.session import load

LETTER = regex.compile(r"\p{L}")
#: Bytes of text that are counted at once.
PIECE = 2 << 20
#: Odd multipliers for hashing 2- and 3-grams.
PAIR, TRIPLE = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


#: Bytes of the beginnings that rejection distances are fitted on, and the fewest members to fit one on.
CUTS, FEWEST = (48, 192, 768), 20


@dataclass(frozen=True)
class LanguageParams:
    """per_language bounds the labelled rows that each language's centroids are fitted on, most_rows those of all
    languages: with more than most_rows / per_language languages each has fewer. dimensions is a power of two. Documents less similar than least_similarity to every centroid are rejected, and so are
    those less similar to the nearest than the share `outside` of that centroid's own members, times `slack`."""

    per_language: int = 500
    most_rows: int = 10_000
    dimensions: int = 4096
    clusters: int = 4
    rounds: int = 10
    least_similarity: float = 0.1
    outside: float = 0.01
    slack: float = 0.9
    seed: int = 11


def byte_classes() -> np.ndarray:
    """ASCII letters in lower case, bytes of other letters as they are, blanks for the rest."""
    table = np.full(256, ord(" "), np.uint8)
    table[128:] = np.arange(128, 256)
    for c in range(26):
        table[ord("a") + c] = table[ord("A") + c] = ord("a") + c
    return table


CLASSES = byte_classes()


def gram_counts(texts: list[str], dimensions: int) -> np.ndarray:
    """Counts of hashed byte 2- and 3-grams, a row for each text; whole texts, very long ones in pieces that
    overlap. A blank stands before and after each text, so no gram has bytes of two texts."""
    out = np.zeros((len(texts), dimensions), np.float32)
    shift = np.uint32(32 - dimensions.bit_length() + 1)

    def count(first: int, parts: list[bytes]) -> None:
        data = CLASSES[np.frombuffer(b"".join(parts), np.uint8)].astype(np.uint32)
        owner = np.repeat(np.arange(len(parts)), list(map(len, parts)))[: len(data) - 2]
        pairs = data[:-2] << np.uint32(8) | data[1:-1]
        triples = pairs << np.uint32(8) | data[2:]
        worth = data[1:-1] != ord(" ")  # a gram of blanks, or around one, says nothing
        base = owner[worth] * dimensions
        size = len(parts) * dimensions
        found = np.bincount(base + ((pairs[worth] * PAIR) >> shift), minlength=size)
        found += np.bincount(base + ((triples[worth] * TRIPLE) >> shift), minlength=size)
        out[first : first + len(parts)] += found.reshape(len(parts), dimensions)

    parts: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        data = b" " + text.encode("utf-8", "surrogatepass") + b" "
        if len(data) > PIECE:
            for at in range(0, len(data) - 2, PIECE):
                count(i, [data[at : at + PIECE + 2]])
            data = b"  "
        parts.append(data)
        size += len(data)
        if size >= PIECE or len(parts) >= 128:
            count(first, parts)
            first, parts, size = i + 1, [], 0
    if parts:
        count(first, parts)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


@dataclass(frozen=True)
class LanguageModel:
    """Centroids (unit rows), the language of each, the idf of each dimension, and `least`: the cosine that a
    text needs for each centroid (row), by the longest of CUTS (column) that it reaches; 0 in front for shorter ones.
    Without languages it tells none: every text is `und`. Of centroids equally near the first one counts, in the
    order of the languages' names."""

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and cosine (0 to 1) of the nearest centroid, and the cosine needed; `und` and 0 for texts
        without a letter."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        vectors = unit(np.log1p(gram_counts(texts, len(self.idf))) * self.idf)
        near = vectors @ self.centroids.T
        best = near.argmax(axis=1)
        lettered = np.fromiter((LETTER.search(t) is not None for t in texts), bool, len(texts))
        score = np.where(lettered, np.clip(near[np.arange(len(texts)), best], 0, 1), 0).astype(float)
        sizes = np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
        needed = self.least[best, np.searchsorted(CUTS, sizes, "right")]
        return [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist())], score, needed


def cluster(vectors: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; fewer centroids where there are fewer vectors."""
    k = min(k, len(vectors))
    centroids = vectors[rng.choice(len(vectors), k, replace=False)]
    for _ in range(rounds):
        nearest = (vectors @ centroids.T).argmax(axis=1)
        sums = np.stack([vectors[nearest == c].sum(axis=0) for c in range(k)])
        filled = sums.any(axis=1)
        centroids = np.where(filled[:, None], unit(sums), centroids)
    return centroids


def document_counts(usable: DataFrame, dimensions: int) -> tuple[np.ndarray, int]:
    """The number of documents that have each dimension, and of all documents, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dimensions + 1, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 256):
                total[:-1] += (gram_counts(texts[at : at + 256], dimensions) > 0).sum(axis=0)
            total[-1] += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions + 1)), pa.array(total)], ["dimension", "n"])

    summed = usable.select("text").mapInArrow(count, "dimension long, n long").groupBy("dimension").agg(F.sum("n").alias("n"))
    out = np.zeros(dimensions + 1, np.int64)
    for r in summed.collect():
        out[r["dimension"]] = r["n"]
    return out[:-1], int(out[-1])


def needed_cosines(cuts: Iterable[tuple[np.ndarray, np.ndarray]], names: list[str], centroids: np.ndarray, params: LanguageParams) -> np.ndarray:
    """`least` of a model, from the vectors and languages of each of CUTS, one cut at a time: a low quantile of the cosines of labelled texts' beginnings of that
    length with the centroid that is nearest and of their language. Centroids that few are nearest to take all of
    their language's; where these are few too, that of the cut before."""
    least = np.zeros((len(names), len(CUTS) + 1))
    for k, (vectors, labels) in enumerate(cuts):
        near = vectors @ centroids.T
        best = near.argmax(axis=1)
        nearest, score = np.array(names)[best], near[np.arange(len(near)), best]
        good = nearest == labels
        for c in range(len(names)):
            own = score[(best == c) & good]
            if len(own) < FEWEST:
                own = score[(nearest == names[c]) & good]
            least[c, k + 1] = params.slack * np.quantile(own, params.outside) if len(own) >= FEWEST else least[c, k]
    return least


def fit(labelled: DataFrame, params: LanguageParams) -> LanguageModel:
    """A model of the languages in `labelled` (doc_id, text, lang), from a hashed sample of about per_language
    rows of each. The sample's counts, not its texts, come to the driver: per_language rows per language, each
    whole and by its beginnings. Document frequencies are those of all rows, not of the sample.
    Rows without a label or without a letter aren't used; where no others are, the model has no language.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows_of = {r["lang"]: r["n"] for r in labelled.filter("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    none = LanguageModel([], np.zeros((0, params.dimensions), np.float32), np.ones(params.dimensions, np.float32), np.zeros((0, len(CUTS) + 1)))
    if not rows_of:
        return none
    per_language = min(params.per_language, max(1, params.most_rows // len(rows_of)))
    space = 1 << 50
    limits = F.create_map(*(F.lit(x) for lang, n in rows_of.items() for x in (lang, int(space * min(1.0, per_language / n)))))
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(params.seed)), F.lit(space))
    # Of equal rows one is enough, so that no row with many copies fills the sample.
    sample = usable.filter(place < limits[F.col("lang")]).select("lang", F.xxhash64("doc_id", "text").alias("h"), "text").dropDuplicates(["lang", "h"])
    dimensions = params.dimensions

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for at in range(0, len(texts), 256):
                part = batch.slice(at, 256)
                for size in (0, *CUTS):
                    whole = [t.encode("utf-8", "surrogatepass") for t in texts[at : at + 256]]
                    rows = gram_counts([t[: size or None].decode("utf-8", "ignore") for t in whole], dimensions)
                    packed = [zlib.compress(r.astype("<u4").tobytes(), 1) if len(t) >= size else None for r, t in zip(rows, whole)]
                    made = [pa.array([size] * len(rows), pa.int32()), pa.array(packed, pa.binary())]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], ["lang", "h", "size", "counts"])

    counted = sample.mapInArrow(count, "lang string, h long, size int, counts binary").filter("counts IS NOT NULL").collect()
    if not counted:
        return none
    counted.sort(key=lambda r: (r["lang"], r["h"]))
    of_size = {size: [r for r in counted if r["size"] == size] for size in (0, *CUTS)}
    with_grams, n_docs = document_counts(usable, dimensions)
    idf = (np.log((1 + n_docs) / (1 + with_grams)) + 1).astype(np.float32)

    def table(size: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and languages of the sample's texts of one size; counts are unpacked in blocks, as most are 0."""
        rows = of_size[size]
        vectors = np.empty((len(rows), dimensions), np.float32)
        for at in range(0, len(rows), 128):
            packed = b"".join(zlib.decompress(r["counts"]) for r in rows[at : at + 128])
            vectors[at : at + 128] = unit(np.log1p(np.frombuffer(packed, "<u4").reshape(-1, dimensions).astype(np.float32)) * idf)
        return vectors, np.array([r["lang"] for r in rows], str)

    vectors, languages = table(0)
    rng = np.random.default_rng(params.seed)
    names: list[str] = []
    centroids = []
    for lang in sorted(set(languages.tolist())):
        own = cluster(vectors[languages == lang], params.clusters, params.rounds, rng)
        names += [lang] * len(own)
        centroids.append(own)
    joined = np.concatenate(centroids).astype(np.float32)
    del vectors
    return LanguageModel(names, joined, idf, needed_cosines(map(table, CUTS), names, joined, params))


def predict(docs: DataFrame, model: LanguageModel, least_similarity: float) -> DataFrame:
    """`docs` with lang_pred, score and rejected; from the texts alone.

    Rejected is what is less similar to its nearest centroid than the model needs, or than least_similarity.
    Null texts and texts without a letter are `und`, score 0, rejected. A model without languages (nothing was
    labelled) says `und` of every text, score 0, and rejects only those without a letter: the others are
    unjudged. Rows are judged one by one, so repeated rows agree. Columns of docs by the names of the new ones
    are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            languages: list[str] = []
            scores, least = [np.empty(0)], [np.empty(0)]
            for at in range(0, len(texts), 512):
                found, score, needed = shared.value.predict(texts[at : at + 512])
                languages += found
                scores.append(score)
                least.append(needed)
            score = np.concatenate(scores)
            needed = np.maximum(np.concatenate(least), least_similarity)
            if shared.value.languages:
                rejected = [lang == "und" or s < n for lang, s, n in zip(languages, score.tolist(), needed.tolist())]
            else:
                rejected = [LETTER.search(t) is None for t in texts]
            made = [pa.array(languages, pa.string()), pa.array(score), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "lang_pred", "score", "rejected"])
        release_memory()

    base = docs.drop("lang_pred", "score", "rejected")
    schema = StructType([*base.schema.fields, *StructType.fromDDL("lang_pred string, score double, rejected boolean").fields])
    return base.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; those without an id are neither learnt from nor held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_from(docs: DataFrame) -> DataFrame:
    """The rows that may be learnt from."""
    return docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")


def op1_language_id(spark: SparkSession, sf_dir: str, params: LanguageParams = LanguageParams()) -> DataFrame:
    """The language of every document."""
    docs = load(spark, sf_dir, "documents")
    model = fit(learn_from(docs), params)
    judged = predict(docs.select("doc_id", "text"), model, params.least_similarity)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
