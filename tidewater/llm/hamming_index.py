"""Approximate nearest neighbours by multi-index hashing: learned binary codes, an index of each of their substrings,
all codes within a Hamming radius by the pigeonhole principle, and a ranking of these by their vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import put, release_memory
from tidewater.session import load

#: Bits of a substring; its values are 16-bit numbers.
PART = 16
#: Vectors of a shard, each of which one task indexes and searches at a time.
SHARD_ROWS = 100_000
#: Cells of (queries x shard) that are looked at at once.
CELLS = 8_000_000
FOUND = "query long, query_id long, vec_id long, score double"


@dataclass(frozen=True)
class IndexParams:
    """`rotations` codes of one bit a dimension (filled up to 16) are put side by side. They, and the radius, are
    fitted to at most `sample` vectors, of which `probes` are looked up: the radius is the least that holds `aim` of
    their `k` nearest. Neighbours in a sample are farther than among all, so among all it holds more."""

    rotations: int = 2
    rounds: int = 20
    sample: int = 10_000
    probes: int = 500
    aim: float = 0.97
    k: int = 5


@dataclass
class Model:
    """What is subtracted, the rotations side by side (dimensions x bits), and the radius."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int
    dim: int = field(default=0)


def sound(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part: without nulls and non-finite numbers, and not zero."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", v.alias("v")).filter(F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))


def unit(rows: np.ndarray) -> np.ndarray:
    """Vectors of length one. They are first scaled by powers of two, which is exact, so that no square is too large."""
    scaled = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def learn_rotation(x: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """A rotation under which the signs of `x` lie closest to its coordinates (iterative quantization)."""
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1],) * 2))
    for _ in range(rounds):
        signs = np.where(x @ turn >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(x.T @ signs)
        turn = u @ vt
    return turn


def codes_of(model: Model, units: np.ndarray) -> np.ndarray:
    """The substrings (16 bits each) of each vector's code."""
    bits = ((units - model.mean) @ model.rotation >= 0).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of each code of `a` from each of `b`."""
    return reduce(np.add, (np.bitwise_count(a[:, None, j] ^ b[None, :, j]).astype(np.int16) for j in range(a.shape[1])))


def fit(rows: DataFrame, params: IndexParams) -> Model | None:
    """The model of the vectors `rows` (row, vec_id, v); None without any. The sample is that of the least hashes of
    the rows' numbers and goes to the driver: `params.sample` vectors whatever the table's size."""
    took = rows.orderBy(F.xxhash64("row"), "row").limit(params.sample).select("v").toPandas()
    if not len(took):
        return None
    x = unit(np.array(took["v"].tolist(), dtype=float))
    mean = x.mean(axis=0)
    # Dimensions are filled up with zeros to whole substrings: their bits are random directions of no weight.
    dim = x.shape[1]
    wide = -dim % PART
    centred = np.pad(x - mean, ((0, 0), (0, wide)))
    rotation = np.hstack([learn_rotation(centred, params.rounds, seed) for seed in range(params.rotations)])[:dim]
    model = Model(mean, rotation, rotation.shape[1], dim)
    codes = codes_of(model, x)
    probes = np.arange(min(params.probes, len(x)))
    near = x[probes] @ x.T
    near[probes, probes] = -2
    k = min(params.k, len(x) - 1)
    if k:
        nearest = np.argpartition(-near, k - 1, axis=1)[:, :k]
        apart = np.take_along_axis(distances(codes[probes], codes), nearest, axis=1)
        model.radius = int(np.quantile(apart, params.aim, method="higher"))
    return model


class Shard:
    """The vectors of one shard with an index of each substring: which values it has, and which rows have each."""

    def __init__(self, ids: np.ndarray, nameless: np.ndarray, rows: np.ndarray, units: np.ndarray, model: Model) -> None:
        self.ids, self.nameless, self.rows, self.units, self.model = ids, nameless, rows, units, model
        self.codes = codes_of(model, units)
        self.index = []
        for part in self.codes.T:
            order = np.argsort(part, kind="stable")
            values, starts = np.unique(part[order], return_index=True)
            self.index.append((order, values, np.append(starts, len(part))))
        #: By the pigeonhole principle two codes within the radius agree in one substring but for so many bits.
        self.apart = model.radius // self.codes.shape[1]
        flips = [sum(1 << b for b in bits) for n in range(self.apart + 1) for bits in combinations(range(PART), n)]
        self.flips = np.array(flips, dtype=np.uint16)

    def probe(self, codes: np.ndarray) -> np.ndarray:
        """For each query (row) and vector of the shard (column): whether a substring is close enough."""
        hit = np.zeros((len(codes), len(self.ids)), dtype=bool)
        for j, (order, values, starts) in enumerate(self.index):
            for i, value in enumerate(codes[:, j]):
                if len(self.flips) < len(values):
                    wanted = value ^ self.flips
                    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
                    buckets = at[values[at] == wanted]
                else:
                    buckets = np.flatnonzero(np.bitwise_count(values ^ value) <= self.apart)
                sizes = starts[buckets + 1] - starts[buckets]
                # The places of all these buckets' rows in `order`, one bucket after the other.
                places = np.repeat(starts[buckets] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                hit[i, order[places]] = True
        return hit

    def search(self, queries: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
        """The k nearest of this shard within the radius of each query, ties to the smaller id."""
        block = max(1, CELLS // len(self.ids))
        for first in range(0, len(queries), block):
            some = queries.iloc[first : first + block]
            units = unit(np.array(some["v"].tolist(), dtype=float))
            codes = codes_of(self.model, units)
            hit = self.probe(codes)
            found = []
            for i, row in enumerate(some["row"]):
                near = np.flatnonzero(hit[i])
                apart = np.bitwise_count(self.codes[near] ^ codes[i]).sum(axis=1, dtype=np.int32)
                near = near[(apart <= self.model.radius) & (self.rows[near] != row)]
                # Row by row, so that equal vectors score alike wherever they stand.
                score = np.minimum(np.einsum("ij,j->i", self.units[near], units[i], optimize=False), 1.0)
                if len(near) > k:
                    least = np.partition(score, len(score) - k)[len(score) - k]
                    near, score = near[score >= least], score[score >= least]
                best = np.lexsort((self.ids[near], self.nameless[near], -score))[:k]
                near, score = near[best], score[best]
                ids = pd.Series(self.ids[near], dtype="Int64").mask(self.nameless[near])
                found.append(pd.DataFrame({"query": row, "query_id": some["vec_id"].iloc[i], "vec_id": ids, "score": score}))
            yield pd.concat(found)


def numbered(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The vectors that take part as a written table of row (a number), vec_id (0 if null, and then nameless) and v,
    and how many they are. Vectors have the length that most have (the greater on ties); others take no part."""
    rows = sound(vectors).withColumn("row", F.monotonically_increasing_id())
    spark = rows.sparkSession
    told = rows.select("row", F.coalesce(F.col("vec_id").cast("long"), F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("nameless"), "v")
    rows = spark.read.schema(told.schema).parquet(put(told, "vectors"))
    lengths = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return rows, 0
    return rows.filter(F.size("v") == lengths["dim"]), lengths["count"]


def search(vectors: DataFrame, is_query: Column, k: int = 5, params: IndexParams | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest found of each row of `vectors` for which `is_query`: query_id, rank (from 1), vec_id, score.

    Nearness is the cosine in double precision; ties go to the smaller vec_id. Each row is a query or candidate of its
    own: repeated rows find each other, a query never its own row. Vectors that are null, zero, of another length than
    most, or hold null or non-finite numbers take no part; nor do null vec_ids as queries, which as candidates are
    last in ties. A query with fewer than k vectors within the radius gets those; if the table is too small to have
    k others, all.

    Vectors are dealt over shards by their row's hash, so copies and dense places spread. Every shard sees every query,
    in blocks: a task holds one shard (`shard_rows` vectors on average), its indexes and one block; queries stream.
    """
    params = params or IndexParams()
    rows, n = numbered(vectors)
    spark = rows.sparkSession
    model = fit(rows, params)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if n <= k + 1:
        model.radius = model.rotation.shape[1]
    shards = max(-(-n // shard_rows), min(spark.sparkContext.defaultParallelism, -(-n // 1_000)))
    told = spark.sparkContext.broadcast(model)
    dealt = rows.withColumn("query", F.lit(False)).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    asked = rows.filter(is_query & ~F.col("nameless")).withColumn("query", F.lit(True))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        shard, number = None, None
        for batch in batches:
            for at, part in batch.groupby("shard", sort=False):
                if at != number:
                    held, shard, number = [], None, at
                stored = part[~part["query"]]
                if len(stored):
                    held.append(pd.DataFrame({"row": stored["row"], "vec_id": stored["vec_id"], "nameless": stored["nameless"], "v": [unit(np.array([v], dtype=float))[0] for v in stored["v"]]}))
                asking = part[part["query"]]
                if len(asking) and held:
                    if shard is None:
                        every = pd.concat(held)
                        columns = (every[c].to_numpy() for c in ("vec_id", "nameless", "row"))
                        shard = Shard(*columns, np.stack(every["v"].to_list()), told.value)
                    yield from shard.search(asking, k)
        release_memory()

    # Within a shard vectors come before queries.
    met = dealt.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "query")
    found = met.mapInPandas(look, FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_hamming_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each whose id is divisible by 50, among all."""
    return search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
