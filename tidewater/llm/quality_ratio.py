"""Quality rules: hashed n-gram likelihood ratio between a trusted target and the raw corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import OTHER_SPACES, let, split_words, window_hash
from tidewater.session import load

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityParams:
    """n_buckets bounds the model, which is all that leaves the executors. least_ratio is the mean
    log-likelihood ratio per n-gram from which a document is kept. trusted_docs bounds the labelled rows
    that the target is fitted on; the corpus side is always all rows."""

    n_buckets: int = 1 << 14
    trusted_docs: int = 10_000
    smoothing: float = 1.0
    least_ratio: float = -0.1
    least_words: int = 10
    most_repeat_percent: int = 20
    repeat_window: int = 5


def repeated_words(words: Column, window: int) -> Column:
    """Words inside windows of `window` words that occur twice or more in `words`, first ones included.

    Windows are compared by their 64-bit hashes. Only texts in which a hash repeats are sorted.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(pairs: Column) -> Column:
            twice = lambda p, k: (F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"])
            return F.sort_array(F.transform(F.filter(pairs, lambda p, k: F.coalesce(twice(p, k), F.lit(False))), lambda p: p["i"]))

        merged = F.aggregate(
            let(placed, positions),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda state, at: F.struct(
                (state["n"] + at + window - F.greatest(at, state["end"])).alias("n"),
                (at + window).alias("end"),
            ),
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(merged["n"])

    def hashes(ws: Column) -> Column:
        return F.when(
            F.size(ws) >= window,
            F.transform(F.sequence(F.lit(0), F.size(ws) - window), lambda i: window_hash(ws, i, window)),
        ).otherwise(F.array().cast("array<bigint>"))

    return let(words, lambda ws: let(hashes(ws), covered))


def base_columns(text: Column, words: Column, params: QualityParams) -> dict[str, Column]:
    """The plain counts of a text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.trim(line, F.lit(" " + OTHER_SPACES)) != "")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.char_length(whole) - F.char_length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
        "n_repeat_words": repeated_words(words, params.repeat_window).cast("long"),
    }


def with_buckets(rows: DataFrame, n_buckets: int) -> DataFrame:
    """`rows` for each of its `words`, with the buckets `single` of the word and `pair` of it and the next.

    Rows without words stay, with null buckets; the last word of a text has no pair. The words are exploded
    first and hashed after, which keeps the hashing in generated code.
    """
    spread = lambda *ws: F.pmod(F.xxhash64(*ws), F.lit(n_buckets)).cast("int")
    each = rows.select("*", F.posexplode_outer("words").alias("_at", "_word"))
    following = F.get(F.col("words"), F.col("_at") + 1)
    return each.select(
        *(c for c in rows.columns if c != "words"),
        F.when(F.col("_word").isNotNull(), spread(F.col("_word"))).alias("single"),
        F.when(following.isNotNull(), spread(F.col("_word"), following)).alias("pair"),
    )


def trusted_sample(trusted: DataFrame, params: QualityParams) -> DataFrame:
    """The distinct ids of `trusted`, or the trusted_docs of them with the least hashes."""
    ids = trusted.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    space, most = 1 << 20, params.trusted_docs
    # About a fifth more than wanted pass the filter, so that few rows are left to be ordered.
    share = min(1.0, 1.2 * most / max(ids.count(), 1))
    place = F.xxhash64("doc_id", F.lit("trusted"))
    return ids.filter(F.pmod(place, F.lit(space)) < int(share * space)).orderBy(place, "doc_id").limit(most)


def fit(docs: DataFrame, trusted: DataFrame, params: QualityParams) -> DataFrame:
    """One row with `ratios`: for each bucket the log of its share in the target over its share in the corpus.

    The corpus is every row of `docs`; the target is those whose doc_id is in the sample of `trusted`.
    Every n-gram of every text counts. Tasks sum their buckets before the shuffle, so it moves n_buckets rows a task.
    """
    # A bounded set of ids, so it is broadcast whatever the size of the tables: no text is shuffled.
    marked = F.broadcast(trusted_sample(trusted, params).withColumn("_trusted", F.lit(1)))
    words = docs.select("doc_id", "text").join(marked, "doc_id", "left").select("_trusted", split_words(F.col("text")).alias("words"))
    placed = with_buckets(words, params.n_buckets)
    grams = placed.select("_trusted", F.explode(F.array("single", "pair")).alias("bucket")).filter("bucket IS NOT NULL")
    counts = grams.groupBy("bucket").agg(F.count("*").alias("corpus"), F.count("_trusted").alias("target"))
    every = docs.sparkSession.range(params.n_buckets).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").select(
        "bucket", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("corpus", "target"))
    )
    # At most n_buckets rows meet here.
    table = filled.agg(
        F.sort_array(F.collect_list(F.struct("bucket", "corpus", "target"))).alias("rows"),
        F.sum("corpus").alias("corpus"),
        F.sum("target").alias("target"),
    )
    a, n = params.smoothing, params.n_buckets
    share = lambda count, total: F.log((count + a) / (total + a * n))
    return table.select(
        F.transform("rows", lambda r: share(r["target"], F.col("target")) - share(r["corpus"], F.col("corpus"))).alias("ratios")
    )


def judge(docs: DataFrame, model: DataFrame, params: QualityParams) -> DataFrame:
    """Counts, `llr` and verdicts of every row of `docs`.

    `llr` is the mean log ratio over the n-grams of the text, so it doesn't grow with length. Null and
    empty texts have no words, an llr of null, and fail the base rules. Rows are judged one by one:
    repeated rows give repeated results, and doc_id may be null. Columns besides doc_id and text are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text", split_words(F.col("text")).alias("words"))
    base = base_columns(F.col("text"), F.col("words"), params)
    each = with_buckets(rows.select("_row", "doc_id", "words", *(c.alias(name) for name, c in base.items())), params.n_buckets)
    ratio = lambda bucket: F.coalesce(F.get(model.scalar(), F.col(bucket)), F.lit(0.0))
    # A row's words follow each other in one task: what is shuffled is one sum for each row.
    counted = (
        each.withColumn("_ratio", ratio("single") + ratio("pair"))
        .groupBy("_row")
        .agg(*(F.first(c).alias(c) for c in ("doc_id", *base)), F.sum("_ratio").alias("_sum"))
        .withColumn("llr", F.when(F.col("n_words") > 0, F.col("_sum") / (2 * F.col("n_words") - 1)))
    )
    failed = (F.col("n_words") < params.least_words) | (
        100 * F.col("n_repeat_words") > params.most_repeat_percent * F.col("n_words")
    )
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= params.least_ratio))


def op5_quality_ratio(spark: SparkSession, sf_dir: str, params: QualityParams = QualityParams()) -> DataFrame:
    """All documents; the trusted target is those labelled good and not toxic."""
    docs = load(spark, sf_dir, "documents")
    trusted = load(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0")
    judged = judge(docs, fit(docs, trusted, params), params)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )
