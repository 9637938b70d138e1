"""Token counts as delta-maintained rollups with idempotent batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import remove, shared_dir, split_words
from tidewater.session import load

KEYS = ("source", "lang", "tokenizer_version")
#: Steps after which one commit tells all ids.
FOLD = 100
TOTALS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


class TokenRollup:
    """Additive totals by source, language and tokenizer version below one folder.

    A batch is a set of signed rows: +1 inserts, -1 deletes, and a revised count is one of each. A batch is summed
    by key, added to the totals of the last commit, and written as the totals of the next step; only then does
    that step's commit appear, which names the batch. A batch whose id was committed is a repeat and changes
    nothing; any other counts, whatever its id, so that late batches are not lost. One that broke off half-way has
    no commit and is simply done again. Reading takes the totals of the last step alone, a row for each key, however
    many batches there were. Totals of the last `keep` steps stay, for readers that began before the last batches;
    ids are told in one file for every FOLD steps. One writer at a time is expected.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 3) -> None:
        self.spark, self.path, self.keep = spark, path, keep

    def _steps(self, folder: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(where):
            return []
        return sorted(int(s.getPath().getName().split("=")[1]) for s in files.listStatus(where) if "=" in s.getPath().getName())

    def committed(self) -> DataFrame:
        """batch_id of all batches that count. A step that is a multiple of FOLD tells all before it too."""
        steps = self._steps("commits")
        folded = max((s for s in steps if s % FOLD == 0), default=0)
        told = [f"{self.path}/commits/step={s}" for s in steps if s >= folded]
        return self.spark.read.schema("batch_id long").parquet(*told) if told else self.spark.createDataFrame([], "batch_id long")

    def apply(self, batch_id: int, changes: DataFrame) -> bool:
        """Adds and commits `changes` (source, lang, tokenizer_version, n_tokens, sign); False for a repeat.

        Null sources, languages and versions are keys of their own; a null count is 0, a null sign +1.
        Repeated rows count each; other columns are ignored.
        """
        ids = self.committed()
        if not ids.filter(F.col("batch_id") == batch_id).isEmpty():
            return False
        step = max(self._steps("commits"), default=0) + 1
        sign = F.coalesce("sign", F.lit(1)).cast("long")
        signed = changes.select(*KEYS, sign.alias("n_docs"), (sign * F.coalesce("n_tokens", F.lit(0))).cast("long").alias("n_tokens"))
        # Tasks sum before the shuffle, so a source with most of the rows costs a row per task.
        self._summed(self.totals().unionByName(signed)).write.mode("overwrite").parquet(f"{self.path}/totals/step={step}")
        new = self.spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id"))
        told = new if step % FOLD else ids.unionByName(new)
        told.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/step={step}")
        for old in self._steps("totals"):
            if old <= step - self.keep:
                remove(self.spark, f"{self.path}/totals/step={old}")
        return True

    def totals(self) -> DataFrame:
        """Keys with documents or tokens, and their totals."""
        last = max(self._steps("commits"), default=None)
        if last is None:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(f"{self.path}/totals/step={last}")

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        summed = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.filter("n_docs <> 0 OR n_tokens <> 0")


def word_tokens(text: Column) -> Column:
    """Tokenizer `words-1`: runs without white space."""
    return F.size(split_words(text)).cast("long")


def letter_tokens(text: Column) -> Column:
    """Tokenizer `letters-2`: runs of ASCII letters, digits and non-ASCII characters."""
    from tidewater.llm.decontaminate import benchmark_words

    return F.size(benchmark_words(text)).cast("long")


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents inserted under words-1; the toxic ones deleted; those that
    have another label counted anew under letters-2 (a delete and an insert each), so that the unlabelled
    stay under words-1; the deletes given again, to no effect."""
    rollup = TokenRollup(spark, shared_dir(spark, "rollup"))
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    labels = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("gone"))
    # Counted before the join, so that no text is shuffled.
    counted = docs.select("doc_id", "source", "lang", word_tokens(F.col("text")).alias("old"), letter_tokens(F.col("text")).alias("new"))

    def change(version: str, count: str, sign: int) -> Column:
        return F.struct(F.lit(version).alias("tokenizer_version"), F.col(count).alias("n_tokens"), F.lit(sign).alias("sign"))

    unpack = lambda df: df.select("source", "lang", "change.*")
    inserts = unpack(counted.withColumn("change", change("words-1", "old", 1)))
    judged = counted.join(labels, "doc_id")
    deletes = unpack(judged.filter("gone").withColumn("change", change("words-1", "old", -1)))
    both = F.explode(F.array(change("words-1", "old", -1), change("letters-2", "new", 1)))
    revisions = unpack(judged.filter("NOT gone").withColumn("change", both))
    for batch_id, changes in enumerate((inserts, deletes, revisions)):
        rollup.apply(batch_id, changes)
    rollup.apply(1, deletes)
    return rollup.totals()


OP2_SQL = r"""
WITH l AS (SELECT doc_id, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS gone FROM labels GROUP BY doc_id),
d AS (
  SELECT source, lang, gone IS NOT NULL AS labelled, coalesce(gone, 0) AS gone, coalesce(text, '') AS text
  FROM documents LEFT JOIN l USING (doc_id)),
t AS (
  SELECT source, lang, CASE WHEN labelled THEN 'letters-2' ELSE 'words-1' END AS tokenizer_version,
    len(list_filter(CASE WHEN labelled THEN regexp_split_to_array(text, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')
      ELSE regexp_split_to_array(text, '[\x20\x09-\x0D]+') END, lambda x: x <> '')) AS n
  FROM d WHERE gone = 0)
SELECT source, lang, tokenizer_version, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens
FROM t GROUP BY source, lang, tokenizer_version
"""
