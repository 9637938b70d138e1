"""A history that a stream inserts into and trims as one act, each batch at most once."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "batch long, folder string, cutoff timestamp, base boolean"


class HistoryStore:
    """Rows by key below `path`: those of a batch replace older ones, and rows `days` older than the latest go.

    A batch is written to a folder of its own and counts once a commit names the folder with the batch's id and the
    time before which rows are trimmed; a batch whose id has a commit changes nothing, and one that failed before its
    commit is never read. So insert and trim are seen together or not at all. Each `fold_every` batches all rows are
    folded into one base, without the trimmed ones; the folders before stay for readers that began earlier, until `tidy`.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, ts: str, days: int, fold_every: int = 50) -> None:
        self.spark, self.path, self.key, self.ts, self.days, self.fold_every = spark, path.rstrip("/"), key, ts, days, fold_every

    def commits(self) -> list:
        """The commits, oldest first, a base after the batch that it closes; one row a batch."""
        try:
            rows = self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits/*").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(rows, key=lambda r: (r.batch, r.base))

    def commit(self, batch: int, folder: str, cutoff, base: bool) -> None:
        row = self.spark.createDataFrame([(batch, folder, cutoff, base)], COMMIT)
        row.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/commits/{batch}{'-base' if base else ''}")

    def apply(self, batch: DataFrame, batch_id: int) -> bool:
        """Inserts and trims; False, without a change, if the batch was committed before."""
        done = self.commits()
        if any(c.batch == batch_id for c in done):
            return False
        folder = f"{self.path}/data/{batch_id}-{uuid.uuid4().hex}"
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.parquet(folder)
        now = self.spark.read.schema(batch.schema).parquet(folder).agg(F.max(self.ts).cast("timestamp") - F.make_dt_interval(F.lit(self.days))).first()[0]
        cutoff = max((c for c in (now, *(d.cutoff for d in done)) if c is not None), default=None)
        self.commit(batch_id, folder, cutoff, False)
        if sum(not c.base for c in self.live(done)) + 1 >= self.fold_every:
            base = f"{self.path}/data/{batch_id}-base-{uuid.uuid4().hex}"
            self.rows(batch.columns, batch.schema).withColumn("_batch", F.lit(batch_id).cast("long")).write.parquet(base)
            self.commit(batch_id, base, cutoff, True)
        return True

    @staticmethod
    def live(commits: list) -> list:
        """The last base and what came after it."""
        last = max((k for k, c in enumerate(commits) if c.base), default=0)
        return commits[last:]

    def rows(self, columns: list[str], schema) -> DataFrame:
        """The history as of the last commit: the last row of each key (ties within a batch: the latest, then the
        greatest), if it is not trimmed. Keys may have any number of rows; they are reduced before they are shuffled."""
        live = self.live(self.commits())
        if not live:
            return self.spark.createDataFrame([], schema)
        stored = self.spark.read.schema(schema.add("_batch", "long") if "_batch" not in schema.names else schema).parquet(*(c.folder for c in live))
        whole = F.struct(*(F.col(f"`{c}`") for c in columns))
        last = stored.groupBy(self.key).agg(F.max(F.struct("_batch", F.col(self.ts).alias("_ts"), whole.alias("_row")))["_row"].alias("_row"))
        kept = last.select(*(F.col("_row").getField(c).alias(c) for c in columns))
        cutoff = live[-1].cutoff
        return kept if cutoff is None else kept.filter(F.col(self.ts).cast("timestamp") >= F.lit(cutoff))
