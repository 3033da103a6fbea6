"""Sinks for micro-batches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


class LedgerSink:
    """Writes each batch into a folder of its own number, so a repeated delivery replaces itself: exactly once in effect."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, spark: SparkSession, schema) -> DataFrame:
        """All delivered rows; none before the first batch."""
        try:
            return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)


#: Statuses of passing trouble.
RETRY_STATUSES = (429, 502, 503, 504)


def bulk_report(written: DataFrame) -> DataFrame:
    """(status, retry, n) of per-item outcomes; only statuses of passing trouble are worth a retry."""
    retry = F.col("status").isin(*RETRY_STATUSES)
    return written.groupBy("status", retry.alias("retry")).agg(F.count("*").alias("n"))


def retry_rounds(items: DataFrame, attempt, key: str, most_retries: int = 3) -> DataFrame:
    """(key, status, attempts): outcomes of ``attempt(items) -> (key, status)``, with items of passing trouble tried again.

    An attempt must be idempotent. Items whose trouble doesn't pass keep their last status.
    """
    from orestrata.session import settle

    out, left = None, items
    for n in range(1, most_retries + 2):
        done = settle(attempt(left).select(key, "status", F.lit(n).alias("attempts")), "attempt")
        passing = F.col("status").isin(*RETRY_STATUSES)
        final = done if n == most_retries + 1 else done.where(~F.coalesce(passing, F.lit(False)))
        out = final if out is None else out.unionByName(final)
        if n > most_retries:
            return out
        left = items.join(done.where(passing).select(key), key, "left_semi")
    return out
