"""Runs that go on where they stopped: a ledger of finished stages, and appends that count once.

A stage's result is written below the run's folder, and then a row with its name goes to the ledger. A run begun again
reads what its ledger has and does the rest. Everything goes through Spark's readers and writers, so the folder may be in any store that
driver and executors share. What a stage wrote before it failed is overwritten when it is done again.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "stage string, attempt int, rows bigint, finished timestamp"


class Run:
    """A run of named stages in a folder of its own."""

    def __init__(self, spark: SparkSession, folder: str, attempts: int = 5) -> None:
        if attempts < 1:
            raise ValueError("attempts must be 1 or more")
        self.spark, self.folder, self.attempts = spark, folder.rstrip("/"), attempts

    def ledger(self) -> DataFrame:
        """A row for each finished stage: stage, attempt (from 1), rows and finished."""
        try:
            return self.spark.read.schema(LEDGER).parquet(f"{self.folder}/ledger")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LEDGER)

    def finished(self, stage: str) -> bool:
        return not self.ledger().where(F.col("stage") == stage).isEmpty()

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The result of a stage: as it was written, where the ledger has it, else what ``make`` gives, written now.

        A stage that fails is tried again, ``attempts`` times in all; then its last error goes on, and the run may be begun again later.
        """
        path = f"{self.folder}/stages/{name}"
        if not self.finished(name):
            for attempt in range(1, self.attempts + 1):
                try:
                    make().write.mode("overwrite").parquet(path)
                    break
                except Exception:
                    if attempt == self.attempts:
                        raise
            rows = self.spark.read.parquet(path).count()
            line = self.spark.createDataFrame([(name, attempt, rows)], "stage string, attempt int, rows bigint")
            line.withColumn("finished", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")
        return self.spark.read.parquet(path)


def append_once(df: DataFrame, table: str, batch: str) -> None:
    """Adds rows to a table under the id of their batch: a batch that is added again takes the place of its first rows, others stay."""
    rows = df.withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)
