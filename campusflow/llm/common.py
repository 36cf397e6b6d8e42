"""Shared pieces of the training-data operators.

Inputs are DataFrames with (at least) the columns an operator names; any other
column is ignored, whatever its name. Tables that are read more than once are
written below the session's shared checkpoint folder (``materialize``), so a
lost executor never loses them and no lineage is replayed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from campusflow.session import ensure_checkpoint_dir

#: Rows per Arrow batch: texts are long, so batches are kept small in bytes.
ARROW_ROWS = "1000"
#: Shuffle files go when the execution that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Session settings of the Arrow-backed operators."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    ensure_checkpoint_dir(spark)


class Shared:
    """Tables of one operator run in the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.root}/{self.n}"
        # What the write shuffled is of no use to later steps.
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path), path

    def table(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop(self, path: str) -> None:
        """Remove a table that nothing reads any more."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
