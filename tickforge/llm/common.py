"""What the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds on one Arrow batch: texts may be very long, and a worker holds a few batches.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python workers are cut by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def unused(docs: DataFrame) -> str:
    """A prefix with which no column name of ``docs`` can begin."""
    return "_" * (1 + max(map(len, docs.columns)))


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds, F.lit(-1))


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """``(doc_id, label)`` with one row per id. Of several labels the majority counts, a tie is 1;
    null labels and null ids count for nothing."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
            .groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label")))
