"""Chunked ingest of streams: every micro-batch becomes a chunk of a Parquet table, once, and row ids are checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import DataError, check_row_ids


def ingest(stream: DataFrame, path: str, checkpoint: str, row: str | None = None):
    """Start writing a stream in chunks; a batch that is run again overwrites its own chunk. With `row`, a batch that repeats
    a row id raises."""

    def write(batch: DataFrame, number: int) -> None:
        if row is not None and batch.groupBy(row).count().filter("count > 1").limit(1).count():
            raise DataError(f"batch {number} repeats a row id")
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/chunk={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def coverage(spark: SparkSession, path: str, row: str, start: int = 0) -> DataFrame:
    """(chunk, n, first, last) of an ingested table, after checking that its row ids have no gaps or repeats."""
    df = spark.read.parquet(path)
    check_row_ids(df, row, start)
    return df.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("first"), F.max(row).alias("last"))
