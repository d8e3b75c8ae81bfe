"""Table access, shared storage and packing helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans.storage import shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a local session without it gets one of its own."""
    return shared(spark)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that `materialise` has written, when nothing reads it any more."""
    spark = df.sparkSession
    home = shared_dir(spark).rstrip("/").removeprefix("file://")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"{home}/" in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(c):
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, with the memory of each given back to the system before the next: idle Python workers keep little."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        trim()


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: nothing to trim
        return None


def trim() -> None:
    """Give freed heap pages back to the system, where the C library can."""
    if _libc() is not None and hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 18):
    """Cut a batch into runs of rows with about `most_bytes` of text each, so that numpy work stays small."""
    text = batch.column(batch.schema.get_field_index(column))
    size = pa.compute.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(size):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def gapless(df: DataFrame, group: str, key: list, index: str) -> DataFrame:
    """Number the rows of each group 0, 1, ... in the order of the MD5 of the first key and then of `key`, without one
    task per group.

    A group is cut into ranges of the MD5's first 32 bits; the range counts (one row each, so a table whose size is the
    number of ranges) give every range its offset, and only rows of one range are sorted together. The order does not
    depend on the number of ranges. Rows alike in all of `key` are numbered in any order among themselves.
    """
    buckets = 8 * partitions(df.sparkSession)
    keyed = df.withColumn("__h", F.conv(F.substring(F.md5(F.coalesce(F.col(key[0]).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint"))
    keyed = keyed.withColumn("__b", F.shiftright(F.col("__h") * buckets, 32).cast("int"))
    counts = keyed.groupBy(F.col(group).alias("__g"), F.col("__b").alias("__gb")).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("__g").orderBy("__gb").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__g", "__gb", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    own = W.partitionBy(group, "__b").orderBy("__h", *key)
    return (
        keyed.join(offsets, keyed[group].eqNullSafe(offsets["__g"]) & (keyed["__b"] == offsets["__gb"]))
        .withColumn(index, F.col("__o") + F.row_number().over(own) - 1)
        .drop("__g", "__gb", "__b", "__o", "__h")
    )
