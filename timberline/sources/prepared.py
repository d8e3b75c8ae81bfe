"""Ingest from memory, prepared tables with their bins, and fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.binning import Bins


def from_arrow(spark: SparkSession, table, row: str | None = None) -> DataFrame:
    """An Arrow table or record batch, numbered by `row` if named."""
    import pyarrow as pa

    whole = pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table
    if row is not None:
        whole = whole.append_column(row, pa.array(range(whole.num_rows), pa.int64()))
    return spark.createDataFrame(whole)


def from_chunks(spark: SparkSession, chunks, row: str = "row_id") -> DataFrame:
    """Chunks (each an Arrow or pandas table, or a callable that yields one) of one schema, with row ids across them."""
    import pyarrow as pa

    parts, start, schema = [], 0, None
    for k, c in enumerate(chunks):
        c = c() if callable(c) else c
        t = c if isinstance(c, pa.Table) else pa.Table.from_pandas(c, preserve_index=False)
        if schema is not None and t.schema != schema:
            raise ValueError(f"chunk {k} has another schema than the first")
        schema = t.schema
        parts.append(t.append_column(row, pa.array(range(start, start + t.num_rows), pa.int64())))
        start += t.num_rows
    return spark.createDataFrame(pa.concat_tables(parts))


def from_columns(spark: SparkSession, columns: dict) -> DataFrame:
    """Named lists or arrays of one length."""
    import pyarrow as pa

    sizes = {len(v) for v in columns.values()}
    if len(sizes) != 1:
        raise ValueError("columns must have one length")
    return spark.createDataFrame(pa.table({k: pa.array(v) for k, v in columns.items()}))


def fingerprint(bins: Bins) -> str:
    """A digest of the edges, levels and missing bins: equal for bins that send every value to the same bin."""
    return hashlib.sha256(json.dumps([bins.edges, bins.missing, bins.levels], sort_keys=True).encode()).hexdigest()


def checksum(df: DataFrame) -> DataFrame:
    """One row: rows and a sum over row hashes that does not depend on the order of rows."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("digest"))


def write_prepared(df: DataFrame, bins: Bins, path: str) -> None:
    """The binned table with its bins beside it."""
    bins.transform(df).write.mode("overwrite").parquet(f"{path}/rows")
    text = json.dumps({"edges": bins.edges, "missing": bins.missing, "levels": bins.levels, "fingerprint": fingerprint(bins)})
    df.sparkSession.createDataFrame([(text,)], "bins string").coalesce(1).write.mode("overwrite").text(f"{path}/bins")


def read_prepared(spark: SparkSession, path: str) -> tuple[DataFrame, Bins]:
    d = json.loads(spark.read.text(f"{path}/bins", wholetext=True).first()[0])
    bins = Bins(d["edges"], d["missing"], d["levels"])
    if fingerprint(bins) != d["fingerprint"]:
        raise ValueError("the bins don't match their fingerprint")
    return spark.read.parquet(f"{path}/rows"), bins
