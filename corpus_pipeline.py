"""Corpus pipeline: language ID, near duplicates, repeated passages, source mixing and tokenization, in this order.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. Between stages the table is written and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import bpe, jaccard, langid, mixing, substrings
from timberline.llm.common import forget, partitions, shared_dir


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is known: not `und`, and with some evidence in the text.

    The model learns from the labelled rows of `docs` that are not held out.
    """
    columns = docs.columns
    extra = tuple(dict.fromkeys(["doc_id", *columns]))
    return langid.predict(docs, langid.fit(docs), extra, ("__lang", "__score")).filter((F.col("__lang") != "und") & (F.col("__score") > 0)).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles at 0.8 or more, the one with the smallest doc_id stays.

    Rows with a null doc_id link with nothing and stay, as do null and empty texts; rows that share a doc_id stay or go together.
    """
    groups = jaccard.join(docs).select(F.col("doc_id").alias("__d"), F.col("component_id").alias("__c"))
    gone = groups.filter("__d <> __c").select("__d").distinct()
    return docs.join(gone, docs["doc_id"] == gone["__d"], "left_anti")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take passages of 50 words or more that an earlier document holds out of the text; n_chars follows the text."""
    columns = docs.columns
    out = substrings.dedup(docs, text=True)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents into the order of the mix; files read in order of their names hold the mixture.

    Null ids and sources are keys like any other; rows with one id and source follow each other, in no order of their own.
    An empty table stays empty.
    """
    columns = docs.columns
    place = mixing.mix(docs).select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("position").alias("__p"))
    place = place.groupBy("__d", "__s").agg(F.min("__p").alias("__p"))
    joined = docs.join(place.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(place["__d"]) & docs["source"].eqNullSafe(place["__s"]))
    return joined.repartitionByRange(partitions(spark), "__p").sortWithinPartitions("__p").select(*columns)


def in_order(docs: DataFrame, name: str) -> DataFrame:
    """Number the rows of a Parquet table 0, 1, ... in the order of its file names and of the rows in them."""
    rows = docs.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    sizes = sorted(tuple(r) for r in rows.groupBy("__file").count().collect())  # a row per file
    starts, total = [], 0
    for file, n in sizes:
        starts.append((file, total))
        total += n
    starts = F.broadcast(docs.sparkSession.createDataFrame(starts, "__file string, __start bigint"))
    return rows.join(starts, "__file").withColumn(name, F.col("__start") + F.col("__row")).drop("__file", "__row", "__start")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, with its place in the mix as the stage before has written it.

    Null texts count as empty; every row has a place of its own, whatever its id. An empty table gives none.
    """
    return bpe.encode(in_order(docs, "mix_position"), keep=("doc_id", "mix_position"))


STAGES = [
    ("language ID", languages),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", passages),
    ("source mixing", mixture),
    ("BPE", tokens),
]

#: The BPE merges and the learned language filters have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{shared_dir(spark).rstrip('/')}/stage-{k}-{uuid.uuid4().hex}"
            out.write.parquet(path)
            if k:
                forget(docs)
            docs = spark.read.parquet(path)
    return out
