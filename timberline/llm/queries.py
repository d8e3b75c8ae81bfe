"""The registered queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embeddings, html_text, jaccard, langid, licenses, mixing, sharding, simhash, substrings
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare(table(spark, sf_dir, "documents"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 24)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.dedup(table(spark, sf_dir, "embeddings"))


def simhash_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 50, against the fingerprints of all documents."""
    docs = table(spark, sf_dir, "documents")
    prints = simhash.fingerprint(docs)
    return simhash.search(prints, prints.filter("doc_id % 50 = 0"))


QUERIES: dict[str, Query] = {
    "op7_mixing": op7_mixing,
    "op5_language": op5_language,
    "op4_simhash": op4_simhash,
    "op3_substrings": op3_substrings,
    "op2_licenses": op2_licenses,
    "op1_html": op1_html,
    "op6_sharding": op6_sharding,
    "op8_bpe": op8_bpe,
    "op10_embeddings": op10_embeddings,
    "op9_jaccard": op9_jaccard,
    "simhash_search": simhash_search,
}

ORACLES: dict[str, str] = {
    "op2_licenses": licenses.oracle(),
    "op3_substrings": substrings.oracle(),
    "op6_sharding": sharding.oracle(),
    "op7_mixing": mixing.oracle(),
    "op9_jaccard": jaccard.oracle(),
    "op10_embeddings": embeddings.oracle(),
}
