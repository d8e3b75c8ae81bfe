"""Query groups: boundaries, audits, repairs and position codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ranges import neighbours, place, running
from .validate import DataError


def from_counts(spark: SparkSession, counts: list[int], empty: str = "raise") -> DataFrame:
    """(query, n, start) of consecutive queries; empty ones are an error or dropped, which moves no row."""
    if not counts:
        raise DataError("there must be at least one query")
    if any(n < 0 for n in counts):
        raise DataError("group counts must not be negative")
    if empty == "raise" and any(n == 0 for n in counts):
        raise DataError("group counts must be positive")
    rows, start = [], 0
    for q, n in enumerate(counts):
        if n:
            rows.append((q, n, start))
        start += n
    if not rows:
        raise DataError("every query is empty")
    return spark.createDataFrame(rows, "query int, n bigint, start bigint")


def from_ids(df: DataFrame, group: str, position: str) -> DataFrame:
    """(group, n, start) of queries in the order of their rows; a query whose rows are not consecutive raises.

    A run starts where the query differs from that of the row before; there must be as many runs as queries.
    """
    placed = place(df.select(F.col(position).alias("__at"), F.col(group).alias("__q")), ["__at"])
    run = neighbours(placed, "__q", [], ["__at"], before="__ahead")
    first = F.col("__ahead").isNull() | (F.col("__ahead") != F.col("__q"))
    run = running(run.withColumn("__new", first.cast("long")), {"__seen": F.lit(1)}, [], ["__at"])
    runs = run.groupBy("__q").agg(F.sum("__new").alias("runs"), F.count(F.lit(1)).alias("n"), F.min("__seen").alias("start"))
    broken = runs.filter("runs > 1").limit(1).collect()
    if broken:
        raise DataError(f"the rows of query {broken[0]['__q']} are not consecutive")
    return runs.select(F.col("__q").alias(group), "n", F.col("start").cast("long").alias("start"))


def audit(df: DataFrame, group: str, label: str, position: str, truncation: int = 30) -> DataFrame:
    """One row: queries, rows, smallest and largest query, single, all-zero and tied queries, and those with pairs to learn
    from, with their pairs of the first `truncation` positions.

    Pairs are counted from the counts of labels ahead, never listed.
    """
    at = W.partitionBy(group).orderBy(position)
    r = df.withColumn("__i", F.row_number().over(at)).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(group)))
    later = F.count(F.lit(1)).over(at.rowsBetween(1, W.unboundedFollowing))
    same = F.count(F.lit(1)).over(W.partitionBy(group, label).orderBy(position).rowsBetween(1, W.unboundedFollowing))
    pairs = F.when(F.col("__i") <= F.least(F.lit(truncation), F.col("__n") - 1), later - same).otherwise(0)
    q = r.withColumn("__p", pairs).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("low"), F.max(label).alias("high"), F.sum("__p").alias("pairs"))
    flag = lambda c: F.sum(c.cast("long"))
    able = (F.col("pairs") > 0) & (F.col("high") > 0)
    return q.agg(F.count(F.lit(1)).alias("n_queries"), F.sum("n").alias("n_rows"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), flag(F.col("n") == 1).alias("n_single"), flag(F.col("high") == 0).alias("n_zero"), flag(F.col("low") == F.col("high")).alias("n_tied"), flag(able).alias("n_pairable"), F.sum(F.when(able, F.col("pairs")).otherwise(0)).alias("n_pairs"))


def prune(df: DataFrame, group: str, label: str) -> DataFrame:
    """The rows of queries that can teach an order: some label above 0, and two labels that differ."""
    q = df.groupBy(F.col(group).alias("__q")).agg(F.min(label).alias("__low"), F.max(label).alias("__high")).filter("__low < __high AND __high > 0")
    return df.join(q.select("__q"), df[group] == F.col("__q"), "left_semi")


def position_codes(df: DataFrame, position: str) -> DataFrame:
    """(position, code): codes 0, 1, ... of the positions that occur, in their order; as many rows as positions."""
    each = df.filter(F.col(position).isNotNull()).select(F.col(position).alias("position")).distinct()
    return running(place(each, ["position"]), {"code": F.lit(1)}, [], ["position"]).select("position", F.col("code").cast("int").alias("code"))
