"""Row weights and row samples, decided row by row from stable keys."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.random import bag_stream, counter_uniform, normal, uniform
from .ranges import percentile, place, running


def bag(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Rows whose draw is below the fraction; never empty: without any, the smallest draw stays."""
    drawn = df.withColumn("__u", uniform(F.col(key), seed))
    least = drawn.agg(F.min("__u").alias("__least"))
    return drawn.crossJoin(F.broadcast(least)).filter((F.col("__u") < fraction) | ((F.col("__least") >= fraction) & (F.col("__u") == F.col("__least")))).drop("__u", "__least")


def counter_bag(df: DataFrame, row: str, fraction: float, seed: int = 3, number: int = 0) -> DataFrame:
    """Bag `number` of rows numbered 0, 1, ...: those whose draw of the bag's counter stream is below the fraction; without
    any, the one with the smallest draw."""
    drawn = df.withColumn("__u", counter_uniform(bag_stream(seed, number), F.col(row)))
    least = drawn.agg(F.min_by(F.struct(F.col(row).alias("r"), F.col("__u").alias("u")), F.struct("__u", row)).alias("__m"))
    alone = (F.col("__m.u") >= fraction) & (F.col(row) == F.col("__m.r"))
    return drawn.crossJoin(F.broadcast(least)).filter((F.col("__u") < fraction) | alone).drop("__u", "__m")  # one row


def bin_sample(df: DataFrame, key: str, count: int, seed: int = 1) -> DataFrame:
    """About `count` rows for fitting bins, by a hash of the key; all of them if there are no more."""
    n = df.count()
    return df if count <= 0 or count >= n else df.filter(uniform(F.col(key), seed) < count / n)


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Add fold 0..k-1 so that each class is dealt evenly: rows of a class take turns in the order of a hash of the key."""
    rows = df.withColumn("__u", uniform(F.col(key), seed))
    order = ["__u", key]
    dealt = running(place(rows, [label, *order]), {"__i": F.lit(1)}, [label], order)
    return dealt.withColumn("fold", (F.col("__i") % k).cast("int")).drop("__u", "__i", "__p")


def langevin(df: DataFrame, key: str, columns: list[str], rate: float, temperature: float, seed: int = 0) -> DataFrame:
    """Normal noise of variance 2 / (rate * temperature) on derivatives, keyed by row."""
    scale = math.sqrt(2.0 / rate / temperature)
    return df.withColumns({c: F.col(c) + scale * normal(F.concat_ws(":", F.col(key).cast("string"), F.lit(c)), seed) for c in columns})


def class_bag(df: DataFrame, key: str, label: str, positive: float, negative: float, seed: int = 0) -> DataFrame:
    """Separate fractions for label > 0 and the rest; every class that is there keeps a row."""
    drawn = df.withColumn("__u", uniform(F.col(key), seed)).withColumn("__c", (F.col(label) > 0).cast("int"))
    least = drawn.groupBy("__c").agg(F.min("__u").alias("__least")).withColumnRenamed("__c", "__cc")
    f = F.when(F.col("__c") == 1, positive).otherwise(negative)
    out = drawn.join(F.broadcast(least), F.col("__c") == F.col("__cc"))  # two rows
    return out.filter((F.col("__u") < f) | ((F.col("__least") >= f) & (F.col("__u") == F.col("__least")))).drop("__u", "__c", "__cc", "__least")


def query_bag(df: DataFrame, group: str, fraction: float, seed: int = 0) -> DataFrame:
    """Whole queries."""
    return df.filter(uniform(F.col(group), seed) < fraction)


def bayesian_weight(df: DataFrame, key: str, temperature: float = 1.0, seed: int = 0, out: str = "weight") -> DataFrame:
    return df.withColumn(out, F.pow(-F.log(uniform(F.col(key), seed) + 1e-100), F.lit(float(temperature))))


def goss(df: DataFrame, key: str, grad: str, hess: str, top_rate: float = 0.2, other_rate: float = 0.1, seed: int = 0) -> DataFrame:
    """Rows with large gradients and a sample of the others, whose multiplier restores the sums."""
    size = F.abs(F.col(grad) * F.col(hess))
    cutoff = percentile(df, size, 1 - top_rate).select(F.col("value").alias("__t"))
    big = size >= F.col("__t")
    out = df.crossJoin(F.broadcast(cutoff)).withColumn("multiplier", F.when(big, 1.0).otherwise((1 - top_rate) / other_rate))
    return out.filter(big | (uniform(F.col(key), seed) < other_rate / (1 - top_rate))).drop("__t")


def mvs(df: DataFrame, key: str, grad: str, threshold: float, lam: float = 1.0, seed: int = 0) -> DataFrame:
    """Minimal variance sampling: keep with probability min(1, sqrt(g*g + lambda) / threshold), weighted by its inverse."""
    p = F.least(F.lit(1.0), F.sqrt(F.col(grad) * F.col(grad) + lam) / threshold)
    return df.withColumn("__p", p).filter(uniform(F.col(key), seed) < F.col("__p")).withColumn("multiplier", 1 / F.col("__p")).drop("__p")


def mvs_threshold(df: DataFrame, grad: str, rate: float, lam: float = 1.0) -> float:
    """The threshold at which sum(min(1, m / threshold)) is rate * n, by bisection over one aggregate a step."""
    m = F.sqrt(F.col(grad) * F.col(grad) + lam)
    top = df.agg(F.count(F.lit(1)).alias("n"), F.sum(m).alias("s")).first()
    low, high = 0.0, (top["s"] or 0.0) / max(1e-300, rate * (top["n"] or 1))
    for _ in range(40):
        mid = (low + high) / 2
        if df.agg(F.sum(F.least(F.lit(1.0), m / mid)).alias("v")).first()["v"] > rate * top["n"]:
            low = mid
        else:
            high = mid
        if high - low <= 1e-9 * high:
            break
    return high


def class_weights(df: DataFrame, label: str, kind: str = "balanced") -> DataFrame:
    """(label, n, weight): balanced n / (K * count), or unbalance: negatives over positives for label > 0."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"), F.sum(F.when(F.col(label) > 0, F.col("n")).otherwise(0)).alias("pos"))
    w = F.col("all") / (F.col("k") * F.col("n")) if kind == "balanced" else F.when(F.col(label) > 0, (F.col("all") - F.col("pos")) / F.col("pos")).otherwise(1.0)
    return c.crossJoin(F.broadcast(t)).select(label, "n", w.alias("weight"))


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 0, group: str | None = None) -> DataFrame:
    """Add fold 0..k-1 by a hash of the key, or of the group so that a query stays whole."""
    return df.withColumn("fold", F.floor(uniform(F.col(group or key), seed) * k).cast("int"))
