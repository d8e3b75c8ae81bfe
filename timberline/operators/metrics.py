"""Metrics as aggregates over (label, prediction, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ranges import place, running

EPS = 1e-15


def _terms(name: str, y: Column, p: Column, a: dict) -> Column:
    d = y - p
    q = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    pos = F.greatest(F.lit(EPS), p)
    alpha, c, rho = a.get("alpha", 0.9), a.get("fair_c", 1.0), a.get("tweedie_variance_power", 1.5)
    return {
        "l2": d * d,
        "rmse": d * d,
        "l1": F.abs(d),
        "quantile": F.when(d >= 0, d * alpha).otherwise(d * (alpha - 1)),
        "huber": F.when(F.abs(d) <= alpha, 0.5 * d * d).otherwise(alpha * (F.abs(d) - 0.5 * alpha)),
        "fair": c * F.abs(d) - c * c * F.log1p(F.abs(d) / c),
        "mape": F.abs(d) / F.greatest(F.lit(1.0), F.abs(y)),
        "poisson": p - y * F.log(pos),
        "gamma": y / pos + F.log(pos),
        "gamma_deviance": 2 * (F.log(pos / F.greatest(F.lit(EPS), y)) + y / pos - 1),
        "tweedie": -y * F.pow(pos, 1 - rho) / (1 - rho) + F.pow(pos, 2 - rho) / (2 - rho),
        "binary_logloss": -(y * F.log(q) + (1 - y) * F.log(1 - q)),
        "cross_entropy": -(y * F.log(q) + (1 - y) * F.log(1 - q)),
        "kldiv": F.when(y > 0, y * F.log(F.greatest(F.lit(EPS), y) / q)).otherwise(0.0) + F.when(y < 1, (1 - y) * F.log(F.greatest(F.lit(EPS), 1 - y) / (1 - q))).otherwise(0.0),
        "binary_error": ((p >= 0.5).cast("double") - y != 0).cast("double"),
        "accuracy": ((p >= 0.5).cast("double") == y).cast("double"),
    }[name]


#: Metrics that are a weighted mean over rows, and whether higher is better.
POINTWISE = {"l2": False, "rmse": False, "l1": False, "quantile": False, "huber": False, "fair": False, "mape": False, "poisson": False, "gamma": False, "gamma_deviance": False, "tweedie": False, "binary_logloss": False, "cross_entropy": False, "kldiv": False, "binary_error": False, "accuracy": True}


def pointwise(df: DataFrame, name: str, label: str, prediction: str, weight: str | None = None, args: dict | None = None) -> DataFrame:
    """One row: (metric, value)."""
    w = F.col(weight) if weight else F.lit(1.0)
    mean = F.sum(_terms(name, F.col(label), F.col(prediction), args or {}) * w) / F.sum(w)
    return df.agg(F.lit(name).alias("metric"), (F.sqrt(mean) if name == "rmse" else mean).alias("value"))


def score_blocks(df: DataFrame, label: str, score: str, weight: str | None = None) -> DataFrame:
    """(score, pos, neg): tied scores pre-aggregated to one block."""
    w = F.col(weight) if weight else F.lit(1.0)
    return df.groupBy(F.col(score).alias("score")).agg(F.sum(F.when(F.col(label) > 0, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(label) > 0, 0.0).otherwise(w)).alias("neg"))


def ranked_blocks(blocks: DataFrame, parts: int | None = None) -> DataFrame:
    """Blocks with pos and neg above them, by ranges of score: only the range totals (one row each) are summed in one place."""
    order = [F.desc("score")]
    return running(place(blocks, order, parts), {"pos_above": F.col("pos"), "neg_above": F.col("neg")}, [], order)


def auc(df: DataFrame, label: str, score: str, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve; tied scores count half; 1 if only one class is there."""
    r = ranked_blocks(score_blocks(df, label, score, weight))
    area = F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2))
    both = F.sum("pos") * F.sum("neg")
    return r.agg(F.lit("auc").alias("metric"), F.when(both > 0, area / both).otherwise(1.0).alias("value"))


def average_precision(df: DataFrame, label: str, score: str, weight: str | None = None) -> DataFrame:
    r = ranked_blocks(score_blocks(df, label, score, weight))
    at = F.col("pos") * (F.col("pos_above") + F.col("pos")) / (F.col("pos_above") + F.col("pos") + F.col("neg_above") + F.col("neg"))
    return r.agg(F.lit("average_precision").alias("metric"), (F.sum(at) / F.sum("pos")).alias("value"))


def multiclass(df: DataFrame, name: str, label: str, probabilities: str) -> DataFrame:
    """multi_logloss or multi_error over an array of probabilities; the first largest class is predicted."""
    if name == "multi_logloss":
        each = -F.log(F.greatest(F.element_at(probabilities, F.col(label).cast("int") + 1), F.lit(EPS)))
    else:
        each = (F.array_position(probabilities, F.array_max(probabilities)) - 1 != F.col(label)).cast("double")
    return df.agg(F.lit(name).alias("metric"), F.avg(each).alias("value"))


def ranks(df: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """Add __rank by score and __ideal by label within each query, from 1; ties by `tie`."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), tie)))


def ndcg(df: DataFrame, group: str, label: str, score: str, tie: str, k: int = 10) -> DataFrame:
    """Mean NDCG@k over queries with gains 2^label - 1; a query without relevant rows counts 1."""
    r = ranks(df, group, score, tie).withColumn("__ideal", F.row_number().over(W.partitionBy(group).orderBy(F.desc(label), tie)))
    gain = F.pow(F.lit(2.0), F.col(label)) - 1
    q = r.groupBy(group).agg(F.sum(F.when(F.col("__rank") <= k, gain / F.log2(F.col("__rank") + 1)).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("__ideal") <= k, gain / F.log2(F.col("__ideal") + 1)).otherwise(0.0)).alias("ideal"))
    return q.agg(F.lit(f"ndcg@{k}").alias("metric"), F.avg(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(1.0)).alias("value"))


def mean_average_precision(df: DataFrame, group: str, label: str, score: str, tie: str, k: int = 10) -> DataFrame:
    """Mean AP@k; labels above 0 are relevant; the denominator is min(k, relevant); without relevant rows 1."""
    r = ranks(df, group, score, tie).withColumn("__hits", F.sum((F.col(label) > 0).cast("int")).over(W.partitionBy(group).orderBy("__rank")))
    hit = (F.col(label) > 0) & (F.col("__rank") <= k)
    q = r.groupBy(group).agg(F.sum(F.when(hit, F.col("__hits") / F.col("__rank")).otherwise(0.0)).alias("s"), F.sum((F.col(label) > 0).cast("int")).alias("m"))
    return q.agg(F.lit(f"map@{k}").alias("metric"), F.avg(F.when(F.col("m") > 0, F.col("s") / F.least(F.lit(k), F.col("m"))).otherwise(1.0)).alias("value"))


def ndcg_queries(df: DataFrame, group: str, label: str, score: str, tie: str, k: int = 10, gains: list[float] | None = None) -> DataFrame:
    """(group, value): NDCG@k of every query, with the gains of labels 0, 1, ... as given."""
    gain = F.pow(F.lit(2.0), F.col(label)) - 1 if gains is None else F.element_at(F.array(*[F.lit(float(g)) for g in gains]), F.col(label).cast("int") + 1)
    r = ranks(df, group, score, tie).withColumn("__gain", gain)
    r = r.withColumn("__ideal", F.row_number().over(W.partitionBy(group).orderBy(F.desc("__gain"), tie)))
    part = lambda at: F.sum(F.when(F.col(at) <= k, F.col("__gain") / F.log2(F.col(at) + 1)).otherwise(0.0))
    q = r.groupBy(group).agg(part("__rank").alias("dcg"), part("__ideal").alias("ideal"))
    return q.select(group, F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(1.0).alias("value"))


def query_mean(queries: DataFrame, group: str, weights: DataFrame | None = None) -> DataFrame:
    """The mean of per-query values, weighted by a table (group, weight) if given."""
    if weights is None:
        return queries.agg(F.avg("value").alias("value"))
    return queries.join(weights, group).agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"))


def pfound(df: DataFrame, group: str, label: str, score: str, tie: str, decay: float = 0.85) -> DataFrame:
    """Mean PFound: the chance that a reader who goes on with probability `decay` finds what they look for."""
    r = ranks(df, group, score, tie)
    before = W.partitionBy(group).orderBy("__rank").rowsBetween(W.unboundedPreceding, -1)
    look = F.exp(F.coalesce(F.sum(F.log(F.greatest(1 - F.col(label), F.lit(1e-300)))).over(before), F.lit(0.0))) * F.pow(F.lit(decay), F.col("__rank") - 1)
    return r.withColumn("__p", look * F.col(label)).groupBy(group).agg(F.sum("__p").alias("p")).agg(F.lit("pfound").alias("metric"), F.avg("p").alias("value"))


def cox_partial_loglik(df: DataFrame, time: str, event: str, raw: str) -> DataFrame:
    """Partial log likelihood; the risk set of a row is all rows with at least its time. Times are pre-aggregated."""
    t = df.groupBy(F.col(time).alias("t")).agg(F.sum(F.exp(raw)).alias("e"), F.sum(F.when(F.col(event) > 0, F.col(raw)).otherwise(0.0)).alias("s"), F.sum((F.col(event) > 0).cast("int")).alias("d"))
    after = [F.desc("t")]
    risk = running(place(t, after), {"later": F.col("e")}, [], after)
    return risk.agg(F.lit("cox").alias("metric"), F.sum(F.col("s") - F.col("d") * F.log(F.col("later") + F.col("e"))).alias("value"))


def multi_rmse(df: DataFrame, labels: list[str], predictions: list[str]) -> DataFrame:
    """Root of the squared errors of all targets that are there, over the number of rows with any."""
    each = [F.coalesce((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)), F.lit(0.0)) for y, p in zip(labels, predictions)]
    there = F.coalesce(*labels).isNotNull().cast("int")
    return df.agg(F.lit("multi_rmse").alias("metric"), F.sqrt(F.sum(sum(each[1:], each[0])) / F.sum(there)).alias("value"))


def evaluate(df: DataFrame, fn, label: str, prediction: str, weight: str | None = None) -> DataFrame:
    """A custom metric: fn(label, prediction, weight) gives an aggregate column."""
    return df.agg(F.lit("custom").alias("metric"), fn(F.col(label), F.col(prediction), F.col(weight) if weight else F.lit(1.0)).alias("value"))


def registry(spark) -> DataFrame:
    """(metric, higher_is_better) of all metrics by name."""
    known = {**POINTWISE, "auc": True, "average_precision": True, "multi_logloss": False, "multi_error": False, "ndcg": True, "map": True, "pfound": True, "cox": True, "multi_rmse": False}
    return spark.createDataFrame(sorted(known.items()), "metric string, higher_is_better boolean")
