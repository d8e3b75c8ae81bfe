"""Scoring a stream: the model is a set of CASE expressions, so a streaming table is scored as any other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.boost import Model


def score(stream: DataFrame, model: Model) -> DataFrame:
    """Stateless: prediction for every row of a streaming (or batch) table."""
    return model.predict(stream)


def windowed_mean(stream: DataFrame, model: Model, time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean prediction and row count per time window, with a watermark for late rows."""
    scored = score(stream.withWatermark(time, late), model)
    return scored.groupBy(F.window(time, width).alias("w")).agg(F.avg("prediction").alias("mean_prediction"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "mean_prediction", "n")
