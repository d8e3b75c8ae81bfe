"""Cross-validation over hash folds."""

from __future__ import annotations

import statistics

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boost import Model, Params, judged, train
from .sampling import folds, stratified_folds


def cv(df: DataFrame, features: list[str], label: str, key: str, params: Params, k: int = 5, seed: int = 0, group: str | None = None, stratified: bool = False, metric=None) -> dict:
    """{losses, mean, stdv (population), models} over k folds, by the objective's own loss or a metric (name or callable)."""
    dealt = stratified_folds(df, key, label, k, seed) if stratified else folds(df, key, k, seed, group)
    losses, models = [], []
    for i in range(k):
        model: Model = train(dealt.filter(F.col("fold") != i), features, label, params, key=key)
        models.append(model)
        held = model.bins.transform(dealt.filter(F.col("fold") == i))
        held = held.withColumns({f"__r{c}": r for c, r in enumerate(model.raw())})
        losses.append(judged(held, model, label, F.lit(1.0), metric)[0])
    return {"losses": losses, "mean": statistics.fmean(losses), "stdv": statistics.pstdev(losses), "models": models}
