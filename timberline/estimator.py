"""Estimators with fit and predict over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import metrics
from .operators.boost import Model, Params, train
from .operators.validate import admit, check_labels, check_relevance


class Booster:
    """fit(df) then predict(df); parameters by any known alias."""

    default = "l2"

    def __init__(self, features: list[str], label: str, weight: str | None = None, key: str | None = None, **params):
        self.features, self.label, self.weight, self.key = features, label, weight, key
        self.params = Params.of(**{"objective": self.default, **params})
        self.model: Model | None = None

    def fit(self, df: DataFrame, valid: DataFrame | None = None):
        check_labels(df, self.label, self.params.objective if self.params.objective != "multiclass" else "l2", self.params.num_class if self.params.objective == "multiclass" else None)
        self.model = train(admit(df, self.features), self.features, self.label, self.params, self.weight, self.key, None if valid is None else admit(valid, self.features))
        return self

    def predict(self, df: DataFrame, **how) -> DataFrame:
        return self.model.predict(admit(df, self.features), **how)


class Regressor(Booster):
    def score(self, df: DataFrame) -> float:
        """R squared."""
        p, y = F.col("prediction"), F.col(self.label)
        return self.predict(df).agg((1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(y))).alias("r2")).first()["r2"]


class Classifier(Booster):
    default = "binary"

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """df with `probabilities`, one of each class, in the order of their codes."""
        out = self.predict(df)
        if self.params.num_class > 1:
            return out
        return out.withColumn("probabilities", F.array(1 - F.col("prediction"), F.col("prediction")))

    def score(self, df: DataFrame) -> float:
        """Accuracy."""
        out = self.predict(df)
        if self.params.num_class > 1:
            return out.agg(F.avg((F.col("prediction") == F.col(self.label)).cast("double"))).first()[0]
        return metrics.pointwise(out, "accuracy", self.label, "prediction").first()["value"]


class Ranker(Booster):
    """Learns to order the rows of each query; `group` names the query's column, `key` the rows'."""

    default = "lambdarank"

    def __init__(self, features: list[str], label: str, group: str, key: str, weight: str | None = None, **params):
        super().__init__(features, label, weight, key, group=group, **params)
        self.group = group

    def fit(self, df: DataFrame, valid: DataFrame | None = None):
        check_relevance(df, self.label)
        self.model = train(admit(df, self.features), self.features, self.label, self.params, self.weight, self.key, None if valid is None else admit(valid, self.features), metric="ndcg" if valid is not None else None)
        return self

    def score(self, df: DataFrame, k: int = 10) -> float:
        """Mean NDCG@k."""
        return metrics.ndcg(self.predict(df), self.group, self.label, "prediction", self.key, k).first()["value"]
