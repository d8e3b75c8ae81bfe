"""The functional interface: a data set with its roles, train, cv, and a booster."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .operators import cv as _cv
from .operators import inspect
from .operators.boost import Model, Params
from .operators.boost import train as _train
from .sources import io
from .operators.validate import admit, check_labels, check_weights


class Dataset:
    """A table with the roles of its columns. Checks run once, when it is first trained on."""

    def __init__(self, df: DataFrame, label: str, features: list[str] | None = None, weight: str | None = None, group: str | None = None, key: str | None = None, categorical: list[str] = ()):
        roles = {label, weight, group, key}
        self.df, self.label, self.weight, self.group, self.key = df, label, weight, group, key
        self.features = features or [c for c in df.columns if c not in roles]
        self.categorical = list(categorical)

    def checked(self) -> DataFrame:
        check_labels(self.df, self.label)
        if self.weight:
            check_weights(self.df, self.weight)
        return admit(self.df, [c for c in self.features if c not in self.categorical])

    def subset(self, condition: str) -> "Dataset":
        return Dataset(self.df.filter(condition), self.label, self.features, self.weight, self.group, self.key, self.categorical)


class Booster:
    """A trained model and what can be read from it."""

    def __init__(self, model: Model, spark):
        self.model, self.spark = model, spark

    def predict(self, df: DataFrame, raw_score: bool = False, pred_leaf: bool = False, pred_contrib: bool = False, start_iteration: int = 0, num_iteration: int | None = None) -> DataFrame:
        if pred_contrib:
            return inspect.contributions(df, self.model)
        kind = "leaf" if pred_leaf else "raw" if raw_score else "response"
        return self.model.predict(df, kind, start_iteration, num_iteration)

    def num_trees(self) -> int:
        return len(self.model.trees)

    def feature_name(self) -> list[str]:
        return self.model.features

    def feature_importance(self, importance_type: str = "split") -> DataFrame:
        return inspect.importance(self.trees_to_dataframe(), importance_type)

    def trees_to_dataframe(self) -> DataFrame:
        return inspect.node_table(self.spark, self.model)

    def refit(self, df: DataFrame, label: str, decay_rate: float = 0.9) -> "Booster":
        return Booster(inspect.refit(self.model, df, label, decay_rate), self.spark)

    def rollback_one_iter(self) -> "Booster":
        return Booster(inspect.rollback(self.model), self.spark)

    def model_to_string(self) -> str:
        return io.dumps(self.model)

    def save_model(self, path: str) -> None:
        io.save(self.spark, self.model, path)


def parameters(params: dict, data: Dataset, num_boost_round: int, early_stopping_rounds: int = 0) -> Params:
    extra = {"group": data.group} if data.group else {}
    rounds = {} if {"num_iterations", "n_estimators", "num_trees", "num_round"} & set(params) else {"num_iterations": num_boost_round}
    return Params.of(**{**params, **rounds, **extra, "categorical": data.categorical, "early_stopping_round": early_stopping_rounds})


def train(params: dict, data: Dataset, num_boost_round: int = 100, valid: Dataset | None = None, early_stopping_rounds: int = 0, metric=None, custom=None, init_model: Booster | None = None, callbacks=()) -> Booster:
    p = parameters(params, data, num_boost_round, early_stopping_rounds)
    model = _train(data.checked(), data.features, data.label, p, data.weight, data.key, None if valid is None else valid.checked(), custom, init_model.model if init_model else None, callbacks, metric=metric)
    return Booster(model, data.df.sparkSession)


def cv(params: dict, data: Dataset, num_boost_round: int = 100, nfold: int = 5, stratified: bool = False, seed: int = 0, metric=None) -> dict:
    if data.key is None:
        raise ValueError("folds need a row key")
    return _cv.cv(data.checked(), data.features, data.label, data.key, parameters(params, data, num_boost_round), nfold, seed, data.group, stratified, metric)


def load(spark, path: str) -> Booster:
    return Booster(io.load(spark, path), spark)
