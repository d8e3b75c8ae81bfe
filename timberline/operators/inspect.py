"""Model tables: views, edits and contributions."""

from __future__ import annotations

import copy
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boost import Model, derive, leaf_value, ordinals, route

SCHEMA = "tree_index int, node int, depth int, feature int, feature_name string, bin int, threshold double, default_left boolean, missing_bin int, left_child int, right_child int, value double, gain double, n bigint, weight double"


def node_table(spark: SparkSession, model: Model) -> DataFrame:
    """One row per node of every tree."""
    rows = []
    for i, t in enumerate(model.trees):
        for n in t:
            f = n["feature"]
            leaf = f is None
            rows.append((i, n["node"], n["depth"], f, None if leaf else model.features[f], None if leaf else n["bin"], None if leaf or n["threshold"] is None else float(n["threshold"]), None if leaf else bool(n["default_left"]), None if leaf else n["missing_bin"], None if leaf else n["left"], None if leaf else n["right"], float(n["value"]), None if leaf else float(n["gain"]), int(n["count"]), float(model.weights[i])))
    return spark.createDataFrame(rows, SCHEMA)


def importance(nodes: DataFrame, kind: str = "split") -> DataFrame:
    """(feature_name, importance): number of splits, or summed gain."""
    value = F.count(F.lit(1)) if kind == "split" else F.sum("gain")
    return nodes.filter("feature IS NOT NULL").groupBy("feature_name").agg(value.alias("importance"))


def split_values(nodes: DataFrame, feature: str) -> DataFrame:
    """(threshold, n) of a feature's splits."""
    return nodes.filter(F.col("feature_name") == feature).groupBy("threshold").agg(F.count(F.lit(1)).alias("n"))


def score_bounds(model: Model) -> list[tuple[float, float]]:
    """For every output, the least and largest raw score that the leaves allow."""
    out = []
    for c, base in enumerate(model.base):
        leaves = [[n["value"] * w for n in t if n["feature"] is None] for t, w in list(zip(model.trees, model.weights))[c :: model.outputs]]
        out.append((base + sum(map(min, leaves)), base + sum(map(max, leaves))))
    return out


def rollback(model: Model, rounds: int = 1) -> Model:
    k = len(model.trees) - rounds * model.outputs
    if k < 0:
        raise ValueError("there are fewer rounds")
    out = copy.copy(model)
    out.trees, out.weights = model.trees[:k], model.weights[:k]
    return out


def permute(model: Model, order: list[int]) -> Model:
    """Rounds in another order; scores don't change."""
    if sorted(order) != list(range(len(model.trees) // model.outputs)):
        raise ValueError("the order must hold every round once")
    k, out = model.outputs, copy.copy(model)
    out.trees = [model.trees[i * k + c] for i in order for c in range(k)]
    out.weights = [model.weights[i * k + c] for i in order for c in range(k)]
    return out


def set_leaf(model: Model, tree: int, ordinal: int, value: float) -> Model:
    if not math.isfinite(value):
        raise ValueError("a leaf value must be finite")
    out = copy.deepcopy(model)
    node = next(k for k, v in ordinals(out.trees[tree]).items() if v == ordinal)
    out.trees[tree][node]["value"] = value
    return out


def get_leaf(model: Model, tree: int, ordinal: int) -> float:
    return model.trees[tree][next(k for k, v in ordinals(model.trees[tree]).items() if v == ordinal)]["value"]


def shrink(model: Model, factor: float) -> Model:
    """The model with all trees scaled by a factor; base scores stay."""
    if not math.isfinite(factor):
        raise ValueError("the factor must be finite")
    out = copy.copy(model)
    out.weights = [w * factor for w in model.weights]
    return out


def refit(model: Model, df: DataFrame, label: str, decay: float = 0.9) -> Model:
    """New leaf values on other data: decay * old + (1 - decay) * fresh; leaves without rows keep theirs. The trees of a
    round are refitted together, in one query, on the scores of the rounds before it."""
    out, k = copy.deepcopy(model), model.outputs
    rows = model.bins.transform(df)
    for start in range(0, len(out.trees), k):
        part = copy.copy(out)
        part.trees, part.weights = out.trees[:start], out.weights[:start]
        given, _ = derive(rows, label, part.raw(), F.lit(1.0), model.params, None)
        cells = [F.struct(F.lit(c).alias("tree"), route(out.trees[start + c], lambda n: F.lit(n["node"]), model.features).alias("leaf"), F.col(f"g{c}").alias("g"), F.col(f"h{c}").alias("h")) for c in range(k)]
        sums = given.select(F.explode(F.array(*cells)).alias("e")).select("e.*").groupBy("tree", "leaf").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        for r in sums.collect():  # a row per leaf
            n = out.trees[start + r["tree"]][r["leaf"]]
            n["value"] = decay * n["value"] + (1 - decay) * leaf_value(r["g"], r["h"], model.params)
    return out


def paths(tree: list[dict]) -> list[tuple[float, list[tuple[int, float, list[tuple[dict, bool]]]]]]:
    """For every leaf its value and, for each feature on its way, the share of rows that goes its way and the tests."""
    out = []

    def walk(i: int, seen: dict) -> None:
        n = tree[i]
        if n["feature"] is None:
            out.append((n["value"], [(f, share, tests) for f, (share, tests) in seen.items()]))
            return
        for child, left in ((n["left"], True), (n["right"], False)):
            share, tests = seen.get(n["feature"], (1.0, []))
            walk(child, {**seen, n["feature"]: (share * tree[child]["count"] / max(1, n["count"]), [*tests, (n, left)])})

    walk(0, {})
    return out


def leaf_shares(met: np.ndarray, share: np.ndarray) -> np.ndarray:
    """(rows, features): Shapley values of a leaf of value 1 for the features on its way.

    `met` says whether a row passes a feature's tests, `share` how many rows do. The sets of other features enter by their
    size as coefficients of a polynomial; each feature is left out of it in turn. The cost grows with the third
    power of the way's length.
    """
    rows, d = met.shape
    out = np.zeros((rows, d))
    size = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
    for i in range(d):
        part = np.zeros((rows, d))
        part[:, 0] = 1.0
        for j in range(d):
            if j != i:
                part = part * share[j] + np.pad(part, ((0, 0), (1, 0)))[:, :d] * met[:, j : j + 1]
        out[:, i] = (part @ size) * (met[:, i] - share[i])
    return out


def contributions(df: DataFrame, model: Model) -> DataFrame:
    """df with `contributions`: exact path-dependent Shapley values, one per feature and the expectation last, for each
    output in turn. Rows that fall into the same bins are worked out once a batch."""
    features, outputs, base = model.features, model.outputs, model.base
    ways = [paths(t) for t in model.trees]
    weights = list(model.weights)
    binned = model.bins.transform(df)
    names = [f"b_{c}" for c in features]

    def shapley(rows: pd.DataFrame) -> pd.Series:
        values, back = np.unique(rows.to_numpy(np.int64), axis=0, return_inverse=True)
        wide = len(features) + 1
        phi = np.zeros((len(values), outputs * wide))
        for c in range(outputs):
            phi[:, c * wide + wide - 1] = base[c]
        for t, (leaves, w) in enumerate(zip(ways, weights)):
            at = t % outputs * wide
            for value, way in leaves:
                if not way:
                    phi[:, at + wide - 1] += w * value
                    continue
                share = np.array([s for _, s, _ in way])
                met = np.ones((len(values), len(way)))
                for j, (f, _, tests) in enumerate(way):
                    b = values[:, f]
                    for n, left in tests:
                        if n.get("cats") is not None:
                            goes = np.isin(b, n["cats"])
                        else:
                            goes = b <= n["bin"]
                            if n["missing_bin"] is not None:
                                goes = np.where(b == n["missing_bin"], bool(n["default_left"]), goes)
                        met[:, j] *= goes == left
                phi[:, at + wide - 1] += w * value * share.prod()
                own = leaf_shares(met, share) * (w * value)
                for j, (f, _, _) in enumerate(way):
                    phi[:, at + f] += own[:, j]
        return pd.Series(list(phi[np.asarray(back).reshape(-1)]))

    return binned.withColumn("contributions", F.pandas_udf(shapley, "array<double>")(F.struct(*names))).drop(*names)
