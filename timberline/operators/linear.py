"""Linear leaves: a ridge model per leaf over the numeric features of its branch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boost import Node, route


def branch_features(tree: list[Node]) -> dict[int, list[int]]:
    """The features on the way to every leaf."""
    out: dict[int, list[int]] = {}

    def walk(i: int, used: list[int]) -> None:
        n = tree[i]
        if n["feature"] is None:
            out[i] = sorted(set(used))
        else:
            walk(n["left"], [*used, n["feature"]])
            walk(n["right"], [*used, n["feature"]])

    walk(0, [])
    return out


def fit(df: DataFrame, tree: list[Node], features: list[str], ridge: float = 0.0, grad: str = "g", hess: str = "h") -> dict[int, tuple[float, dict[str, float]]]:
    """{leaf: (constant, {feature: coefficient})}: the Newton step of an affine leaf from sums of products per leaf.

    Rows with a missing branch feature, leaves with fewer rows than coefficients and singular systems fall back to
    the leaf's constant.
    """
    leaf = route(tree, lambda n: F.lit(n["node"]), features)
    x = [F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]]
    used = branch_features(tree)
    need = {(min(a, b), max(a, b)) for fs in used.values() for a in (0, *[f + 1 for f in fs]) for b in (0, *[f + 1 for f in fs])}  # only what some branch has
    sums = [F.sum(F.col(hess) * x[i] * x[j]).alias(f"m{i}_{j}") for i, j in sorted(need)]
    sums += [F.sum(F.col(grad) * x[i]).alias(f"v{i}") for i in sorted({i for i, _ in need})]
    whole = ~F.greatest(*[F.col(c).isNull() for c in features]) if len(features) > 1 else F.col(features[0]).isNotNull()
    rows = df.filter(whole).withColumn("__leaf", leaf).groupBy("__leaf").agg(F.count(F.lit(1)).alias("n"), *sums).collect()  # a row per leaf
    out = {k: (tree[k]["value"], {}) for k in used}
    for r in rows:
        pick = [0, *[f + 1 for f in used[r["__leaf"]]]]
        if r["n"] <= len(pick):
            continue
        m = np.array([[r[f"m{min(a, b)}_{max(a, b)}"] for b in pick] for a in pick]) + ridge * np.diag([0.0, *[1.0] * (len(pick) - 1)])
        try:
            w = -np.linalg.solve(m, np.array([r[f"v{a}"] for a in pick]))
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(w).all():
            out[r["__leaf"]] = (float(w[0]), {features[f - 1]: float(c) for f, c in zip(pick[1:], w[1:])})
    return out


def predict(tree: list[Node], leaves: dict[int, tuple[float, dict[str, float]]], features: list[str]) -> Column:
    """The affine value at a row's leaf; where a needed feature is missing, the leaf's constant of the tree."""

    def value(n: Node) -> Column:
        constant, weights = leaves[n["node"]]
        total = F.lit(constant)
        for c, w in weights.items():
            total = total + F.col(c).cast("double") * w
        return F.coalesce(total, F.lit(n["value"]))

    return route(tree, value, features)
