"""Readers and writers: delimited text, model files and prediction sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.binning import Bins
from ..operators.boost import Model, Params

#: Spellings of a missing value, in any case (fixed values).
MISSING = ("", "?", "na", "n/a", "nan", "null")


def read_table(spark: SparkSession, path: str, columns: list[str], header: bool = False) -> DataFrame:
    """Comma-separated decimals; # starts a comment line, ragged rows and other text raise."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.csv(path, schema=schema, header=header, comment="#", mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    value = lambda c: F.when(~F.lower(F.coalesce(F.col(c), F.lit(""))).isin(*MISSING), F.col(c).cast("double")).alias(c)
    return raw.select(*map(value, columns))


def roles(columns: list[str], label: int = 0, weight: int | None = None) -> tuple[str, str | None, list[str]]:
    """Label, weight and features by position; negative positions count from the end."""

    def at(i: int) -> int:
        if not -len(columns) <= i < len(columns):
            raise ValueError(f"there is no column {i}")
        return i % len(columns)

    y, w = at(label), None if weight is None else at(weight)
    if y == w:
        raise ValueError("label and weight are the same column")
    return columns[y], None if w is None else columns[w], [c for i, c in enumerate(columns) if i not in (y, w)]


def dumps(model: Model) -> str:
    """The whole model as JSON; numbers keep all their bits."""
    p = {k: v for k, v in model.params.__dict__.items()}
    return json.dumps({"version": 1, "features": model.features, "edges": model.bins.edges, "missing": model.bins.missing, "levels": model.bins.levels, "params": p, "base": model.base, "weights": model.weights, "trees": model.trees})


def loads(text: str) -> Model:
    d = json.loads(text)
    if d.get("version") != 1:
        raise ValueError("unknown model version")
    return Model(d["features"], Bins(d["edges"], d["missing"], d.get("levels")), Params(**d["params"]), d["base"], d["trees"], d["weights"])


def save(spark: SparkSession, model: Model, path: str) -> None:
    """Through Spark's writers, so any store will do."""
    spark.createDataFrame([(dumps(model),)], "model string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Model:
    return loads(spark.read.text(path, wholetext=True).first()[0])


def lightgbm_text(model: Model) -> str:
    """The trees in LightGBM's text layout: internal nodes by ordinal, leaves as ~ordinal."""
    objective = {"l2": "regression", "binary": "binary sigmoid:1", "multiclass": f"multiclass num_class:{model.outputs}"}.get(model.params.objective, model.params.objective)
    out = ["tree", "version=v4", f"num_class={model.outputs}", f"num_tree_per_iteration={model.outputs}", "label_index=0", f"max_feature_idx={len(model.features) - 1}", f"objective={objective}", "feature_names=" + " ".join(model.features), ""]
    for i, (t, w) in enumerate(zip(model.trees, model.weights)):
        inner = [n for n in t if n["feature"] is not None]
        leaf = [n for n in t if n["feature"] is None]
        spot = {n["node"]: k for k, n in enumerate(inner)} | {n["node"]: ~k for k, n in enumerate(leaf)}
        first = model.base[i % model.outputs] if i < model.outputs else 0.0
        out += [f"Tree={i}", f"num_leaves={len(leaf)}", "num_cat=0"]
        out += ["split_feature=" + " ".join(str(n["feature"]) for n in inner), "split_gain=" + " ".join(repr(float(n["gain"])) for n in inner), "threshold=" + " ".join(repr(float(n["threshold"])) for n in inner)]
        out += ["decision_type=" + " ".join(str((2 if n["default_left"] else 0) + (8 if n["missing_bin"] is not None else 0)) for n in inner), "left_child=" + " ".join(str(spot[n["left"]]) for n in inner), "right_child=" + " ".join(str(spot[n["right"]]) for n in inner)]
        out += ["leaf_value=" + " ".join(repr(n["value"] * w + first) for n in leaf), "leaf_count=" + " ".join(str(n["count"]) for n in leaf), "shrinkage=1", ""]
    return "\n".join([*out, "end of trees", ""])


def write_predictions(df: DataFrame, path: str, column: str = "prediction") -> None:
    """One prediction per line; doubles in their shortest form that reads back to the same value."""
    value = F.concat_ws(",", F.transform(column, lambda v: v.cast("string"))) if dict(df.dtypes)[column].startswith("array") else F.col(column).cast("string")
    df.select(value.alias("value")).write.text(path)


def from_lightgbm_text(text: str) -> Model:
    """A model from LightGBM's text layout: numeric splits; the thresholds become the bin edges."""
    head, *blocks = text.split("Tree=")
    fields = lambda block: dict(x.split("=", 1) for x in block.splitlines() if "=" in x)
    top = fields(head)
    features = top["feature_names"].split()
    parsed = []
    for block in blocks:
        f = fields(block.split("end of trees")[0])
        if int(f.get("num_cat", 0)):
            raise ValueError("categorical splits are not supported here")
        parsed.append({k: f.get(k, "").split() for k in ("split_feature", "split_gain", "threshold", "decision_type", "left_child", "right_child", "leaf_value", "leaf_count")})
    edges: dict[str, list[float]] = {c: [] for c in features}
    for t in parsed:
        for i, v in zip(t["split_feature"], t["threshold"]):
            edges[features[int(i)]].append(float(v))
    edges = {c: sorted(set(e)) for c, e in edges.items()}
    missing = {c: len(edges[c]) + 1 for c in features}
    trees = []
    for t in parsed:
        inner = len(t["split_feature"])
        nodes: list[dict] = []

        def add(spot: int, depth: int) -> int:
            k = len(nodes)
            nodes.append({})
            if spot < 0 or not inner:
                i = ~spot if inner else 0
                nodes[k] = {"node": k, "feature": None, "depth": depth, "value": float(t["leaf_value"][i]), "count": int((t["leaf_count"] or ["0"] * (inner + 1))[i]), "gain": None}
                return k
            f, v, kind = int(t["split_feature"][spot]), float(t["threshold"][spot]), int(t["decision_type"][spot])
            gone = kind >> 2 & 3  # how missing values are told: not at all (they count as 0), as zeros, as NaN
            if gone == 1:
                raise ValueError("zeros as missing values are not supported here")
            left, right = add(int(t["left_child"][spot]), depth + 1), add(int(t["right_child"][spot]), depth + 1)
            nodes[k] = {"node": k, "feature": f, "bin": edges[features[f]].index(v), "threshold": v, "default_left": bool(kind & 2), "missing_bin": missing[features[f]] if gone == 2 else None, "left": left, "right": right, "gain": float((t["split_gain"] or ["0"] * inner)[spot]), "value": 0.0, "count": nodes[left]["count"] + nodes[right]["count"], "depth": depth}
            return k

        add(0 if inner else -1, 0)
        trees.append(nodes)
    k = int(top.get("num_tree_per_iteration", 1))
    kind = top.get("objective", "regression").split()[0]
    return Model(features, Bins(edges, missing), Params(objective={"regression": "l2"}.get(kind, kind), num_class=k), [0.0] * k, trees, [1.0] * len(trees))
