"""Tree growth and boosting.

The new leaves of a level are searched in one query, for all trees of a round together. Only the smaller child of a split
is scanned; its sibling's histogram is the parent's minus its own. Leaf-wise trees are grown ahead of need: every leaf
that the best-first order would split by what is known so far is split at once, and the order is replayed at the end, so
that a tree takes about as many queries as it has levels. The driver holds only the node tables.
"""

from __future__ import annotations

import heapq
import math
import random
from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.objectives import aft, multi_rmse_derivatives, multiclass_derivatives, objective, softmax
from ..functions.random import uniform
from ..plans.storage import cut, drop
from . import ranking
from .binning import Bins
from .ranges import percentile
from .sampling import langevin
from .split import SplitParams, best, best_categorical, oblivious


@dataclass
class Params:
    """Parameters with the reference defaults of this family of boosters; `of` takes any known alias."""

    objective: str = "l2"
    num_iterations: int = 100
    learning_rate: float = 0.1
    num_leaves: int = 31
    max_depth: int = -1
    max_bin: int = 255
    min_data_in_bin: int = 3
    min_data_in_leaf: int = 20
    min_child_hess: float = 1e-3
    lambda_l1: float = 0.0
    lambda_l2: float = 1.0
    min_gain_to_split: float = 0.0
    max_delta_step: float = 0.0
    path_smooth: float = 0.0
    grow_policy: str = "leafwise"  # depthwise, oblivious
    boosting: str = "gbdt"  # dart, rf, goss
    bagging_fraction: float = 1.0
    bagging_freq: int = 0
    feature_fraction: float = 1.0
    top_rate: float = 0.2
    other_rate: float = 0.1
    drop_rate: float = 0.1
    skip_drop: float = 0.5
    num_class: int = 1
    use_missing: bool = True
    early_stopping_round: int = 0
    min_delta: float = 0.0
    seed: int = 0
    #: by feature name: -1, 0 or 1; and lists of feature names that may share a branch
    monotone: dict = field(default_factory=dict)
    interaction: list = field(default_factory=list)
    #: features whose values are categories
    categorical: list = field(default_factory=list)
    max_cat_to_onehot: int = 4
    max_cat_threshold: int = 32
    cat_smooth: float = 10.0
    cat_l2: float = 10.0
    feature_contri: dict = field(default_factory=dict)
    extra_trees: bool = False
    random_strength: float = 0.0
    cegb_tradeoff: float = 1.0
    cegb_penalty_split: float = 0.0
    #: by feature name: the price of the first split on it
    cegb_penalty_feature: dict = field(default_factory=dict)
    #: {"feature", "threshold", "left", "right"}: splits that the top of every tree has
    forced: dict = field(default_factory=dict)
    #: temperature of the noise on derivatives (0: none), Newton steps of leaves
    langevin_temperature: float = 0.0
    leaf_estimation_iterations: int = 1
    args: dict = field(default_factory=dict)

    ALIASES = {"eta": "learning_rate", "shrinkage_rate": "learning_rate", "n_estimators": "num_iterations", "num_round": "num_iterations", "num_boost_round": "num_iterations", "num_trees": "num_iterations", "max_leaves": "num_leaves", "min_child_samples": "min_data_in_leaf", "min_sum_hessian_in_leaf": "min_child_hess", "min_child_weight": "min_child_hess", "reg_alpha": "lambda_l1", "reg_lambda": "lambda_l2", "l2_leaf_reg": "lambda_l2", "subsample": "bagging_fraction", "subsample_freq": "bagging_freq", "colsample_bytree": "feature_fraction", "min_split_gain": "min_gain_to_split", "gamma": "min_gain_to_split", "boosting_type": "boosting", "num_classes": "num_class", "random_state": "seed", "application": "objective", "loss_function": "objective", "depth": "max_depth", "categorical_feature": "categorical", "cat_feature": "categorical"}

    #: What objectives and rankers take besides; any other name is refused.
    ARGS = ("alpha", "fair_c", "tweedie_variance_power", "sigma", "truncation", "norm", "group", "upper", "event", "scale", "noise", "permutations", "decay")

    @classmethod
    def of(cls, **given) -> "Params":
        known, out, extra = cls.__dataclass_fields__, {}, {}
        for k, v in given.items():
            name = cls.ALIASES.get(k, k)
            if name not in known and name not in cls.ARGS:
                raise ValueError(f"unknown parameter {k!r}")
            if name in out and out[name] != v:
                raise ValueError(f"{name} is given twice, with different values")
            (out if name in known else extra)[name] = v
        out["args"] = {**out.get("args", {}), **extra}
        p = cls(**out)
        p.check()
        return p

    @classmethod
    def parse(cls, text: str) -> "Params":
        """From "k=v k=v"."""
        out = {}
        for part in text.split():
            k, _, v = part.partition("=")
            try:
                out[k] = int(v)
            except ValueError:
                try:
                    out[k] = float(v)
                except ValueError:
                    out[k] = v
        return cls.of(**out)

    def check(self) -> None:
        rules = {"learning_rate": self.learning_rate > 0, "num_iterations": self.num_iterations >= 0, "num_leaves": self.num_leaves >= 2, "max_bin": 2 <= self.max_bin <= 65535, "min_data_in_leaf": self.min_data_in_leaf >= 0, "lambda_l1": self.lambda_l1 >= 0, "lambda_l2": self.lambda_l2 >= 0, "bagging_fraction": 0 < self.bagging_fraction <= 1, "feature_fraction": 0 < self.feature_fraction <= 1, "grow_policy": self.grow_policy in ("leafwise", "depthwise", "oblivious"), "boosting": self.boosting in ("gbdt", "dart", "rf", "goss")}
        for k, ok in rules.items():
            if not ok:
                raise ValueError(f"{k}={getattr(self, k)!r} is out of range")
        if self.boosting == "rf" and not (self.bagging_fraction < 1 and self.bagging_freq > 0):
            raise ValueError("a random forest needs bagging_fraction below 1 and bagging_freq above 0")

    def split(self) -> SplitParams:
        return SplitParams(self.lambda_l1, self.lambda_l2, self.min_data_in_leaf, self.min_child_hess, self.min_gain_to_split, self.max_delta_step, self.path_smooth, extra_trees=self.extra_trees, random_strength=self.random_strength, seed=self.seed, cegb_tradeoff=self.cegb_tradeoff, cegb_penalty_split=self.cegb_penalty_split)

    def allowed(self, used: set[str], features: list[str]) -> list[int]:
        """The features a branch may split on after it has used some: those of the constraint sets that hold all of them."""
        if not self.interaction:
            return list(range(len(features)))
        free = set().union(*[set(s) for s in self.interaction if used <= set(s)]) | used
        return [i for i, f in enumerate(features) if f in free]


#: One node: node, feature (None for a leaf), bin, threshold, default_left, missing_bin, left, right, value, gain, count,
#: depth; splits on categories have `cats`, the bins that go left, in place of bin and threshold.
Node = dict


def goes_left(n: Node, features: list[str], prefix: str = "b_") -> Column:
    c = F.col(f"{prefix}{features[n['feature']]}")
    if n.get("cats") is not None:
        return c.isin(*n["cats"])
    if n["missing_bin"] is not None:
        return F.when(c == n["missing_bin"], F.lit(bool(n["default_left"]))).otherwise(c <= n["bin"])
    return c <= n["bin"]


def raw_goes_left(n: Node, features: list[str], bins: Bins) -> Column:
    """The same test on the value itself: a bin is at most b where the value is at most edge b."""
    name = features[n["feature"]]
    if n.get("cats") is not None:
        return F.coalesce(F.col(name).isin(*[bins.levels[name][c] for c in n["cats"]]), F.lit(False))
    v = F.col(name).cast("double")
    gone = bool(n["default_left"]) if n["missing_bin"] is not None else n["threshold"] >= 0.0
    return F.when(v.isNull() | F.isnan(v), F.lit(gone)).otherwise(v <= float(n["threshold"]))


def route(nodes: list[Node], leaf: "callable", features: list[str], prefix: str = "b_", only: set[int] | None = None, bins: Bins | None = None) -> Column:
    """A CASE expression that sends a row to its leaf and yields leaf(node) there; with `only`, null outside of these. With
    `bins`, over the features' own values instead of their bins."""
    by = {n["node"]: n for n in nodes}

    def at(i: int) -> Column | None:
        n = by[i]
        if n["feature"] is None:
            return leaf(n) if only is None or i in only else None
        left, right = at(n["left"]), at(n["right"])
        if left is None and right is None:
            return None
        test = goes_left(n, features, prefix) if bins is None else raw_goes_left(n, features, bins)
        if left is None:
            return F.when(~test, right)
        return F.when(test, left) if right is None else F.when(test, left).otherwise(right)

    found = at(0)
    return F.lit(None).cast("int") if found is None else found


#: Room for the nodes of one tree in the numbers that tell apart the nodes of all trees of a round.
TREE = 1 << 20


class Sprout:
    """One tree as it grows: its nodes, ahead of need, and the best split that is known of each leaf."""

    def __init__(self, number: int, p: Params):
        self.number, self.p = number, p
        self.nodes: list[Node] = [{"node": 0, "feature": None, "depth": 0, "used": set(), "low": -math.inf, "high": math.inf, "gain": None, "missing_bin": None}]
        self.known: dict[int, dict | None] = {}
        self.forced: dict[int, dict] = {0: p.forced} if p.forced else {}
        self.fresh = [0]

    def deepest(self) -> int:
        return self.p.max_depth if self.p.max_depth > 0 else 62

    def found(self, i: int, s: dict | None) -> None:
        self.known[i] = s

    def expand(self, i: int, features: list[str], bins: Bins, missing: dict, sp: SplitParams) -> None:
        """Split a leaf as its best split says."""
        p, n, s = self.p, self.nodes[i], self.known[i]
        f = s["feature"]
        name = features[f]
        a, b = len(self.nodes), len(self.nodes) + 1
        n |= {"feature": f, "left": a, "right": b, "gain": s["gain"], "missing_bin": missing.get(f), "default_left": bool(s["default_left"]), "bin": s["bin"]}
        if s.get("cats") is not None:
            n |= {"cats": sorted(s["cats"]), "bin": None, "threshold": None, "missing_bin": None, "default_left": False}
        else:
            edges = bins.edges[name]
            n["threshold"] = edges[s["bin"]] if s["bin"] < len(edges) else math.inf
        low, high, sign = n["low"], n["high"], sp.monotone.get(f, 0)
        extra = p.cat_l2 if s.get("cats") is not None and not s["onehot"] else 0.0
        value = {side: max(low, min(high, leaf_value(s[f"{side}_g"], s[f"{side}_h"], p, s[f"{side}_n"], n["value"], extra))) for side in ("left", "right")}
        middle = (value["left"] + value["right"]) / 2
        for k, side in ((a, "left"), (b, "right")):
            up = sign > 0 if side == "right" else sign < 0  # whether this child lies above the middle
            bounds = {"low": max(low, middle) if sign and up else low, "high": min(high, middle) if sign and not up else high}
            self.nodes.append({"node": k, "feature": None, "depth": n["depth"] + 1, "value": value[side], "count": s[f"{side}_n"], "gain": None, "missing_bin": None, "parent": i, "used": n["used"] | {name}, **bounds})
            if self.forced.get(i, {}).get(side):
                self.forced[k] = self.forced[i][side]
        self.fresh += [a, b]

    def first(self, i: int) -> tuple:
        """Where a leaf stands in the order of splits: forced ones, then the largest gain."""
        return i not in self.forced, -self.known[i]["gain"], i

    def best_first(self) -> tuple[list[int], list[int]]:
        """The nodes that the best-first order splits, by what is known, and those of them that are not split yet."""
        order, open_, leaves = [], [], 1
        heap = [self.first(0)] if self.known.get(0) else []
        while heap and leaves < self.p.num_leaves:
            *_, i = heapq.heappop(heap)
            leaves += 1
            n = self.nodes[i]
            if n["feature"] is None:
                open_.append(i)
                continue
            order.append(i)
            for c in (n["left"], n["right"]):
                if self.known.get(c):
                    heapq.heappush(heap, self.first(c))
        return order, open_

    def choose(self) -> list[int]:
        """The leaves to split next."""
        p = self.p
        if p.grow_policy == "leafwise":
            return self.best_first()[1]
        leaves = sum(n["feature"] is None for n in self.nodes)
        frontier = sorted((i for i, s in self.known.items() if s and self.nodes[i]["feature"] is None), key=self.first)
        if p.grow_policy == "oblivious":
            return sorted(frontier) if leaves + len(frontier) <= p.num_leaves else []
        return sorted(frontier[: p.num_leaves - leaves])

    def tree(self) -> list[Node]:
        """The nodes that stay, numbered in the order in which they were split."""
        split = self.best_first()[0] if self.p.grow_policy == "leafwise" else [n["node"] for n in self.nodes if n["feature"] is not None]
        number, out = {0: 0}, []
        for i in split:
            for side in ("left", "right"):
                number[self.nodes[i][side]] = len(number)
        for i in sorted(number, key=number.get):
            n = {k: v for k, v in self.nodes[i].items() if k not in ("used", "parent", "low", "high")}
            if i in split:
                n |= {"left": number[n["left"]], "right": number[n["right"]]}
            else:
                n = {k: v for k, v in n.items() if k in ("depth", "value", "count")} | {"feature": None, "gain": None, "low": self.nodes[i]["low"], "high": self.nodes[i]["high"]}
            out.append(n | {"node": number[i], "parent": number.get(self.nodes[i].get("parent"))})
        return out


def histograms(df: DataFrame, sprouts: list[Sprout], features: list[str], pick: dict[int, set[int]], allowed: list[int] | None) -> DataFrame:
    """(node, feature, bin, g, h, n) of the picked leaves of every tree, in one scan."""
    cells = [i for i in range(len(features)) if allowed is None or i in allowed]
    trees = []
    for t in sprouts:
        if pick.get(t.number):
            tag = route(t.nodes, lambda n, t=t: F.lit(t.number * TREE + n["node"]), features, only=pick[t.number])
            trees.append(F.struct(tag.alias("node"), F.col(f"g{t.number}").alias("g"), F.col(f"h{t.number}").alias("h")))
    bins = [F.col(f"b_{features[i]}").alias(f"b{i}") for i in cells]
    if len(trees) == 1:
        rows = df.select(*bins, trees[0].alias("t")).select(*[f"b{i}" for i in cells], "t.*").filter(F.col("node").isNotNull())
    else:
        rows = df.select(*bins, F.explode(F.filter(F.array(*trees), lambda t: t["node"].isNotNull())).alias("t")).select(*[f"b{i}" for i in cells], "t.*")
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"b{i}").alias("bin")) for i in cells]))
    rows = rows.select("node", "g", "h", cell.alias("c"))
    return rows.groupBy("node", F.col("c.feature").alias("feature"), F.col("c.bin").alias("bin")).agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))


#: Cells of a histogram table that are searched in one task.
ONE_TASK = 200_000


def with_siblings(small: DataFrame, before: DataFrame, family: dict[int, tuple[int, int]], few: bool = False) -> DataFrame:
    """The histograms of scanned children and, by subtraction from their parents', of their siblings.

    `family` maps a child to its parent and its sibling; both tables are aggregated together, in one shuffle.
    """
    pair = F.create_map(*[F.lit(x) for c, (up, _) in family.items() for x in (up, c)])
    other = F.create_map(*[F.lit(x) for c, (_, s) in family.items() for x in (c, s)])
    zero = [F.lit(0).alias(c) for c in "ghn"]
    own = small.select("node", "feature", "bin", "g", "h", "n", *[F.lit(0).alias(f"p{c}") for c in "ghn"])
    up = before.filter(F.col("node").isin([u for u, _ in family.values()])).select(F.element_at(pair, F.col("node")).alias("node"), "feature", "bin", *zero, *[F.col(c).alias(f"p{c}") for c in "ghn"])
    both = own.unionByName(up)
    both = (both.coalesce(1) if few else both).groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n", "pg", "ph", "pn")])
    child = F.struct("node", "g", "h", "n")
    sibling = F.struct(F.element_at(other, F.col("node")).alias("node"), *[(F.col(f"p{c}") - F.col(c)).alias(c) for c in "ghn"])
    return both.select("feature", "bin", F.explode(F.array(child, sibling)).alias("e")).select("e.node", "feature", "bin", "e.g", "e.h", "e.n").filter("n > 0")


def forced_splits(hist: DataFrame, asked: dict[int, dict], features: list[str], bins: Bins, sp: SplitParams) -> dict[int, dict]:
    """The splits that are asked for at these nodes, with their sums and gains; those that leave a side empty are not made.
    Missing values go left."""
    place = {k: (features.index(s["feature"]), bisect_left(bins.edges[s["feature"]], float(s["threshold"]))) for k, s in asked.items()}
    here, left = F.lit(False), F.lit(False)
    for k, (f, b) in place.items():
        own = (F.col("node") == k) & (F.col("feature") == f)
        gone = bins.missing.get(features[f])
        here, left = here | own, left | own & ((F.col("bin") <= b) | (F.col("bin") == F.lit(-1 if gone is None else gone)))
    sums = hist.filter(here).groupBy("node").agg(*[F.sum(F.when(left, F.col(c)).otherwise(0)).alias(f"left_{c}") for c in "ghn"], *[F.sum(F.when(~left, F.col(c)).otherwise(0)).alias(f"right_{c}") for c in "ghn"])
    out = {}
    for r in sums.collect():  # a row per forced node
        if r["left_n"] and r["right_n"]:
            f, b = place[r["node"]]
            own = lambda g, h: max(abs(g) - sp.lambda_l1, 0.0) ** 2 / (h + sp.lambda_l2)
            gain = own(r["left_g"], r["left_h"]) + own(r["right_g"], r["right_h"]) - own(r["left_g"] + r["right_g"], r["left_h"] + r["right_h"])
            out[r["node"]] = {**r.asDict(), "feature": f, "bin": b, "default_left": True, "gain": gain, "cats": None, "onehot": False}
    return out


def grow_all(df: DataFrame, features: list[str], bins: Bins, p: Params, count: int = 1, allowed: list[int] | None = None, used: frozenset[int] = frozenset(), turn: int = 0) -> list[list[Node]]:
    """Trees from columns b_*, and g0, h0, g1, h1, ... for each. Rows are only read: a node's rows are those its path leads to."""
    sp = p.split()
    sp.seed = p.seed * 1_000_003 + turn
    sp.cegb_penalty_feature = {features.index(k): v for k, v in p.cegb_penalty_feature.items() if features.index(k) not in used}
    sp.monotone = {features.index(k): v for k, v in p.monotone.items() if v}
    sp.contri = {features.index(k): float(v) for k, v in p.feature_contri.items()}
    missing = {i: bins.missing[c] for i, c in enumerate(features) if bins.missing.get(c) is not None}
    cats = [i for i, c in enumerate(features) if c in bins.levels]
    sprouts = [Sprout(k, p) for k in range(count)]
    held: DataFrame | None = None
    kept: list[DataFrame] = []

    def search(fresh: dict[int, list[int]]) -> None:
        """Histograms and best splits of new leaves of several trees in one query."""
        nonlocal held
        family: dict[int, tuple[int, int]] = {}
        pick: dict[int, set[int]] = {}
        for t in sprouts:
            own = set(fresh.get(t.number, ()))
            for i in sorted(own):
                up = t.nodes[i].get("parent")
                if up is None:
                    pick.setdefault(t.number, set()).add(i)
                    continue
                sibling = t.nodes[up]["right"] if t.nodes[up]["left"] == i else t.nodes[up]["left"]
                if t.nodes[i]["count"] < t.nodes[sibling]["count"] or t.nodes[i]["count"] == t.nodes[sibling]["count"] and i < sibling:
                    pick.setdefault(t.number, set()).add(i)
                    family[t.number * TREE + i] = (t.number * TREE + up, t.number * TREE + sibling)
        hist = histograms(df, sprouts, features, pick, allowed)
        # the tables' size is known: nodes x bins; small ones go on in one task, without further shuffles
        few = (len(family) * 2 or len(sprouts)) * bins.size() <= ONE_TASK
        if few:
            hist = hist.repartition(1)  # not coalesce: one task would hold an aggregation for every shuffle partition
        if family and held is not None:
            hist = with_siblings(hist, held, family, few)
        hist = hist.persist()  # nodes x features x bins rows
        kept.append(hist)
        held = hist if held is None or p.grow_policy != "leafwise" else held.unionByName(hist)
        wide = hist
        if p.interaction:
            ok = F.lit(False)
            for t in sprouts:
                for i in fresh.get(t.number, ()):
                    ok = ok | ((F.col("node") == t.number * TREE + i) & F.col("feature").isin(p.allowed(t.nodes[i]["used"], features)))
            wide = wide.filter(ok)
        if p.path_smooth:
            sp.parents = {t.number * TREE + i: t.nodes[i].get("value", 0.0) for t in sprouts for i in fresh.get(t.number, ())}
        found: dict[int, dict] = {}
        if p.grow_policy == "oblivious":
            for t in sprouts:
                mine = wide.filter(F.floor(F.col("node") / TREE) == t.number) if count > 1 else wide
                shared = oblivious(mine, sp).collect()
                if shared:
                    full = hist.filter((F.col("feature") == shared[0]["feature"]) & (F.floor(F.col("node") / TREE) == t.number))
                    left = F.col("bin") <= shared[0]["bin"]
                    for r in full.groupBy("node").agg(*[F.sum(F.when(left, F.col(c)).otherwise(0)).alias(f"left_{c}") for c in "ghn"], *[F.sum(c).alias(f"all_{c}") for c in "ghn"]).collect():
                        found[r["node"]] = {**r.asDict(), "feature": shared[0]["feature"], "bin": shared[0]["bin"], "default_left": True, "gain": shared[0]["gain"], **{f"right_{c}": r[f"all_{c}"] - r[f"left_{c}"] for c in "ghn"}}
        else:
            sides = [f"{side}_{c}" for side in ("left", "right") for c in "ghn"]
            numeric = best(wide.filter(~F.col("feature").isin(cats)) if cats else wide, sp, missing)
            splits = numeric.select("node", "feature", "bin", F.col("default_left"), "gain", *sides, F.lit(None).cast("array<int>").alias("cats"), F.lit(False).alias("onehot"))
            if cats:
                by = best_categorical(wide.filter(F.col("feature").isin(cats) & (F.col("bin") >= 0)), sp, p.max_cat_to_onehot, p.cat_smooth, p.cat_l2, p.max_cat_threshold)
                gone = wide.filter(F.col("feature").isin(cats)).groupBy("node", "feature").agg(*[F.sum(c).alias(f"w{c}") for c in "ghn"])
                by = by.join(gone, ["node", "feature"])  # what is missing or unseen goes right
                by = by.select("node", "feature", F.lit(None).cast("int").alias("bin"), F.lit(False).alias("default_left"), "gain", *[F.col(f"l{c}").alias(f"left_{c}") for c in "ghn"], *[(F.col(f"w{c}") - F.col(f"l{c}")).alias(f"right_{c}") for c in "ghn"], F.col("left").cast("array<int>").alias("cats"), (F.col("onehot") == 1).alias("onehot"))
                splits = splits.unionByName(by).groupBy("node").agg(F.max_by(F.struct(*[c for c in splits.columns if c != "node"]), F.struct("gain", -F.col("feature"))).alias("s")).select("node", "s.*")
            found = {r["node"]: r.asDict() for r in splits.collect()}
        asked = {t.number * TREE + i: t.forced[i] for t in sprouts for i in fresh.get(t.number, ()) if i in t.forced}
        if asked:
            found |= forced_splits(hist, asked, features, bins, sp)
        for t in sprouts:
            for i in fresh.get(t.number, ()):
                t.found(i, found.get(t.number * TREE + i))

    # the roots' sums come from their histograms
    search({t.number: [0] for t in sprouts})
    sums = {t.number * TREE: {c: t.known[0][f"left_{c}"] + t.known[0][f"right_{c}"] for c in "ghn"} for t in sprouts if t.known.get(0)}
    if len(sums) < count:  # a root without a split
        first = [i for i in range(len(features)) if allowed is None or i in allowed][0]
        sums |= {r["node"]: r for r in held.filter(F.col("feature") == first).groupBy("node").agg(*[F.sum(c).alias(c) for c in "ghn"]).collect()}
    for t in sprouts:
        r = sums.get(t.number * TREE)
        g, h, n = (r["g"], r["h"], r["n"]) if r else (0.0, 0.0, 0)
        t.nodes[0] |= {"value": leaf_value(g or 0.0, h or 0.0, p), "count": n}
        t.fresh = []
    while True:
        fresh = {}
        for t in sprouts:
            t.fresh = []
            for i in t.choose():
                t.expand(i, features, bins, missing, sp)
            live = [i for i in t.fresh if t.nodes[i]["depth"] < t.deepest()]
            for i in set(t.fresh) - set(live):
                t.found(i, None)
            if p.grow_policy != "leafwise" and sum(n["feature"] is None for n in t.nodes) >= p.num_leaves:
                live = []
            if live:
                fresh[t.number] = live
        if not fresh:
            break
        search(fresh)
    for h in kept:
        h.unpersist()
    return [t.tree() for t in sprouts]


def grow(df: DataFrame, features: list[str], bins: Bins, p: Params, allowed: list[int] | None = None, used: frozenset[int] = frozenset(), turn: int = 0) -> list[Node]:
    """One tree from columns b_*, g and h."""
    return grow_all(df.withColumn("g0", F.col("g")).withColumn("h0", F.col("h")), features, bins, p, 1, allowed, used, turn)[0]


def leaf_value(g: float, h: float, p: Params, n: int = 0, parent: float | None = None, more_l2: float = 0.0) -> float:
    """The Newton step of a leaf, capped, and smoothed towards its parent's output."""
    l2 = p.lambda_l2 + more_l2
    t = math.copysign(max(abs(g) - p.lambda_l1, 0.0), g)
    return settled(-t / (h + l2) if h + l2 > 0 else 0.0, p, n, parent)


def settled(out: float, p: Params, n: int = 0, parent: float | None = None) -> float:
    if p.max_delta_step:
        out = max(-p.max_delta_step, min(p.max_delta_step, out))
    if p.path_smooth and parent is not None:
        share = n / p.path_smooth
        out = (out * share + parent) / (share + 1)
    return out


@dataclass
class Model:
    """Trees (round-major, one per class and round), their weights, base scores and bins."""

    features: list[str]
    bins: Bins
    params: Params
    base: list[float]
    trees: list[list[Node]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)
    best_iteration: int | None = None

    @property
    def outputs(self) -> int:
        return len(self.base)

    def raw(self, start: int = 0, rounds: int | None = None, prefix: str = "b_", values: bool = False) -> list[Column]:
        """Raw score per output over binned columns, or over the features' values; the base score belongs to iteration 0."""
        k, out = self.outputs, []
        stop = None if rounds is None else (start + rounds) * k
        for c in range(k):
            score = F.lit(self.base[c] if start == 0 else 0.0)
            for i in range(start * k, len(self.trees) if stop is None else min(stop, len(self.trees))):
                if i % k == c:
                    w = self.weights[i]
                    score = score + route(self.trees[i], lambda n: F.lit(float(n["value"] * w)), self.features, prefix, bins=self.bins if values else None)
            out.append(score)
        return out

    def predict(self, df: DataFrame, kind: str = "response", start: int = 0, rounds: int | None = None) -> DataFrame:
        """df with prediction (raw, response), probabilities (multiclass) or leaf (array of leaf ordinals)."""
        if kind == "leaf":
            each = [route(t, lambda n: F.lit(ordinals(t)[n["node"]]), self.features, bins=self.bins) for t in self.trees]
            return df.withColumn("leaf", F.array(*each))
        raws, special = self.raw(start, rounds, values=True), self.params.objective in (*RANKERS, "cox")
        if self.params.objective == "multi_rmse":
            return df.withColumn("prediction", F.array(*raws))
        if self.outputs > 1:
            scored = df.withColumns({f"__raw{c}": r for c, r in enumerate(raws)})  # so that each is worked out once
            raws = [F.col(f"__raw{c}") for c in range(self.outputs)]
            out = scored.withColumn("probabilities", F.array(*(softmax(raws) if kind == "response" else raws)))
            return out.withColumn("prediction", F.expr("array_position(probabilities, array_max(probabilities)) - 1")).drop(*[f"__raw{c}" for c in range(self.outputs)])
        plain = kind != "response" or special
        link = (lambda r: r) if plain else F.exp if self.params.objective == "aft" else objective(self.params.objective).response
        return df.withColumn("prediction", link(raws[0]))

    def staged(self, df: DataFrame, every: int = 1) -> DataFrame:
        """df with `staged`: the raw score (of the first output) after every `every` rounds."""
        k, score, out = self.outputs, F.lit(self.base[0]), []
        for i in range(0, len(self.trees), k):
            w = self.weights[i]
            score = score + route(self.trees[i], lambda n: F.lit(float(n["value"] * w)), self.features, bins=self.bins)
            if (i // k + 1) % every == 0:
                out.append(score)
        return df.withColumn("staged", F.array(*out))


def ordinals(tree: list[Node]) -> dict[int, int]:
    """Leaf ordinals in order of node id."""
    return {n["node"]: i for i, n in enumerate(x for x in tree if x["feature"] is None)}


RANKERS = ("lambdarank", "query_rmse", "pair_logit", "yetirank")


def derive(state: DataFrame, label: str | list[str], raws: list[Column], w: Column, p: Params, key: str | None, custom=None) -> tuple[DataFrame, bool]:
    """The rows with g0, h0, g1, h1, ..., and whether they were written. Losses of whole queries or risk sets are joined
    back to their rows by the key."""
    y = None if isinstance(label, list) else F.col(label).cast("double")
    if p.objective in RANKERS or p.objective == "cox":
        if key is None:
            raise ValueError(f"{p.objective} needs a row key")
        rows = state.withColumn("__raw", raws[0])
        a = p.args
        if p.objective == "lambdarank":
            gh = ranking.lambdarank(rows, a["group"], label, "__raw", key, int(a.get("truncation", 30)), bool(a.get("norm", True)), float(a.get("sigma", 1.0)))
        elif p.objective == "yetirank":
            gh = ranking.yetirank(rows, a["group"], label, "__raw", key, int(a.get("permutations", 10)), float(a.get("decay", 0.99)), p.seed)
        elif p.objective == "pair_logit":
            gh = ranking.pair_logit(rows, a["group"], label, "__raw", key)
        elif p.objective == "query_rmse":
            gh = ranking.query_rmse(rows, a["group"], label, "__raw").select(key, "grad", "hess")
        else:
            gh = ranking.cox(rows, label, a["event"], "__raw", key)
        out = state.join(gh.select(F.col(key).alias("__k"), "grad", "hess"), F.col(key) == F.col("__k"))
        return cut(out.drop("__k").withColumn("g0", F.col("grad") * w).withColumn("h0", F.col("hess") * w).drop("grad", "hess")), True
    if p.objective == "aft":
        out = aft(state.withColumn("__raw", raws[0]), label, p.args["upper"], "__raw", float(p.args.get("scale", 1.0)), p.args.get("noise", "normal"))
        return out.withColumns({"g0": F.col("grad") * w, "h0": F.col("hess") * w}).drop("__raw", "grad", "hess"), False
    if custom is not None:
        pairs = [custom(y, raws[0])]
    elif p.objective == "multiclass":
        pairs = multiclass_derivatives(y, raws)
    elif p.objective == "multi_rmse":
        pairs = multi_rmse_derivatives([F.col(c).cast("double") for c in label], raws)
    else:
        pairs = [objective(p.objective).derivatives(y, raws[0], p.args)]
    return state.withColumns({f"{n}{c}": v * w for c, pair in enumerate(pairs) for n, v in zip("gh", pair)}), False


def starts(df: DataFrame, label: str | list[str], weight: str | None, p: Params, custom=None) -> list[float]:
    """The raw score of every output before the first tree."""
    w = F.col(weight) if weight else F.lit(1.0)
    if custom is not None or p.objective in (*RANKERS, "cox", "aft"):
        return [0.0]
    if p.objective == "multi_rmse":
        mean = [(F.sum(F.col(c) * w) / F.sum(F.when(F.col(c).isNotNull(), w))).alias(f"m{i}") for i, c in enumerate(label)]
        return [float(v or 0.0) for v in df.agg(*mean).first()]
    if p.objective == "multiclass":
        share = {r[0]: r[1] for r in df.groupBy(F.col(label).cast("int")).agg(F.sum(w)).collect()}
        total = sum(share.values()) or 1
        return [math.log(max(1e-15, share.get(c, 0) / total)) for c in range(max(1, p.num_class))]
    return [objective(p.objective).base_score(df, label, weight, p.args)]


def renew(rows: DataFrame, trees: list[list[Node]], label: str, raws: list[Column], weight: str | None, p: Params, features: list[str]) -> None:
    """Leaves take the percentile of what is left of their rows' labels, where the objective says so."""
    obj = objective(p.objective)
    y = F.col(label).cast("double")
    w = obj.renewal_weight(y, F.col(weight).cast("double") if weight else None)
    for t, raw in zip(trees, raws):
        if len(t) > 1:
            left = rows.select(route(t, lambda n: F.lit(n["node"]), features).alias("leaf"), (y - raw).alias("r"), *([] if w is None else [w.alias("w")]))
            for r in percentile(left, F.col("r"), obj.alpha(p.args), None if w is None else F.col("w"), ["leaf"]).collect():  # a row per leaf
                n = t[r["leaf"]]
                n["value"] = max(n["low"], min(n["high"], settled(r["value"], p, n["count"], t[n["parent"]]["value"])))


def restep(rows: DataFrame, trees: list[list[Node]], label: str | list[str], raws: list[Column], w: Column, p: Params, key: str | None, custom, features: list[str]) -> None:
    """One more Newton step of every leaf, at the scores with the tree added."""
    names = [f"__s{c}" for c in range(len(trees))]
    moved = rows.withColumns({n: raw + route(t, lambda x: F.lit(float(x["value"])), features) for n, t, raw in zip(names, trees, raws)})
    given, temporary = derive(moved, label, [F.col(n) for n in names], w, p, key, custom)
    cells = [F.struct(F.lit(c).alias("tree"), route(t, lambda x: F.lit(x["node"]), features).alias("leaf"), F.col(f"g{c}").alias("g"), F.col(f"h{c}").alias("h")) for c, t in enumerate(trees)]
    for r in given.select(F.explode(F.array(*cells)).alias("e")).select("e.*").groupBy("tree", "leaf").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # a row per leaf
        trees[r["tree"]][r["leaf"]]["value"] += leaf_value(r["g"], r["h"], p)
    if temporary:
        drop(given)


def train(df: DataFrame, features: list[str], label: str | list[str], params: Params | None = None, weight: str | None = None, key: str | None = None, valid: DataFrame | None = None, custom=None, init: Model | None = None, callbacks=(), every: int = 10, metric=None) -> Model:
    """Fit a model. `key` names a stable row key for sampling, rankers and survival; `custom(label, raw)` gives (grad, hess)
    columns; `metric` is a name or a callable(rows with prediction) -> (value, higher is better) for early stopping.

    Binned rows and raw scores are held in memory and on disk, and cut from their lineage every few rounds; in between, the
    raw score is an expression over the trees since the last cut.
    """
    p = params or Params()
    cats = [c for c in features if c in p.categorical]
    bins = init.bins if init else Bins.fit(df, features, p.max_bin, p.min_data_in_bin, p.use_missing, cats)
    obj = None if custom is not None or p.objective in (*RANKERS, "cox", "aft", "multiclass", "multi_rmse") else objective(p.objective)
    labels = label if isinstance(label, list) else [label]
    keep = list(dict.fromkeys([*labels, *([weight] if weight else []), *([key] if key else []), *[p.args[a] for a in ("group", "upper", "event") if isinstance(p.args.get(a), str)]]))
    base_rows = bins.binned(df, keep)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    model = Model(features, bins, p, list(init.base), list(init.trees), list(init.weights)) if init else Model(features, bins, p, starts(df, label, weight, p, custom))
    names = [f"__r{c}" for c in range(model.outputs)]

    def fresh_state(rows: DataFrame) -> DataFrame:
        return rows.withColumns(dict(zip(names, model.raw()))).persist()

    def moved(state: DataFrame, change: list[tuple[int, list[Node], float]]) -> DataFrame:
        """Raw scores after trees (by output) have been added with these weights."""
        now = dict.fromkeys(range(model.outputs))
        for c, t, by in change:
            term = route(t, lambda n: F.lit(float(n["value"] * by)), features)
            now[c] = F.col(names[c]) + term if now[c] is None else now[c] + term
        return state.withColumns({names[c]: v for c, v in now.items() if v is not None})

    held = [fresh_state(base_rows)]
    state, written = held[0], None
    watched = None if valid is None else fresh_state(bins.binned(valid, keep))
    rng, stale, top = random.Random(p.seed), 0, None
    for it in range(p.num_iterations):
        raws = [F.col(n) for n in names]
        k = model.outputs
        dropped: list[int] = []  # rounds
        if p.boosting == "dart" and model.trees and rng.random() >= p.skip_drop:
            dropped = [i for i in range(len(model.trees) // k) if rng.random() < p.drop_rate]
            for i in dropped:
                for c in range(k):
                    wt = model.weights[i * k + c]
                    raws[c] = raws[c] - route(model.trees[i * k + c], lambda n: F.lit(float(n["value"] * wt)), features)
        if p.boosting == "rf":
            raws = [F.lit(b) for b in model.base]
        rows, temporary = derive(state, label, raws, w, p, key, custom)
        if p.langevin_temperature and key:
            rows = langevin(rows, key, [f"g{c}" for c in range(k)], p.learning_rate, p.langevin_temperature, p.seed * 65537 + it)
        bag = None
        if p.bagging_freq > 0 and p.bagging_fraction < 1 and key:
            bag = uniform(F.col(key), p.seed * 7919 + it // p.bagging_freq) < p.bagging_fraction
            rows = rows.filter(bag)
        if p.boosting == "goss" and key and it >= int(1 / p.learning_rate):
            size = sum((F.abs(F.col(f"g{c}") * F.col(f"h{c}")) for c in range(1, k)), F.abs(F.col("g0") * F.col("h0")))
            cutoff = rows.agg(F.percentile_approx(size, F.lit(1 - p.top_rate), F.lit(10_000)).alias("t")).first()["t"] or 0.0
            big, scale = size >= cutoff, (1 - p.top_rate) / p.other_rate
            rows = rows.withColumn("__m", F.when(big, 1.0).when(uniform(F.col(key), p.seed * 104729 + it) < p.other_rate / (1 - p.top_rate), scale)).filter(F.col("__m").isNotNull())
            rows = rows.withColumns({f"{n}{c}": F.col(f"{n}{c}") * F.col("__m") for c in range(k) for n in "gh"}).drop("__m")
        allowed = None
        if p.feature_fraction < 1:
            n = max(min(2, len(features)), round(len(features) * p.feature_fraction))
            allowed = sorted(rng.sample(range(len(features)), n))
        used = frozenset(n["feature"] for t in model.trees for n in t if n["feature"] is not None) if p.cegb_penalty_feature else frozenset()
        fresh = grow_all(rows, features, bins, p, k, allowed, used, it * k)
        if obj is not None and obj.renews:
            renew(state if bag is None else state.filter(bag), fresh, label, raws, weight, p, features)
        for _ in range(p.leaf_estimation_iterations - 1):
            restep(state if bag is None else state.filter(bag), fresh, label, raws, w, p, key, custom, features)
        if temporary:
            drop(rows)
        fresh = [[{x: v for x, v in n.items() if x not in ("low", "high", "parent")} for n in t] for t in fresh]
        if all(len(t) == 1 for t in fresh) and p.boosting != "rf":
            break
        rate = 1.0 if p.boosting == "rf" else p.learning_rate / (len(dropped) + 1) if p.boosting == "dart" else p.learning_rate
        change = [(c, t, rate) for c, t in enumerate(fresh)]
        for i in dropped:
            for c in range(k):
                old = model.weights[i * k + c]
                model.weights[i * k + c] = old * len(dropped) / (len(dropped) + 1)
                change.append((c, model.trees[i * k + c], model.weights[i * k + c] - old))
        model.trees += fresh
        model.weights += [rate] * len(fresh)
        if p.boosting != "rf" and it + 1 < p.num_iterations:
            state = moved(state, change)
            if (it + 1) % every == 0:
                after = cut(state)
                for h in held:
                    h.unpersist()
                if written is not None:
                    drop(written)
                held, state, written = [], after, after
        for call in callbacks:
            call(it, model)
        if watched is not None and p.early_stopping_round:
            watched = moved(watched, change) if p.boosting != "rf" else watched
            if (it + 1) % every == 0:
                watched = cut(watched)
            value, higher = judged(watched, model, label, w, metric)
            model.history.append({"iteration": it, "loss": value})
            loss = -value if higher else value
            if top is None or loss < top - p.min_delta:
                top, stale, model.best_iteration = loss, 0, it + 1
            else:
                stale += 1
                if stale >= p.early_stopping_round:
                    n = model.best_iteration * model.outputs
                    model.trees, model.weights = model.trees[:n], model.weights[:n]
                    break
    for h in held:
        h.unpersist()
    if p.boosting == "rf" and model.trees:
        model.weights = [model.outputs / len(model.trees)] * len(model.trees)
    return model


def judged(rows: DataFrame, model: Model, label: str, w: Column, metric=None) -> tuple[float, bool]:
    """A metric of rows with raw scores __r0, ...: its value, and whether higher is better."""
    raws = [F.col(f"__r{c}") for c in range(model.outputs)]
    if metric is None:
        return loss_of(rows, model, label, w, raws), False
    if model.outputs > 1:
        scored = rows.withColumn("probabilities", F.array(*softmax(raws))).withColumn("prediction", F.expr("array_position(probabilities, array_max(probabilities)) - 1"))
    else:
        special = model.params.objective in (*RANKERS, "cox", "aft")
        scored = rows.withColumn("prediction", raws[0] if special else objective(model.params.objective).response(raws[0]))
    if callable(metric):
        return metric(scored)
    from . import metrics

    group = model.params.args.get("group")
    if metric in metrics.POINTWISE:
        return metrics.pointwise(scored.withColumn("__w", w), metric, label, "prediction", "__w", model.params.args).first()["value"], metrics.POINTWISE[metric]
    if metric in ("auc", "average_precision"):
        return getattr(metrics, metric)(scored.withColumn("__w", w), label, "prediction", "__w").first()["value"], True
    if metric in ("multi_logloss", "multi_error"):
        return metrics.multiclass(scored, metric, label, "probabilities").first()["value"], False
    if metric in ("ndcg", "map") and group:
        tie = F.xxhash64(*[c for c in rows.columns if not c.startswith("__")])
        f = metrics.ndcg if metric == "ndcg" else metrics.mean_average_precision
        return f(scored.withColumn("__tie", tie), group, label, "prediction", "__tie").first()["value"], True
    raise ValueError(f"unknown metric {metric!r}")


def validation_loss(binned: DataFrame, model: Model, label: str, w: Column) -> float:
    """The objective's natural loss over binned rows."""
    return loss_of(binned, model, label, w, model.raw())


def loss_of(rows: DataFrame, model: Model, label: str | list[str], w: Column, raws: list[Column]) -> float:
    """Log loss for probabilities, mean squared error of the response otherwise."""
    if model.params.objective == "multi_rmse":
        each = sum((F.coalesce((F.col(c) - r) * (F.col(c) - r), F.lit(0.0)) for c, r in zip(label, raws)), F.lit(0.0))
        return rows.agg((F.sum(each * w) / F.sum(w)).alias("l")).first()["l"]
    y = F.col(label).cast("double")
    if model.outputs > 1:
        each = -F.log(F.greatest(F.element_at(F.array(*softmax(raws)), y.cast("int") + 1), F.lit(1e-15)))
    elif model.params.objective in (*RANKERS, "cox", "aft"):
        raise ValueError(f"{model.params.objective} has no loss of its own; name a metric")
    else:
        obj = objective(model.params.objective)
        q = obj.response(raws[0])
        if obj.link == "sigmoid":
            q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), q))
            each = -(y * F.log(q) + (1 - y) * F.log(1 - q))
        else:
            each = (y - q) * (y - q)
    return rows.agg((F.sum(each * w) / F.sum(w)).alias("l")).first()["l"]
