"""Split search over histograms: running sums per (node, feature) and the best candidate per node."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.random import normal, uniform


@dataclass
class SplitParams:
    lambda_l1: float = 0.0
    lambda_l2: float = 1.0
    min_data_in_leaf: int = 20
    min_child_hess: float = 1e-3
    min_gain_to_split: float = 0.0
    max_delta_step: float = 0.0
    path_smooth: float = 0.0
    #: by node: its own output, which its children are smoothed towards
    parents: dict[int, float] = field(default_factory=dict)
    score: str = "L2"  # or Cosine
    #: by feature number: multiplier of the gain, and -1/0/1 for monotone direction
    contri: dict[int, float] = field(default_factory=dict)
    monotone: dict[int, int] = field(default_factory=dict)
    #: one random threshold per (node, feature) instead of all; normal noise on gains; both keyed by seed
    extra_trees: bool = False
    random_strength: float = 0.0
    seed: int = 0
    #: cost-efficient boosting: tradeoff * (penalty per row of the node + penalty of a feature not in use yet)
    cegb_tradeoff: float = 1.0
    cegb_penalty_split: float = 0.0
    cegb_penalty_feature: dict[int, float] = field(default_factory=dict)


def by_feature(values: dict[int, float], default: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (int(k), float(v))]), F.col("feature")), F.lit(default))


def threshold(g: Column, l1: float) -> Column:
    """Soft threshold of a gradient sum."""
    return g if not l1 else F.signum(g) * F.greatest(F.abs(g) - l1, F.lit(0.0))


def output(g: Column, h: Column, p: SplitParams) -> Column:
    out = -threshold(g, p.lambda_l1) / (h + p.lambda_l2)
    return F.greatest(F.lit(-p.max_delta_step), F.least(F.lit(p.max_delta_step), out)) if p.max_delta_step else out


def score(g: Column, h: Column, p: SplitParams, w: Column | None = None) -> Column:
    """The gain of a leaf, at its free Newton step or at the output w that it is made to give."""
    if w is None and p.max_delta_step:
        w = output(g, h, p)
    if w is not None:
        return -(2 * threshold(g, p.lambda_l1) * w + (h + p.lambda_l2) * w * w)
    t = threshold(g.cast("double"), p.lambda_l1)  # whole-number sums would overflow when squared
    return t * t / (h + p.lambda_l2)


def finished(g: Column, h: Column, n: Column, p: SplitParams) -> Column:
    """A leaf's output, capped and then smoothed towards its parent's, the more the fewer rows it has."""
    out = output(g, h, p)
    if not p.path_smooth:
        return out
    share = n / F.lit(float(p.path_smooth))
    return (out * share + by_node(p.parents, 0.0)) / (share + 1)


def cosine(product: Column, norm: Column) -> Column:
    """How well outputs follow the negative gradients, whatever their scale."""
    return product / F.sqrt(F.greatest(norm, F.lit(1e-100)))


def by_node(values: dict[int, float], default: float) -> Column:
    if not values:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (int(k), float(v))]), F.col("node")), F.lit(default))


def candidates(hist: DataFrame, params: SplitParams, missing: dict[int, int] | None = None) -> DataFrame:
    """Every admissible (node, feature, bin, default_left) with its gain and the sums of both sides."""
    p = params
    lost = F.lit(False)
    for f, b in (missing or {}).items():
        lost = lost | ((F.col("feature") == f) & (F.col("bin") == b))
    whole = W.partitionBy("node", "feature")
    run = whole.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    sums = {}
    for c in ("g", "h", "n"):
        own = F.when(lost, 0).otherwise(F.col(c))
        sums |= {f"run_{c}": F.sum(own).over(run), f"all_{c}": F.sum(c).over(whole), f"lost_{c}": F.sum(F.when(lost, F.col(c)).otherwise(0)).over(whole)}
    scan = hist.withColumns(sums).filter(~lost)
    scan = scan.withColumn("default_left", F.explode(F.when(F.col("lost_n") > 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    scan = scan.withColumns({f"left_{c}": F.col(f"run_{c}") + F.when(F.col("default_left"), F.col(f"lost_{c}")).otherwise(0) for c in "ghn"})
    scan = scan.withColumns({f"right_{c}": F.col(f"all_{c}") - F.col(f"left_{c}") for c in "ghn"})
    lg, lh, rg, rh = (F.col(c).cast("double") for c in ("left_g", "left_h", "right_g", "right_h"))
    if p.score == "Cosine":
        tg, th = F.col("all_g").cast("double"), F.col("all_h").cast("double")
        lo, ro, wo = output(lg, lh, p), output(rg, rh, p), output(tg, th, p)
        gain = cosine(-lo * lg - ro * rg, lo * lo * lh + ro * ro * rh) - cosine(-wo * tg, wo * wo * th)
    else:
        whole_score = score(F.col("all_g").cast("double"), F.col("all_h").cast("double"), SplitParams(p.lambda_l1, p.lambda_l2))
        if p.path_smooth or p.max_delta_step:
            gain = score(lg, lh, p, finished(lg, lh, F.col("left_n"), p)) + score(rg, rh, p, finished(rg, rh, F.col("right_n"), p)) - whole_score
        else:
            gain = score(lg, lh, p) + score(rg, rh, p) - whole_score
    if p.contri:
        gain = gain * by_feature(p.contri, 1.0)
    if p.cegb_penalty_split:
        gain = gain - p.cegb_tradeoff * p.cegb_penalty_split * F.col("all_n")
    if p.cegb_penalty_feature:
        gain = gain - p.cegb_tradeoff * by_feature(p.cegb_penalty_feature, 0.0)
    cell = F.concat_ws(":", "node", "feature")
    if p.random_strength:
        gain = gain + p.random_strength * normal(F.concat_ws(":", cell, F.col("bin").cast("string")), p.seed)
    ok = (F.col("left_n") >= p.min_data_in_leaf) & (F.col("right_n") >= p.min_data_in_leaf) & (lh >= p.min_child_hess) & (rh >= p.min_child_hess)
    for f, sign in p.monotone.items():
        if sign:
            ok = ok & ((F.col("feature") != f) | ((output(rg, rh, p) - output(lg, lh, p)) * sign >= 0))
    if p.extra_trees:
        last = F.count(F.lit(1)).over(W.partitionBy("node", "feature", "default_left")) - 1  # the top bin splits nothing off
        place = F.row_number().over(W.partitionBy("node", "feature", "default_left").orderBy("bin")) - 1
        scan = scan.withColumn("__ok", place == F.floor(uniform(cell, p.seed) * F.greatest(last, F.lit(1))))
        ok = ok & F.col("__ok")
    return scan.withColumn("gain", gain).filter(ok & (F.col("gain") > p.min_gain_to_split)).drop("__ok")


def best(hist: DataFrame, params: SplitParams, missing: dict[int, int] | None = None) -> DataFrame:
    """One row per node that can be split; ties go to the lower feature, lower bin and missing left."""
    found = candidates(hist, params, missing)
    order = F.struct("gain", -F.col("feature"), -F.col("bin"), F.col("default_left"))
    columns = [c for c in found.columns if c != "node"]
    return found.groupBy("node").agg(F.max_by(F.struct(*columns), order).alias("s")).select("node", "s.*")


def best_categorical(hist: DataFrame, params: SplitParams, max_cat_to_onehot: int = 4, cat_smooth: float = 10.0, cat_l2: float = 10.0, max_cat_threshold: int = 32) -> DataFrame:
    """(node, feature, categories to the left, gain): one against the rest for few categories, else prefixes of the
    categories sorted by gradient over smoothed hessian, from both ends."""
    p = SplitParams(**{**params.__dict__, "lambda_l2": params.lambda_l2 + cat_l2})
    whole = W.partitionBy("node", "feature")
    h = hist.withColumns({"k": F.count(F.lit(1)).over(whole), **{f"all_{c}": F.sum(c).over(whole) for c in ("g", "h", "n")}})
    one = h.filter(F.col("k") + 1 <= max_cat_to_onehot).select("node", "feature", F.array("bin").alias("left"), *[F.col(c).alias(f"l{c}") for c in "ghn"], "all_g", "all_h", "all_n", F.lit(1).alias("onehot"))
    many = h.filter(F.col("k") + 1 > max_cat_to_onehot).withColumn("ratio", F.col("g") / (F.col("h") + cat_smooth))
    parts = []
    for key in (F.asc("ratio"), F.desc("ratio")):
        by = whole.orderBy(key, "bin").rowsBetween(W.unboundedPreceding, 0)
        sums = [F.sum(c).over(by).alias(f"l{c}") for c in "ghn"]
        part = many.select("node", "feature", F.collect_list("bin").over(by).alias("left"), *sums, "all_g", "all_h", "all_n", F.lit(0).alias("onehot"))
        parts.append(part.filter(F.size("left") <= max_cat_threshold))
    both = one.unionByName(parts[0]).unionByName(parts[1])
    lg, lh, rg, rh = F.col("lg"), F.col("lh"), F.col("all_g") - F.col("lg"), F.col("all_h") - F.col("lh")
    plain = score(lg, lh, params) + score(rg, rh, params)
    gain = F.when(F.col("onehot") == 1, plain).otherwise(score(lg, lh, p) + score(rg, rh, p)) - score(F.col("all_g"), F.col("all_h"), params)
    ok = (F.col("ln") >= p.min_data_in_leaf) & (F.col("all_n") - F.col("ln") >= p.min_data_in_leaf) & (lh >= p.min_child_hess) & (rh >= p.min_child_hess)
    found = both.withColumn("left", F.sort_array("left")).withColumn("gain", gain).filter(ok & (F.col("gain") > p.min_gain_to_split))
    order = W.partitionBy("node").orderBy(F.desc("gain"), "feature", F.col("left").cast("string"))
    right = [(F.col(f"all_{c}") - F.col(f"l{c}")).alias(f"r{c}") for c in "ghn"]
    return found.withColumn("__r", F.row_number().over(order)).filter("__r = 1").select("node", "feature", "left", "gain", "onehot", "lg", "lh", "ln", *right)


def oblivious(hist: DataFrame, params: SplitParams) -> DataFrame:
    """The one (feature, bin) whose gain, summed over all nodes of a level, is largest."""
    loose = SplitParams(**{**params.__dict__, "min_gain_to_split": float("-inf"), "min_data_in_leaf": 0, "min_child_hess": 0.0})
    grid = hist.select("feature", "bin").distinct().crossJoin(hist.select("node").distinct())  # features x bins x nodes of one level
    full = grid.join(hist, ["node", "feature", "bin"], "left").fillna(0, ["g", "h", "n"])
    each = candidates(full, loose).groupBy("feature", "bin").agg(F.sum("gain").alias("gain"))
    return each.filter(F.col("gain") > params.min_gain_to_split).orderBy(F.desc("gain"), "feature", "bin").limit(1)
