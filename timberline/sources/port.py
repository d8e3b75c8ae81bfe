"""Parameters of other boosters, and what of a model can be edited."""

from __future__ import annotations

from ..operators.boost import Params

#: By source: their names for ours, where they differ beyond the aliases (fixed values of those libraries).
NAMES = {
    "lightgbm": {"min_gain_to_split": "min_gain_to_split", "monotone_constraints": "monotone", "interaction_constraints": "interaction", "categorical_feature": "categorical", "early_stopping_rounds": "early_stopping_round", "cat_l2": "cat_l2", "feature_contri": "feature_contri"},
    "xgboost": {"reg_alpha": "lambda_l1", "alpha": "lambda_l1", "reg_lambda": "lambda_l2", "lambda": "lambda_l2", "min_child_weight": "min_child_hess", "colsample_bytree": "feature_fraction", "subsample": "bagging_fraction", "max_delta_step": "max_delta_step", "booster": "boosting", "rate_drop": "drop_rate", "skip_drop": "skip_drop", "max_leaves": "num_leaves"},
    "catboost": {"iterations": "num_iterations", "l2_leaf_reg": "lambda_l2", "depth": "max_depth", "border_count": "max_bin", "rsm": "feature_fraction", "random_seed": "seed", "random_strength": "random_strength", "min_data_in_leaf": "min_data_in_leaf", "cat_features": "categorical", "leaf_estimation_iterations": "leaf_estimation_iterations", "diffusion_temperature": "langevin_temperature", "od_wait": "early_stopping_round"},
}
#: Values that have other names.
VALUES = {
    "lightgbm": {},
    "xgboost": {("objective", "reg:squarederror"): "l2", ("objective", "binary:logistic"): "binary", ("objective", "multi:softprob"): "multiclass", ("objective", "multi:softmax"): "multiclass", ("objective", "count:poisson"): "poisson", ("objective", "reg:gamma"): "gamma", ("objective", "reg:tweedie"): "tweedie", ("objective", "reg:absoluteerror"): "l1", ("objective", "rank:ndcg"): "lambdarank", ("objective", "rank:pairwise"): "pair_logit", ("objective", "survival:cox"): "cox", ("objective", "survival:aft"): "aft", ("boosting", "gbtree"): "gbdt", ("grow_policy", "lossguide"): "leafwise"},
    "catboost": {("objective", "RMSE"): "l2", ("objective", "Logloss"): "binary", ("objective", "CrossEntropy"): "cross_entropy", ("objective", "MultiClass"): "multiclass", ("objective", "MAE"): "l1", ("objective", "Quantile"): "quantile", ("objective", "MAPE"): "mape", ("objective", "Poisson"): "poisson", ("objective", "QueryRMSE"): "query_rmse", ("objective", "PairLogit"): "pair_logit", ("objective", "YetiRank"): "yetirank", ("objective", "Cox"): "cox", ("objective", "SurvivalAft"): "aft", ("objective", "MultiRMSE"): "multi_rmse", ("grow_policy", "SymmetricTree"): "oblivious", ("grow_policy", "Depthwise"): "depthwise", ("grow_policy", "Lossguide"): "leafwise"},
}
#: Names that only say how a machine is used.
MACHINE = {"n_jobs", "num_threads", "nthread", "thread_count", "verbose", "verbosity", "silent", "device", "device_type", "task_type", "devices", "tree_method", "force_row_wise", "force_col_wise", "deterministic", "logging_level", "allow_writing_files"}


def port(given: dict, source: str) -> tuple[Params, list[tuple[str, str, str]]]:
    """Our parameters from another booster's, and (name, status, ours) of each: kept, renamed, machine or refused.

    Defaults that differ are set: CatBoost grows symmetric trees, XGBoost depth-wise ones of depth 6.
    """
    if source not in NAMES:
        raise ValueError(f"unknown source {source!r}; known: {', '.join(NAMES)}")
    out: dict = {"xgboost": {"grow_policy": "depthwise", "max_depth": 6, "num_leaves": 64, "learning_rate": 0.3}, "catboost": {"grow_policy": "oblivious", "max_depth": 6, "num_leaves": 64, "learning_rate": 0.03, "num_iterations": 1000, "lambda_l2": 3.0}}.get(source, {}).copy()
    report = []
    for name, value in given.items():
        ours = NAMES[source].get(name, Params.ALIASES.get(name, name))
        if name in MACHINE:
            report.append((name, "machine", ""))
        elif ours not in Params.__dataclass_fields__ and ours not in Params.ARGS:
            report.append((name, "refused", ""))
        else:
            out[ours] = VALUES[source].get((ours, value), value) if isinstance(value, str) else value
            report.append((name, "kept" if ours == name else "renamed", ours))
    if source == "xgboost" and out.get("bagging_fraction", 1.0) < 1 or source == "catboost" and "bagging_fraction" in out:
        out.setdefault("bagging_freq", 1)
    return Params.of(**out), report


#: What can be done to a trained model, and the function that does it.
EDITS = {
    "leaf values": "inspect.get_leaf, inspect.set_leaf", "fewer rounds": "inspect.rollback", "order of rounds": "inspect.permute", "scale": "inspect.shrink", "new leaf values from data": "inspect.refit",
    "no gains": "port.without_gains", "text of another library": "io.lightgbm_text, io.from_lightgbm_text", "JSON": "io.dumps, io.loads",
}


def without_gains(model):
    """A copy whose splits have no gains."""
    import copy

    out = copy.deepcopy(model)
    for t in out.trees:
        for n in t:
            if n["feature"] is not None:
                n["gain"] = 0.0
    return out
