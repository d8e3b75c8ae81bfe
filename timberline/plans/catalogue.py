"""Registered queries of the engine over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import objectives as O
from ..functions.random import bag_stream, splitmix64, uniform
from ..operators import binning, boost, cv, features, groups, histogram, inspect, joins, linear, metrics, ranges, ranking, sampling, sparse, split, validate
from .storage import cut
from .tree_sql import Fit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FEATURES = ["l_quantity", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(c, name: str):
    return (F.round(c.cast("double"), 6) + 0.0).alias(name)  # no negative zero


# --- validation and binning --------------------------------------------------------------------------------------


@query("column_report", " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*)::BIGINT AS n_rows, (count(*) - count({c}))::BIGINT AS n_missing, count(DISTINCT {c})::BIGINT AS n_distinct, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, count(DISTINCT {c}) <= 1 AS is_constant FROM lineitem" for c in [*FEATURES, "l_extendedprice"]))
def column_report(spark, d):
    return validate.column_report(table(spark, d, "lineitem"), [*FEATURES, "l_extendedprice"])


def _levels_sql(c: str) -> str:
    """Edges midway between neighbouring distinct values, for columns with few values."""
    return f"SELECT '{c}' AS feature, round((v + lead(v) OVER (ORDER BY v)) / 2, 6) AS edge FROM (SELECT DISTINCT {c} AS v FROM lineitem) QUALIFY lead(v) OVER (ORDER BY v) IS NOT NULL"


@query("level_edges", " UNION ALL ".join(f"({_levels_sql(c)})" for c in FEATURES))
def level_edges(spark, d):
    return binning.quantile_edges(table(spark, d, "lineitem"), FEATURES).select("feature", r6(F.col("edge"), "edge"))


@query("quantile_edges", """
WITH p AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS r, count(*) OVER () AS n FROM lineitem),
low AS (SELECT DISTINCT p.v AS v FROM p, range(1, 32) AS t(b) WHERE p.r = (t.b * p.n) // 32),
vals AS (SELECT v, lead(v) OVER (ORDER BY v) AS nxt FROM (SELECT DISTINCT v FROM p))
SELECT 'l_extendedprice' AS feature, round((v + nxt) / 2, 6) AS edge FROM vals SEMI JOIN low USING (v) WHERE nxt IS NOT NULL""")
def quantile_edges(spark, d):
    return binning.quantile_edges(table(spark, d, "lineitem"), ["l_extendedprice"], 32).select("feature", r6(F.col("edge"), "edge"))


@query("equal_width_bins", "SELECT bin::INT AS bin, count(*)::BIGINT AS n FROM (SELECT CASE WHEN hi = lo THEN 0 ELSE least(floor((l_quantity - lo) / (hi - lo) * 16), 15) END AS bin FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)) GROUP BY 1")
def equal_width_bins(spark, d):
    return binning.equal_width(table(spark, d, "lineitem"), "l_quantity", 16).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("bin_transform", """
WITH e AS (SELECT (v + lead(v) OVER (ORDER BY v)) / 2 AS edge FROM (SELECT DISTINCT l_quantity AS v FROM lineitem)),
c AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1)
SELECT (SELECT count(*) FROM e WHERE edge < c.v)::INT AS bin, n::BIGINT AS n FROM c""")
def bin_transform(spark, d):
    li = table(spark, d, "lineitem")
    bins = binning.Bins.fit(li, ["l_quantity"])
    return bins.transform(li).groupBy(F.col("b_l_quantity").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("category_table", "SELECT o_orderpriority AS category, count(*)::BIGINT AS n, (row_number() OVER (ORDER BY o_orderpriority) - 1)::INT AS code FROM orders GROUP BY 1")
def category_table(spark, d):
    return binning.categories(table(spark, d, "orders"), "o_orderpriority")


@query("label_encode", "SELECT c_custkey, code::INT AS segment_code FROM customer JOIN (SELECT c_mktsegment AS s, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)) ON c_mktsegment = s")
def label_encode(spark, d):
    c = table(spark, d, "customer")
    return binning.encode(c, "c_mktsegment", binning.categories(c, "c_mktsegment"), "segment_code").select("c_custkey", "segment_code")


@query("feature_prefilter", """
WITH s AS (SELECT 'p_size' AS feature, p_size::DOUBLE AS v FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part),
c AS (SELECT feature, v, count(*) AS n FROM s GROUP BY ALL), r AS (SELECT feature, sum(n) OVER (PARTITION BY feature ORDER BY v) AS l, sum(n) OVER (PARTITION BY feature) AS t FROM c)
SELECT feature, bool_or(l >= 20 AND t - l >= 20) AS usable FROM r GROUP BY 1""")
def feature_prefilter(spark, d):
    return binning.prefilter(table(spark, d, "part"), ["p_size", "p_retailprice"], 20)


# --- sampling ----------------------------------------------------------------------------------------------------

_U = "(('0x' || substr(md5('{seed}:' || {key}), 1, 13))::BIGINT / 4503599627370496.0)"


@query("bagging_sample", f"SELECT o_orderkey FROM orders WHERE {_U.format(seed=7, key='o_orderkey')} < 0.3")
def bagging_sample(spark, d):
    return sampling.bag(table(spark, d, "orders"), "o_orderkey", 0.3, 7).select("o_orderkey")


@query("class_bagging", f"SELECT doc_id, toxic FROM labels WHERE {_U.format(seed=3, key='doc_id')} < CASE WHEN toxic > 0 THEN 0.9 ELSE 0.2 END")
def class_bagging(spark, d):
    return sampling.class_bag(table(spark, d, "labels"), "doc_id", "toxic", 0.9, 0.2, 3).select("doc_id", "toxic")


@query("query_bagging", f"SELECT l_orderkey, count(*)::BIGINT AS n FROM lineitem WHERE {_U.format(seed=5, key='l_orderkey')} < 0.25 GROUP BY 1")
def query_bagging(spark, d):
    return sampling.query_bag(table(spark, d, "lineitem"), "l_orderkey", 0.25, 5).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("bayesian_bootstrap", f"SELECT o_orderkey, round(pow(-ln({_U.format(seed=2, key='o_orderkey')} + 1e-100), 0.5), 6) AS weight FROM orders")
def bayesian_bootstrap(spark, d):
    return sampling.bayesian_weight(table(spark, d, "orders"), "o_orderkey", 0.5, 2).select("o_orderkey", r6(F.col("weight"), "weight"))


@query("goss_sample", f"""WITH t AS (SELECT o_orderkey, o_totalprice / 99991 - 1.5 AS g FROM orders), c AS (SELECT quantile_cont(abs(g), 0.8) AS t FROM t)
SELECT o_orderkey, CASE WHEN abs(g) >= t THEN 1.0 ELSE 8.0 END::DOUBLE AS multiplier FROM t, c WHERE abs(g) >= t OR {_U.format(seed=4, key='o_orderkey')} < 0.125""")
def goss_sample(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 99991 - 1.5).alias("g"), F.lit(1.0).alias("h"))
    return sampling.goss(o, "o_orderkey", "g", "h", 0.2, 0.1, 4).select("o_orderkey", F.round("multiplier", 6).alias("multiplier"))


@query("class_weights_balanced", "SELECT toxic, count(*)::BIGINT AS n, round((SELECT count(*) FROM labels) / (2.0 * count(*)), 6) AS weight FROM labels GROUP BY 1")
def class_weights_balanced(spark, d):
    return sampling.class_weights(table(spark, d, "labels"), "toxic").select("toxic", "n", r6(F.col("weight"), "weight"))


@query("cv_folds", f"SELECT floor({_U.format(seed=0, key='o_orderkey')} * 5)::INT AS fold, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def cv_folds(spark, d):
    return sampling.folds(table(spark, d, "orders"), "o_orderkey").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


# --- derivatives -------------------------------------------------------------------------------------------------

_GRADS = {
    "l2": ("r - y", "1.0"),
    "poisson": ("exp(r) - y", "exp(r + 0.7)"),
    "huber": ("greatest(-0.9, least(0.9, r - y))", "1.0"),
    "quantile": ("CASE WHEN r - y >= 0 THEN 1 - 0.9 ELSE -0.9 END", "1.0"),
    "l1": ("sign(r - y)", "1.0"),
    "gamma": ("1 - y * exp(-r)", "y * exp(-r)"),
    "tweedie": ("-y * exp(-0.5 * r) + exp(0.5 * r)", "0.5 * y * exp(-0.5 * r) + 0.5 * exp(0.5 * r)"),
    "mape": ("sign(r - y) / greatest(1.0, abs(y))", "1 / greatest(1.0, abs(y))"),
    "fair": ("(r - y) / (abs(r - y) + 1)", "1 / pow(abs(r - y) + 1, 2)"),
    "binary": ("1 / (1 + exp(-r)) - (y > 2)::INT", "greatest((1 / (1 + exp(-r))) * (1 - 1 / (1 + exp(-r))), 1e-16)"),
    "cross_entropy": ("1 / (1 + exp(-r)) - least(1.0, y / 6)", "greatest((1 / (1 + exp(-r))) * (1 - 1 / (1 + exp(-r))), 1e-16)"),
}


def _scored(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 99991).alias("y"), (F.col("o_orderkey") % 7 / 4.0).alias("r"))


for _name, (_g, _h) in _GRADS.items():

    def _grad(spark, d, name=_name):
        y = {"binary": (F.col("y") > 2).cast("double"), "cross_entropy": F.least(F.lit(1.0), F.col("y") / 6)}.get(name, F.col("y"))
        g, h = O.objective(name).derivatives(y, F.col("r"), {})
        return _scored(spark, d).select("o_orderkey", r6(g, "grad"), r6(h, "hess"))

    query(f"grad_hess_{_name}", f"SELECT o_orderkey, round(({_g})::DOUBLE, 6) + 0.0 AS grad, round(({_h})::DOUBLE, 6) + 0.0 AS hess FROM (SELECT o_orderkey, o_totalprice / 99991 AS y, (o_orderkey % 7) / 4.0::DOUBLE AS r FROM orders)")(_grad)


@query("grad_hess_multiclass", "SELECT o_orderkey, round(e0 / s - (o_orderkey % 3 = 0)::INT, 6) AS g0, round(1.5 * (e0 / s) * (1 - e0 / s), 6) AS h0, round(e2 / s - (o_orderkey % 3 = 2)::INT, 6) AS g2 FROM (SELECT o_orderkey, exp(o_totalprice / 99991) AS e0, exp(0.5::DOUBLE) AS e1, exp((o_orderkey % 7) / 4.0::DOUBLE) AS e2, e0 + e1 + e2 AS s FROM orders)")
def grad_hess_multiclass(spark, d):
    (g0, h0), _, (g2, _) = O.multiclass_derivatives(F.col("o_orderkey") % 3, [F.col("y"), F.lit(0.5), F.col("r")])
    return _scored(spark, d).select("o_orderkey", r6(g0, "g0"), r6(h0, "h0"), r6(g2, "g2"))


#: (objective, label, start in SQL over y and the weight w); percentiles of weighted rows are in `_percentile_sql`
_STARTS = {
    "l2": "sum(y * w) / sum(w)", "huber": "sum(y * w) / sum(w)", "fair": "sum(y * w) / sum(w)", "poisson": "ln(sum(y * w) / sum(w))", "gamma": "ln(sum(y * w) / sum(w))", "tweedie": "ln(sum(y * w) / sum(w))",
    "binary": "ln(sum((y > 2)::INT * w) / sum(w) / (1 - sum((y > 2)::INT * w) / sum(w)))", "cross_entropy": "ln(sum(least(1.0, y / 6) * w) / sum(w) / (1 - sum(least(1.0, y / 6) * w) / sum(w)))",
}


def _percentile_sql(rows: str, alpha: float, by: str = "0") -> str:
    """(k, value): where the running weight of rows (k, v, w) first exceeds alpha of the total."""
    return f"""SELECT k, coalesce(any_value(CASE WHEN pos = 1 OR pos = n THEN v WHEN w >= 1 THEN pv + (t * {alpha} - (c - w)) / w * (v - pv) ELSE pv END) FILTER (hit = 1), max(v)) AS value FROM (
  SELECT *, CASE WHEN c > t * {alpha} THEN row_number() OVER (PARTITION BY k, c > t * {alpha} ORDER BY pos) END AS hit FROM (
    SELECT {by} AS k, v, w, sum(w) OVER (PARTITION BY {by} ORDER BY v, w ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY {by}) AS t, row_number() OVER (PARTITION BY {by} ORDER BY v, w) AS pos, count(*) OVER (PARTITION BY {by}) AS n, lag(v) OVER (PARTITION BY {by} ORDER BY v, w) AS pv FROM ({rows}))) GROUP BY k"""


_WEIGHED = "SELECT o_totalprice / 99991 AS y, (1 + o_orderkey % 4)::DOUBLE AS w FROM orders"


@query("base_scores", " UNION ALL ".join([
    *(f"SELECT '{n}' AS objective, round(({e})::DOUBLE, 6) AS base FROM ({_WEIGHED})" for n, e in _STARTS.items()),
    *(f"SELECT '{n}', round(value, 6) FROM ({_percentile_sql(f'SELECT y AS v, {w} AS w FROM ({_WEIGHED})', a)})" for n, a, w in (("l1", 0.5, "w"), ("quantile", 0.9, "w"), ("mape", 0.5, "w / greatest(1.0, abs(y))"))),
    "SELECT 'l1 unweighted', round(quantile_cont(o_totalprice / 99991, 0.5), 6) FROM orders", "SELECT 'quantile unweighted', round(quantile_cont(o_totalprice / 99991, 0.9), 6) FROM orders",
]))
def base_scores(spark, d):
    rows = _scored(spark, d).withColumn("w", (1 + F.col("o_orderkey") % 4).cast("double"))
    rows = rows.withColumn("binary", (F.col("y") > 2).cast("int")).withColumn("cross_entropy", F.least(F.lit(1.0), F.col("y") / 6))
    out = [(n, O.objective(n).base_score(rows, n if n in rows.columns else "y", "w")) for n in O.OBJECTIVES]
    out += [(f"{n} unweighted", O.objective(n).base_score(rows, "y")) for n in ("l1", "quantile")]
    return spark.createDataFrame(out, "objective string, base double").select("objective", r6(F.col("base"), "base"))


# --- histograms and splits ---------------------------------------------------------------------------------------


def _binned(spark, d):
    """Three binned features; gradients are whole numbers, so that sums are exact in any order."""
    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_quantity").cast("int").alias("b_q"), F.round(F.col("l_discount") * 100).cast("int").alias("b_d"), F.round(F.col("l_tax") * 100).cast("int").alias("b_t"), (F.round("l_extendedprice").cast("long") - 38000).alias("g"), F.lit(1).cast("long").alias("h"), (F.col("l_orderkey") % 3).cast("int").alias("node"))
    return rows


_CELLS = "SELECT node, f AS feature, b AS bin, sum(g)::BIGINT AS g, sum(h)::BIGINT AS h, count(*)::BIGINT AS n FROM (SELECT {node} AS node, round(l_extendedprice)::BIGINT - 38000 AS g, 1 AS h, unnest([{{'f': 0, 'b': l_quantity::INT}}, {{'f': 1, 'b': round(l_discount * 100)::INT}}, {{'f': 2, 'b': round(l_tax * 100)::INT}}], recursive := true) FROM lineitem) GROUP BY ALL"


@query("histogram_numeric", _CELLS.format(node="0::INT"))
def histogram_numeric(spark, d):
    return histogram.histogram(_binned(spark, d), ["q", "d", "t"])


@query("histogram_by_node", _CELLS.format(node="(l_orderkey % 3)::INT"))
def histogram_by_node(spark, d):
    return histogram.histogram(_binned(spark, d), ["q", "d", "t"], node="node")


@query("histogram_subtract", f"SELECT 0::INT AS node, feature, bin, sum(g)::BIGINT AS g, sum(h)::BIGINT AS h, sum(n)::BIGINT AS n FROM ({_CELLS.format(node='(l_orderkey % 3)::INT')}) WHERE node <> 0 GROUP BY feature, bin")
def histogram_subtract(spark, d):
    rows = _binned(spark, d)
    return histogram.subtract(histogram.histogram(rows, ["q", "d", "t"]), histogram.histogram(rows.filter("node = 0"), ["q", "d", "t"]))


def _split_sql(l1: float = 0.0, l2: float = 1.0, node: str = "(l_orderkey % 3)::INT", least: int = 20) -> str:
    def s(g, h):
        t = f"(sign({g}) * greatest(abs({g}) - {l1}, 0))" if l1 else g
        return f"({t} * {t} / ({h} + {l2}))"

    return f"""WITH hist AS ({_CELLS.format(node=node)}),
c AS (SELECT *, sum(g) OVER w AS lg, sum(h) OVER w AS lh, sum(n) OVER w AS ln, sum(g) OVER p AS tg, sum(h) OVER p AS th, sum(n) OVER p AS tn FROM hist WINDOW w AS (PARTITION BY node, feature ORDER BY bin), p AS (PARTITION BY node, feature)),
s AS (SELECT *, {s('lg::DOUBLE', 'lh')} + {s('(tg - lg)::DOUBLE', '(th - lh)')} - {s('tg::DOUBLE', 'th')} AS gain FROM c WHERE ln >= {least} AND tn - ln >= {least})
SELECT node, feature, bin, round(gain, 2) AS gain, ln::BIGINT AS left_n FROM s WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin) = 1"""


def _best(spark, d, **p):
    found = split.best(histogram.histogram(_binned(spark, d), ["q", "d", "t"], node="node"), split.SplitParams(**p))
    return found.select("node", "feature", "bin", F.round("gain", 2).alias("gain"), F.col("left_n").cast("long").alias("left_n"))


query("best_split_numeric", _split_sql())(lambda spark, d: _best(spark, d))
query("best_split_l1", _split_sql(l1=50000.0, l2=5.0))(lambda spark, d: _best(spark, d, lambda_l1=50000.0, lambda_l2=5.0))
query("best_split_min_data", _split_sql(least=200))(lambda spark, d: _best(spark, d, min_data_in_leaf=200))


@query("best_split_missing", f"""WITH hist AS ({_CELLS.format(node="(l_orderkey % 3)::INT")}), m AS (SELECT *, feature = 1 AND bin = 10 OR feature = 2 AND bin = 8 AS lost FROM hist),
c AS (SELECT *, {", ".join(f"sum(CASE WHEN lost THEN 0 ELSE {x} END) OVER w AS r{x}, sum({x}) OVER p AS t{x}, sum(CASE WHEN lost THEN {x} ELSE 0 END) OVER p AS m{x}" for x in "ghn")} FROM m WINDOW w AS (PARTITION BY node, feature ORDER BY bin), p AS (PARTITION BY node, feature)),
s AS (SELECT *, {", ".join(f"r{x} + CASE WHEN default_left THEN m{x} ELSE 0 END AS l{x}" for x in "ghn")} FROM c, (VALUES (true), (false)) AS side(default_left) WHERE NOT lost AND (default_left OR mn > 0)),
e AS (SELECT *, lg::DOUBLE * lg / (lh + 1) + (tg - lg)::DOUBLE * (tg - lg) / (th - lh + 1) - tg::DOUBLE * tg / (th + 1) AS gain FROM s WHERE ln >= 20 AND tn - ln >= 20)
SELECT node, feature, bin, default_left, round(gain, 2) AS gain FROM e WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin, default_left DESC) = 1""")
def best_split_missing(spark, d):
    hist = histogram.histogram(_binned(spark, d), ["q", "d", "t"], node="node")
    return split.best(hist, split.SplitParams(), {1: 10, 2: 8}).select("node", "feature", "bin", "default_left", F.round("gain", 2).alias("gain"))


@query("best_split_cosine", f"""WITH hist AS ({_CELLS.format(node="(l_orderkey % 3)::INT")}),
c AS (SELECT *, sum(g) OVER w AS lg, sum(h) OVER w AS lh, sum(n) OVER w AS ln, sum(g) OVER p AS tg, sum(h) OVER p AS th, sum(n) OVER p AS tn FROM hist WINDOW w AS (PARTITION BY node, feature ORDER BY bin), p AS (PARTITION BY node, feature)),
o AS (SELECT *, -lg::DOUBLE / (lh + 1) AS lo, -(tg - lg)::DOUBLE / (th - lh + 1) AS ro, -tg::DOUBLE / (th + 1) AS wo FROM c WHERE ln >= 20 AND tn - ln >= 20),
s AS (SELECT *, (-lo * lg - ro * (tg - lg)) / sqrt(lo * lo * lh + ro * ro * (th - lh)) - (-wo * tg) / sqrt(wo * wo * th) AS gain FROM o)
SELECT node, feature, bin, round(gain, 2) AS gain, ln::BIGINT AS left_n FROM s WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin) = 1""")
def best_split_cosine(spark, d):
    return _best(spark, d, score="Cosine")


@query("best_split_categorical", f"""WITH hist AS ({_CELLS.format(node="(l_orderkey % 3)::INT")}), r AS (SELECT *, g / (h + 10.0::DOUBLE) AS ratio FROM hist),
c AS ({" UNION ALL ".join(f"SELECT node, feature, list(bin) OVER w AS l, sum(g) OVER w AS lg, sum(h) OVER w AS lh, sum(n) OVER w AS ln, sum(g) OVER p AS tg, sum(h) OVER p AS th, sum(n) OVER p AS tn FROM r WINDOW w AS (PARTITION BY node, feature ORDER BY ratio {o}, bin ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY node, feature)" for o in ("ASC", "DESC"))}),
s AS (SELECT node, feature, list_sort(l) AS "left", lg::DOUBLE * lg / (lh + 11) + (tg - lg)::DOUBLE * (tg - lg) / (th - lh + 11) - tg::DOUBLE * tg / (th + 1) AS gain FROM c WHERE len(l) <= 32 AND ln >= 20 AND tn - ln >= 20)
SELECT node, feature, "left", round(gain, 2) AS gain FROM s WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, "left"::VARCHAR) = 1""")
def best_split_categorical(spark, d):
    return split.best_categorical(histogram.histogram(_binned(spark, d), ["q", "d", "t"], node="node"), split.SplitParams()).select("node", "feature", "left", F.round("gain", 2).alias("gain"))


@query("oblivious_split", f"""WITH hist AS ({_CELLS.format(node='(l_orderkey % 3)::INT')}), f AS (SELECT DISTINCT feature, bin FROM hist), m AS (SELECT DISTINCT node FROM hist),
g AS (SELECT m.node, f.feature, f.bin, coalesce(g, 0) AS g, coalesce(h, 0) AS h FROM f CROSS JOIN m LEFT JOIN hist USING (node, feature, bin)),
c AS (SELECT *, sum(g) OVER w AS lg, sum(h) OVER w AS lh, sum(g) OVER p AS tg, sum(h) OVER p AS th FROM g WINDOW w AS (PARTITION BY node, feature ORDER BY bin), p AS (PARTITION BY node, feature))
SELECT feature, bin, round(sum(lg::DOUBLE * lg / (lh + 1) + (tg - lg)::DOUBLE * (tg - lg) / (th - lh + 1) - tg::DOUBLE * tg / (th + 1)), 2) AS gain FROM c GROUP BY 1, 2 ORDER BY gain DESC, feature, bin LIMIT 1""")
def oblivious_split(spark, d):
    return split.oblivious(histogram.histogram(_binned(spark, d), ["q", "d", "t"], node="node"), split.SplitParams()).select("feature", "bin", F.round("gain", 2).alias("gain"))


# --- training and prediction -------------------------------------------------------------------------------------


def training_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", *FEATURES, (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_returnflag") == "R").cast("int").alias("returned"))


def _params(**more) -> boost.Params:
    return boost.Params.of(**{"num_iterations": 3, "max_depth": 2, "num_leaves": 4, "grow_policy": "depthwise", "learning_rate": 0.3, **more})


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds of depth-two trees for the price of a line item; the root mean squared error before and after."""
    rows = training_rows(spark, d)
    model = boost.train(rows, FEATURES, "y", _params())
    out = model.predict(rows)
    error = lambda p: F.sqrt(F.avg((F.col("y") - p) * (F.col("y") - p)))
    return out.agg(r6(error(F.lit(model.base[0])), "rmse_before"), r6(error(F.col("prediction")), "rmse_after"), F.lit(len(model.trees)).alias("trees"))


_ROWS = "SELECT l_orderkey AS key, l_quantity AS f0, l_discount AS f1, l_tax AS f2, l_extendedprice / 1000 AS y, (l_returnflag = 'R')::INT AS returned FROM lineitem"
_MSE = lambda f, s: f"SELECT round(avg(pow(y - {f.raw(0, f.weights)}, 2)), 6) AS mse, {len(f.weights)} AS trees FROM {s}"

query("gbdt_3_rounds", Fit(_ROWS).sql(lambda f, s: f"SELECT round(sqrt(avg(pow(y - (SELECT base0 FROM start), 2))), 6) AS rmse_before, round(sqrt(avg(pow(y - {f.raw(0, f.weights)}, 2))), 6) AS rmse_after, 3 AS trees FROM {s}"))(flagship)


@query("tree_stump", """WITH r AS (SELECT l_quantity::INT AS q, (round(l_extendedprice)::BIGINT - 38000)::DOUBLE AS y FROM lineitem), c AS (SELECT q, sum(-y) AS g, count(*) AS n FROM r GROUP BY 1),
s AS (SELECT q, sum(g) OVER w AS lg, sum(n) OVER w AS ln, sum(g) OVER () AS tg, sum(n) OVER () AS tn FROM c WINDOW w AS (ORDER BY q)),
b AS (SELECT *, lg * lg / (ln + 1) + (tg - lg) * (tg - lg) / (tn - ln + 1) - tg * tg / (tn + 1) AS gain FROM s WHERE ln >= 20 AND tn - ln >= 20 ORDER BY gain DESC, q LIMIT 1)
SELECT 'left' AS side, ln::BIGINT AS n, round(-lg / (ln + 1), 6) AS value FROM b UNION ALL SELECT 'right', (tn - ln)::BIGINT, round(-(tg - lg) / (tn - ln + 1), 6) FROM b""")
def tree_stump(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("q"), (F.round("l_extendedprice").cast("long") - 38000).cast("double").alias("y"))
    bins = binning.Bins.fit(rows, ["q"])
    t = boost.grow(bins.transform(rows).withColumn("g", -F.col("y")).withColumn("h", F.lit(1.0)), ["q"], bins, boost.Params.of(max_depth=1))
    side = [("left", t[t[0]["left"]]), ("right", t[t[0]["right"]])]
    return spark.createDataFrame([(s, int(n["count"]), float(n["value"])) for s, n in side], "side string, n bigint, value double").select("side", "n", r6(F.col("value"), "value"))


_SIGMOID = lambda r: f"(1 / (1 + exp(-({r}))))"
_BINARY = lambda y, r: [(f"{_SIGMOID(r[0])} - returned", f"{_SIGMOID(r[0])} * (1 - {_SIGMOID(r[0])})")]
_FITS = {
    "gbdt_leafwise": Fit(_ROWS, policy="leafwise").sql(_MSE),
    "gbdt_oblivious": Fit(_ROWS, policy="oblivious").sql(_MSE),
    "gbdt_binary": Fit(_ROWS, base="ln(avg(returned) / (1 - avg(returned)))", grad=_BINARY).sql(lambda f, s: f"SELECT round(avg(pow(returned - {_SIGMOID(f.raw(0, f.weights))}, 2)), 6) AS mse, 3 AS trees FROM {s}"),
    "gbdt_poisson": Fit(_ROWS, base="ln(avg(y))", grad=lambda y, r: [(f"exp({r[0]}) - y", f"exp({r[0]} + 0.7)")]).sql(lambda f, s: f"SELECT round(avg(pow(y - exp({f.raw(0, f.weights)}), 2)), 6) AS mse, 3 AS trees FROM {s}"),
    "gbdt_dart": Fit(_ROWS, kind="dart", drop=0.5).sql(_MSE),
    "gbdt_random_forest": Fit(_ROWS, kind="rf", bag=0.7).sql(_MSE),
    "gbdt_bagged": Fit(_ROWS, bag=0.5, fraction=0.7).sql(_MSE),
}

for _kind, _more in {
    "gbdt_leafwise": {"grow_policy": "leafwise", "max_depth": -1},
    "gbdt_oblivious": {"grow_policy": "oblivious"},
    "gbdt_binary": {"objective": "binary"},
    "gbdt_poisson": {"objective": "poisson"},
    "gbdt_dart": {"boosting": "dart", "drop_rate": 0.5, "skip_drop": 0.0},
    "gbdt_random_forest": {"boosting": "rf", "bagging_fraction": 0.7, "bagging_freq": 1},
    "gbdt_goss": {"boosting": "goss", "learning_rate": 0.9},
    "gbdt_bagged": {"bagging_fraction": 0.5, "bagging_freq": 1, "feature_fraction": 0.7},
}.items():

    def _fit(spark, d, more=_more):
        rows = training_rows(spark, d)
        label = "returned" if more.get("objective") == "binary" else "y"
        model = boost.train(rows, FEATURES, label, _params(**more), key="l_orderkey")
        return model.predict(rows).agg(r6(F.avg((F.col(label) - F.col("prediction")) ** 2), "mse"), F.lit(len(model.trees)).alias("trees"))

    query(_kind, _FITS.get(_kind))(_fit)


def _softmax_sql(y, r):
    e = [f"exp({x} - greatest({', '.join(r)}))" for x in r]
    p = [f"({x} / ({' + '.join(e)}))" for x in e]
    return [(f"{x} - (k = {c})::INT", f"1.5 * {x} * (1 - {x})") for c, x in enumerate(p)]


_CLASSES = f"SELECT *, (y > 20)::INT + (y > 45)::INT AS k FROM ({_ROWS})"


def _wrong(f, s):
    raws = [f.raw(c, f.weights) for c in range(3)]
    return f"SELECT 'multi_error' AS metric, round(avg((list_position(r, list_max(r)) - 1 <> k)::INT), 6) AS value FROM (SELECT k, [{', '.join(raws)}] AS r FROM {s})"


@query("gbdt_multiclass", Fit(_CLASSES, outputs=3, rounds=2, base=[f"ln(avg((k = {c})::INT))" for c in range(3)], grad=_softmax_sql).sql(_wrong))
def gbdt_multiclass(spark, d):
    rows = training_rows(spark, d).withColumn("k", (F.col("y") > 20).cast("int") + (F.col("y") > 45).cast("int"))
    model = boost.train(rows, FEATURES, "k", _params(objective="multiclass", num_class=3, num_iterations=2))
    return metrics.multiclass(model.predict(rows), "multi_error", "k", "probabilities").withColumn("value", F.round("value", 6))


def _losses(f, s):
    each = " UNION ALL ".join(f"SELECT {i} AS iteration, avg(pow(y - {f.raw(0, f.weights[: i + 1])}, 2)) AS l FROM {s} WHERE fold = 0" for i in range(f.rounds))
    return f"""SELECT iteration::INT AS iteration, round(l, 6) AS loss FROM (SELECT *, max(stale) OVER (ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
  SELECT iteration, l, iteration - max(CASE WHEN l < coalesce(low, 1e300) THEN iteration END) OVER (ORDER BY iteration) AS stale FROM (SELECT *, min(l) OVER (ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM ({each})))) WHERE coalesce(before, 0) < 2"""


_FOLDED = f"SELECT *, floor({_U.format(seed=0, key='key')} * {{k}})::INT AS fold FROM ({_ROWS})"


@query("gbdt_early_stopping", Fit(_FOLDED.format(k=4), rounds=5, where="fold > 0").sql(_losses))
def gbdt_early_stopping(spark, d):
    rows = sampling.folds(training_rows(spark, d), "l_orderkey", 4)
    model = boost.train(rows.filter("fold > 0"), FEATURES, "y", _params(num_iterations=5, early_stopping_round=2), valid=rows.filter("fold = 0"))
    return spark.createDataFrame([(h["iteration"], float(h["loss"])) for h in model.history], "iteration int, loss double").select("iteration", r6(F.col("loss"), "loss"))


def _model(spark, d):
    rows = training_rows(spark, d)
    return rows, boost.train(rows, FEATURES, "y", _params())


@query("trees_table", Fit(_ROWS).sql(lambda f, s: f"SELECT tree_index::INT AS tree_index, node::INT AS node, depth::INT AS depth, f::INT AS feature, feature_name, b::INT AS bin, threshold, default_left, NULL::INT AS missing_bin, l::INT AS left_child, r::INT AS right_child, round(value, 6) + 0.0 AS value, round(gain, 3) AS gain, n::BIGINT AS n, weight::DOUBLE AS weight FROM ({f.nodes()})"))
def trees_table(spark, d):
    return inspect.node_table(spark, _model(spark, d)[1]).withColumn("value", F.round("value", 6) + 0.0).withColumn("gain", F.round("gain", 3))


@query("feature_importance", Fit(_ROWS).sql(lambda f, s: f"SELECT feature_name, count(*)::BIGINT AS importance FROM ({f.nodes()}) WHERE f IS NOT NULL GROUP BY 1"))
def feature_importance(spark, d):
    return inspect.importance(inspect.node_table(spark, _model(spark, d)[1]))


@query("leaf_index", Fit(_ROWS).sql(lambda f, s: f"SELECT [{', '.join(f'(SELECT count(*) FROM leaf{t} WHERE node < node{t})::INT' for t in range(3))}] AS leaf, sum(n)::BIGINT AS n FROM (SELECT node0, node1, node2, count(*) AS n FROM {s} GROUP BY ALL) GROUP BY 1"))
def leaf_index(spark, d):
    rows, model = _model(spark, d)
    return model.predict(rows, "leaf").groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))


@query("shap_efficiency", "SELECT 0.0::DOUBLE AS largest_gap, count(*)::BIGINT AS n FROM lineitem")  # contributions add up to the score
def shap_efficiency(spark, d):
    rows, model = _model(spark, d)
    total = F.aggregate("contributions", F.lit(0.0), lambda a, v: a + v)
    gap = F.abs(total - F.col("prediction"))
    return inspect.contributions(model.predict(rows, "raw"), model).agg(r6(F.max(gap), "largest_gap"), F.count(F.lit(1)).alias("n"))


def _refit(f, s):
    for t in range(3):
        raw = " + ".join(["(SELECT base0 FROM start)", *(f"0.3 * u{i}" for i in range(t))])
        f.add(f"fresh{t}", f"SELECT node{t} AS node, -sum({raw} - y) / (count(*) + 1) AS v FROM {s} GROUP BY 1")
        f.add(f"new{t}", f"SELECT node, 0.9 * leaf{t}.v + 0.1 * fresh{t}.v AS v FROM leaf{t} JOIN fresh{t} USING (node)")
        s = f.add(f"r{t}", f"SELECT x.*, n.v AS u{t} FROM {s} x JOIN new{t} n ON n.node = x.node{t}")
    return " UNION ALL ".join(f"SELECT {t}::INT AS tree_index, node::INT AS node, round(v, 6) + 0.0 AS value FROM new{t}" for t in range(3))


@query("refit_leaves", Fit(_ROWS).sql(_refit))
def refit_leaves(spark, d):
    rows, model = _model(spark, d)
    return inspect.node_table(spark, inspect.refit(model, rows, "y")).filter("feature IS NULL").select("tree_index", "node", r6(F.col("value"), "value"))


def _cv_sql() -> str:
    each = ", ".join(f"({Fit(_FOLDED.format(k=3), rounds=1, where=f'fold <> {i}').sql(lambda f, s, i=i: f'SELECT avg(pow(y - {f.raw(0, f.weights)}, 2)) AS l FROM {s} WHERE fold = {i}')}) AS t{i}(l{i})" for i in range(3))
    return f"SELECT round((l0 + l1 + l2) / 3, 6) AS mean, round(sqrt((l0 * l0 + l1 * l1 + l2 * l2) / 3 - pow((l0 + l1 + l2) / 3, 2)), 6) AS stdv FROM {each}"


@query("cv_mean_std", _cv_sql())
def cv_mean_std(spark, d):
    r = cv.cv(training_rows(spark, d), FEATURES, "y", "l_orderkey", _params(num_iterations=1), 3)
    return spark.createDataFrame([(float(r["mean"]), float(r["stdv"]))], "mean double, stdv double").select(r6(F.col("mean"), "mean"), r6(F.col("stdv"), "stdv"))


# --- metrics -----------------------------------------------------------------------------------------------------

_P = "(o_orderkey % 97 + 1) / 100.0::DOUBLE"
_Y = {"plain": "o_totalprice / 99991", "unit": "(o_totalprice > 150000)::INT", "soft": "least(1.0, o_totalprice / 600000)"}
_Q = f"({_P})"
_METRICS = {
    "l2": ("plain", "avg(pow(y - p, 2))"),
    "rmse": ("plain", "sqrt(avg(pow(y - p, 2)))"),
    "l1": ("plain", "avg(abs(y - p))"),
    "quantile": ("plain", "avg(CASE WHEN y >= p THEN 0.9 * (y - p) ELSE -0.1 * (y - p) END)"),
    "huber": ("plain", "avg(CASE WHEN abs(y - p) <= 0.9 THEN 0.5 * pow(y - p, 2) ELSE 0.9 * (abs(y - p) - 0.45) END)"),
    "fair": ("plain", "avg(abs(y - p) - ln(1 + abs(y - p)))"),
    "mape": ("plain", "avg(abs(y - p) / greatest(1.0, abs(y)))"),
    "poisson": ("plain", "avg(p - y * ln(p))"),
    "gamma": ("plain", "avg(y / p + ln(p))"),
    "gamma_deviance": ("plain", "2 * avg(ln(p / y) + y / p - 1)"),
    "tweedie": ("plain", "avg(2 * y / sqrt(p) + 2 * sqrt(p))"),
    "binary_logloss": ("unit", "-avg(y * ln(p) + (1 - y) * ln(1 - p))"),
    "cross_entropy": ("soft", "-avg(y * ln(p) + (1 - y) * ln(1 - p))"),
    "kldiv": ("soft", "avg(CASE WHEN y > 0 THEN y * ln(y / p) ELSE 0 END + CASE WHEN y < 1 THEN (1 - y) * ln((1 - y) / (1 - p)) ELSE 0 END)"),
    "binary_error": ("unit", "avg(((p >= 0.5)::INT <> y)::INT)"),
    "accuracy": ("unit", "avg(((p >= 0.5)::INT = y)::INT)"),
}


def _judged(spark, d, kind):
    o = table(spark, d, "orders")
    y = {"plain": F.col("o_totalprice") / 99991, "unit": (F.col("o_totalprice") > 150000).cast("int"), "soft": F.least(F.lit(1.0), F.col("o_totalprice") / 600000)}[kind]
    return o.select("o_orderkey", "o_custkey", y.alias("y"), ((F.col("o_orderkey") % 97 + 1) / 100.0).alias("p"))


for _name, (_kind, _sql) in _METRICS.items():

    def _metric(spark, d, name=_name, kind=_kind):
        return metrics.pointwise(_judged(spark, d, kind), name, "y", "p").select("metric", r6(F.col("value"), "value"))

    query(f"metric_{_name}", f"SELECT '{_name}' AS metric, round(({_sql})::DOUBLE, 6) AS value FROM (SELECT {_Y[_kind]} AS y, {_P} AS p FROM orders)")(_metric)

_BLOCKS = f"b AS (SELECT {_P} AS s, sum((o_totalprice > 150000)::INT) AS pos, sum((o_totalprice <= 150000)::INT) AS neg FROM orders GROUP BY 1), r AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS cp, sum(neg) OVER (ORDER BY s DESC) AS cn FROM b)"


@query("metric_auc", f"WITH {_BLOCKS} SELECT 'auc' AS metric, round((sum(neg * (cp - pos / 2.0)) / (sum(pos) * sum(neg)))::DOUBLE, 6) AS value FROM r")
def metric_auc(spark, d):
    return metrics.auc(_judged(spark, d, "unit"), "y", "p").select("metric", r6(F.col("value"), "value"))


@query("metric_average_precision", f"WITH {_BLOCKS} SELECT 'average_precision' AS metric, round((sum(pos * cp / (cp + cn)) / sum(pos))::DOUBLE, 6) AS value FROM r")
def metric_average_precision(spark, d):
    return metrics.average_precision(_judged(spark, d, "unit"), "y", "p").select("metric", r6(F.col("value"), "value"))


@query("metric_multi_logloss", "SELECT 'multi_logloss' AS metric, round((-avg(ln(CASE o_orderkey % 3 WHEN 0 THEN e0 WHEN 1 THEN e1 ELSE e2 END / (e0 + e1 + e2))))::DOUBLE, 6) AS value FROM (SELECT o_orderkey, exp(o_totalprice / 99991) AS e0, exp(0.5::DOUBLE) AS e1, exp((o_orderkey % 7) / 4.0::DOUBLE) AS e2 FROM orders)")
def metric_multi_logloss(spark, d):
    rows = _scored(spark, d).withColumn("k", F.col("o_orderkey") % 3).withColumn("q", F.array(*O.softmax([F.col("y"), F.lit(0.5), F.col("r")])))
    return metrics.multiclass(rows, "multi_logloss", "k", "q").select("metric", r6(F.col("value"), "value"))


_RANK = "r AS (SELECT o_custkey AS q, o_orderkey % 5 AS l, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 5 DESC, o_orderkey) AS i FROM orders)"


def _ranked(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", (F.col("o_orderkey") % 5).alias("l"))


@query("metric_ndcg", f"WITH {_RANK}, g AS (SELECT q, sum(CASE WHEN k <= 10 THEN (pow(2, l) - 1) / log2(k + 1) ELSE 0 END) AS a, sum(CASE WHEN i <= 10 THEN (pow(2, l) - 1) / log2(i + 1) ELSE 0 END) AS b FROM r GROUP BY 1) SELECT 'ndcg@10' AS metric, round(avg(CASE WHEN b > 0 THEN a / b ELSE 1 END), 6) AS value FROM g")
def metric_ndcg(spark, d):
    return metrics.ndcg(_ranked(spark, d), "o_custkey", "l", "o_totalprice", "o_orderkey").select("metric", r6(F.col("value"), "value"))


@query("metric_map", f"WITH {_RANK}, h AS (SELECT *, sum((l > 0)::INT) OVER (PARTITION BY q ORDER BY k) AS hits FROM r), g AS (SELECT q, sum(CASE WHEN l > 0 AND k <= 10 THEN hits / k ELSE 0 END) AS s, sum((l > 0)::INT) AS m FROM h GROUP BY 1) SELECT 'map@10' AS metric, round(avg(CASE WHEN m > 0 THEN s / least(10, m) ELSE 1 END)::DOUBLE, 6) AS value FROM g")
def metric_map(spark, d):
    return metrics.mean_average_precision(_ranked(spark, d), "o_custkey", "l", "o_totalprice", "o_orderkey").select("metric", r6(F.col("value"), "value"))


@query("metric_pfound", f"WITH {_RANK}, p AS (SELECT q, l / 5 * pow(0.85, k - 1) * exp(coalesce(sum(ln(1 - l / 5)) OVER (PARTITION BY q ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS p FROM r), s AS (SELECT sum(p) AS p FROM p GROUP BY q) SELECT 'pfound' AS metric, round(avg(p), 6) AS value FROM s")
def metric_pfound(spark, d):
    return metrics.pfound(_ranked(spark, d).withColumn("l", F.col("l") / 5), "o_custkey", "l", "o_totalprice", "o_orderkey").select("metric", r6(F.col("value"), "value"))


@query("cox_loglik", "WITH t AS (SELECT o_orderkey % 50 AS t, exp((o_orderkey % 7) / 4.0::DOUBLE) AS e, (o_orderkey % 7) / 4.0::DOUBLE AS r, (o_orderkey % 4 > 0)::INT AS d FROM orders), g AS (SELECT t, sum(e) AS e, sum(r * d) AS s, sum(d) AS d FROM t GROUP BY 1), k AS (SELECT *, sum(e) OVER (ORDER BY t DESC) AS risk FROM g) SELECT 'cox' AS metric, round(sum(s - d * ln(risk)), 3) AS value FROM k")
def cox_loglik(spark, d):
    rows = _scored(spark, d).withColumn("t", F.col("o_orderkey") % 50).withColumn("e", (F.col("o_orderkey") % 4 > 0).cast("int"))
    return metrics.cox_partial_loglik(rows, "t", "e", "r").select("metric", F.round("value", 3).alias("value"))


# --- ranking and survival ----------------------------------------------------------------------------------------


@query("query_groups", "SELECT l_orderkey, n::BIGINT AS n, coalesce(sum(n) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)")
def query_groups(spark, d):
    return ranking.groups(table(spark, d, "lineitem"), "l_orderkey").select("l_orderkey", "n", F.col("start").cast("long").alias("start"))


@query("query_rmse_grad", "SELECT o_orderkey, round(r - y - avg(r - y) OVER (PARTITION BY o_custkey), 6) + 0.0 AS grad FROM (SELECT o_orderkey, o_custkey, (o_orderkey % 7) / 4.0::DOUBLE AS r, o_totalprice / 99991 AS y FROM orders)")
def query_rmse_grad(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 7 / 4.0).alias("r"), (F.col("o_totalprice") / 99991).alias("y"))
    return ranking.query_rmse(rows, "o_custkey", "y", "r").select("o_orderkey", r6(F.col("grad"), "grad"))


_PAIR = "r AS (SELECT o_orderkey AS k, o_custkey AS q, o_orderkey % 5 AS l, (o_orderkey % 7) / 4.0::DOUBLE AS s FROM orders), p AS (SELECT a.k AS w, b.k AS x, 1 / (1 + exp(a.s - b.s)) AS rho FROM r a JOIN r b ON a.q = b.q AND a.l > b.l), e AS (SELECT w AS k, -rho AS g, rho * (1 - rho) AS h FROM p UNION ALL SELECT x, rho, rho * (1 - rho) FROM p)"


@query("pair_logit_grad", f"WITH {_PAIR} SELECT o_orderkey, round(coalesce(sum(g), 0), 6) + 0.0 AS grad, round(coalesce(sum(h), 0), 6) + 0.0 AS hess FROM orders LEFT JOIN e ON k = o_orderkey GROUP BY 1")
def pair_logit_grad(spark, d):
    rows = _ranked(spark, d).withColumn("s", F.col("o_orderkey") % 7 / 4.0)
    return ranking.pair_logit(rows, "o_custkey", "l", "s", "o_orderkey").select("o_orderkey", r6(F.col("grad"), "grad"), r6(F.col("hess"), "hess"))


@query("lambdarank_grad", """WITH r AS (SELECT o_orderkey AS k, o_custkey AS q, o_orderkey % 5 AS l, (o_orderkey % 7) / 4.0::DOUBLE AS s, pow(2, o_orderkey % 5) - 1 AS gain FROM orders),
i AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, k) AS rank, row_number() OVER (PARTITION BY q ORDER BY l DESC, k) AS ideal, max(s) OVER (PARTITION BY q) AS top, min(s) OVER (PARTITION BY q) AS low FROM r),
m AS (SELECT *, sum(CASE WHEN ideal <= 30 THEN gain / log2(ideal + 1) ELSE 0 END) OVER (PARTITION BY q) AS most FROM i),
p AS (SELECT a.q, a.k AS w, b.k AS x, 1 / (1 + exp(a.s - b.s)) AS rho, (a.gain - b.gain) * abs(1 / log2(a.rank + 1) - 1 / log2(b.rank + 1)) / a.most / CASE WHEN a.top <> a.low THEN 0.01 + abs(a.s - b.s) ELSE 1 END AS delta
  FROM m a JOIN m b ON a.q = b.q AND a.l > b.l WHERE least(a.rank, b.rank) <= 30 AND a.most > 0),
e AS (SELECT q, w AS k, -rho * delta AS g, rho * (1 - rho) * delta AS h, 2 * rho * delta AS t FROM p UNION ALL SELECT q, x, rho * delta, rho * (1 - rho) * delta, 0 FROM p),
z AS (SELECT q, k, sum(g) AS g, sum(h) AS h, sum(sum(t)) OVER (PARTITION BY q) AS t FROM e GROUP BY q, k)
SELECT o_orderkey, round(coalesce(g * CASE WHEN t > 0 THEN log2(1 + t) / t ELSE 1 END, 0), 6) + 0.0 AS grad, round(coalesce(h * CASE WHEN t > 0 THEN log2(1 + t) / t ELSE 1 END, 0), 6) + 0.0 AS hess FROM orders LEFT JOIN z ON k = o_orderkey""")
def lambdarank_grad(spark, d):
    rows = _ranked(spark, d).withColumn("s", F.col("o_orderkey") % 7 / 4.0)
    return ranking.lambdarank(rows, "o_custkey", "l", "s", "o_orderkey").select("o_orderkey", r6(F.col("grad"), "grad"), r6(F.col("hess"), "hess"))


@query("cox_grad", "WITH r AS (SELECT o_orderkey AS k, o_orderkey % 50 AS t, exp((o_orderkey % 7) / 4.0::DOUBLE) AS e, (o_orderkey % 4 > 0)::INT AS d FROM orders), g AS (SELECT t, sum(e) AS e, sum(d) AS d FROM r GROUP BY 1), s AS (SELECT t, d, sum(e) OVER (ORDER BY t DESC) AS risk FROM g), c AS (SELECT t, sum(d / risk) OVER (ORDER BY t) AS rk, sum(d / (risk * risk)) OVER (ORDER BY t) AS sk FROM s) SELECT k AS o_orderkey, round(r.e * rk - r.d, 6) + 0.0 AS grad, round(r.e * rk - r.e * r.e * sk, 6) + 0.0 AS hess FROM r JOIN c USING (t)")
def cox_grad(spark, d):
    rows = _scored(spark, d).withColumn("t", F.col("o_orderkey") % 50).withColumn("e", (F.col("o_orderkey") % 4 > 0).cast("int"))
    return ranking.cox(rows, "t", "e", "r", "o_orderkey").select("o_orderkey", r6(F.col("grad"), "grad"), r6(F.col("hess"), "hess"))


@query("aft_logistic_grad", """WITH r AS (SELECT o_orderkey AS k, o_orderkey % 3 AS c, o_totalprice / 99991 + 0.1 AS lo, (o_orderkey % 7) / 4.0::DOUBLE AS r FROM orders),
z AS (SELECT *, 1 / (1 + exp(-(ln(lo) - r))) AS fl, CASE WHEN c = 1 THEN 1 / (1 + exp(-(ln(lo + 2) - r))) ELSE 1.0 END AS fu FROM r),
d AS (SELECT *, fl * (1 - fl) AS dl, CASE WHEN c = 1 THEN fu * (1 - fu) ELSE 0.0 END AS du, greatest(fu - fl, 1e-12) AS w FROM z)
SELECT k AS o_orderkey, round(greatest(-15, least(15, CASE WHEN c = 0 THEN 1 - 2 * fl ELSE (du - dl) / w END)), 6) + 0.0 AS grad,
  round(greatest(1e-16, least(15, CASE WHEN c = 0 THEN pow(1 - 2 * fl, 2) - (1 - 6 * dl) ELSE pow((du - dl) / w, 2) - (du * (1 - 2 * fu) - dl * (1 - 2 * fl)) / w END)), 6) + 0.0 AS hess FROM d""")
def aft_logistic_grad(spark, d):
    lower = F.col("y") + 0.1
    upper = F.when(F.col("o_orderkey") % 3 == 0, lower).when(F.col("o_orderkey") % 3 == 1, lower + 2).otherwise(-1.0)
    rows = O.aft(_scored(spark, d).withColumn("lo", lower).withColumn("up", upper), "lo", "up", "r")
    return rows.select("o_orderkey", r6(F.col("grad"), "grad"), r6(F.col("hess"), "hess"))


# --- target statistics, text, embeddings -------------------------------------------------------------------------


@query("ctr_ordered", "SELECT o_orderkey, floor(ctr * 15)::INT AS ctr_bucket FROM (SELECT o_orderkey, ((coalesce(sum((o_orderstatus = 'F')::INT) OVER w, 0) + 0.5) / (count(*) OVER w + 1))::FLOAT AS ctr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
def ctr_ordered(spark, d):
    rows = table(spark, d, "orders").withColumn("t", (F.col("o_orderstatus") == "F").cast("int"))
    return features.ordered_ctr(rows, "o_custkey", "t", "o_orderkey").select("o_orderkey", "ctr_bucket")


@query("ctr_counter", "SELECT o_orderpriority AS category, count(*)::BIGINT AS n, round(count(*) / (max(count(*)) OVER () + 1), 6) AS ctr FROM orders GROUP BY 1")
def ctr_counter(spark, d):
    return features.counter_ctr(table(spark, d, "orders"), "o_orderpriority").select("category", "n", r6(F.col("ctr"), "ctr"))


@query("ctr_final_predict", "SELECT c_custkey, round(coalesce(ctr, 0.5), 6) AS ctr FROM customer LEFT JOIN (SELECT o_custkey, (sum((o_orderstatus = 'F')::INT) + 0.5) / (count(*) + 1) AS ctr FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def ctr_final_predict(spark, d):
    rows = table(spark, d, "orders").withColumn("t", (F.col("o_orderstatus") == "F").cast("int"))
    return features.apply_ctr(table(spark, d, "customer"), features.ctr_table(rows, "o_custkey", "t"), "c_custkey").select("c_custkey", r6(F.col("ctr"), "ctr"))


@query("ctr_combination", "SELECT o_orderpriority || chr(1) || o_orderstatus AS category, sum((o_totalprice > 150000)::INT)::BIGINT AS good, count(*)::BIGINT AS total, round((sum((o_totalprice > 150000)::INT) + 0.5) / (count(*) + 1), 6) AS ctr FROM orders GROUP BY 1")
def ctr_combination(spark, d):
    rows = table(spark, d, "orders").withColumn("c", features.combination(["o_orderpriority", "o_orderstatus"])).withColumn("t", (F.col("o_totalprice") > 150000).cast("long"))
    return features.ctr_table(rows, "c", "t").select("category", "good", "total", r6(F.col("ctr"), "ctr"))


_TOKENS = "(SELECT doc_id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS token FROM documents)"
_DICTIONARY = f"(SELECT token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS token_id FROM {_TOKENS} GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, token LIMIT 50000)"


@query("text_dictionary", f"SELECT token, n::BIGINT AS n, token_id::INT AS token_id FROM {_DICTIONARY}")
def text_dictionary(spark, d):
    return features.dictionary(table(spark, d, "documents"), "text")


@query("text_tokens", f"SELECT doc_id, count(*)::BIGINT AS n, count(DISTINCT token)::BIGINT AS distinct_n FROM {_TOKENS} GROUP BY 1")
def text_tokens(spark, d):
    words = features.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", words.alias("w")).filter(F.size("w") > 0).select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("distinct_n"))


@query("text_bow", f"SELECT doc_id, token_id::INT AS token_id, count(*)::BIGINT AS n FROM {_TOKENS} JOIN {_DICTIONARY} USING (token) GROUP BY 1, 2")
def text_bow(spark, d):
    docs = table(spark, d, "documents")
    return features.bag(docs, "doc_id", "text", features.dictionary(docs, "text"))


@query("text_bigrams", f"SELECT doc_id, greatest(count(*) - 1, 0)::BIGINT AS n FROM {_TOKENS} GROUP BY 1")
def text_bigrams(spark, d):
    words = features.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", words.alias("w")).filter(F.size("w") > 0).select("doc_id", F.size(features.ngrams(F.col("w"), 2)).cast("long").alias("n"))


_BAG50 = "bag AS (SELECT doc_id, token, count(*) AS n FROM {t} SEMI JOIN (SELECT token FROM {t} GROUP BY 1 HAVING count(*) >= 50) USING (token) GROUP BY 1, 2)".format(t=_TOKENS)


def _bags(spark, d):
    """Written once, as every step of the scores reads it."""
    docs = table(spark, d, "documents")
    return cut(features.bag(docs, "doc_id", "text", features.dictionary(docs, "text", 50, None)))


@query("naive_bayes_apply", f"""WITH {_BAG50}, per AS (SELECT toxic, token, sum(n) AS c FROM bag JOIN labels USING (doc_id) GROUP BY 1, 2), whole AS (SELECT toxic, sum(c) AS total FROM per GROUP BY 1),
cls AS (SELECT toxic, total, d, (SELECT count(*) FROM labels) AS a, (SELECT count(DISTINCT token) FROM bag) AS v FROM whole JOIN (SELECT toxic, count(*) AS d FROM labels GROUP BY 1) USING (toxic))
SELECT doc_id, cls.toxic, round(sum(n * ln((coalesce(c, 0) + 0.5) / (total + 0.5 * v))) + any_value(ln(d / a)), 6) + 0.0 AS log_prob FROM bag CROSS JOIN cls LEFT JOIN per ON per.toxic = cls.toxic AND per.token = bag.token GROUP BY 1, 2""")
def naive_bayes_apply(spark, d):
    return features.naive_bayes(_bags(spark, d), table(spark, d, "labels"), "doc_id", "toxic").select("doc_id", "toxic", r6(F.col("log_prob"), "log_prob"))


@query("bm25_apply", f"""WITH {_BAG50}, tf AS (SELECT toxic, token, sum(n) AS tf FROM bag JOIN labels USING (doc_id) GROUP BY 1, 2), size AS (SELECT toxic, sum(tf) AS len FROM tf GROUP BY 1),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), w AS (SELECT toxic, token, greatest(1e-3, ln(((SELECT count(*) FROM size) - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len) FROM size))) AS w FROM tf JOIN size USING (toxic) JOIN df USING (token))
SELECT doc_id, toxic, round(sum(w), 6) + 0.0 AS score FROM bag JOIN w USING (token) GROUP BY 1, 2""")
def bm25_apply(spark, d):
    return features.bm25(_bags(spark, d), table(spark, d, "labels"), "doc_id", "toxic").select("doc_id", "toxic", r6(F.col("score"), "score"))


@query("class_means", "SELECT label, (pos - 1)::INT AS pos, round(avg(v::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2")
def class_means(spark, d):
    rows = table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return features.class_means(rows, "embedding", "label").select("label", "pos", r6(F.col("mean"), "mean"))


@query("knn_features", "SELECT vec_id, label, count(*)::BIGINT AS n FROM (SELECT a.vec_id, b.label FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) <= 5) GROUP BY 1, 2")
def knn_features(spark, d):
    return features.knn(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


# --- ingest ------------------------------------------------------------------------------------------------------


@query("gaps_islands_ranges", "SELECT user_id, min(event_id)::BIGINT AS first_id, max(event_id)::BIGINT AS last_id, count(*)::BIGINT AS n FROM (SELECT user_id, event_id, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) GROUP BY user_id, g")
def gaps_islands_ranges(spark, d):
    from pyspark.sql.window import Window as W

    e = table(spark, d, "events").select("user_id", "event_id").withColumn("g", F.col("event_id") - F.row_number().over(W.partitionBy("user_id").orderBy("event_id")))
    return e.groupBy("user_id", "g").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count(F.lit(1)).alias("n")).drop("g")


@query("uniform_draws", f"SELECT o_orderkey, round({_U.format(seed=1, key='o_orderkey')}, 9) AS u FROM orders")
def uniform_draws(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(uniform(F.col("o_orderkey"), 1), 9).alias("u"))


# --- counter draws, folds ----------------------------------------------------------------------------------------

_MIXED = "(SELECT *, xor(z2, z2 >> 31) AS mixed FROM (SELECT *, (xor(z1, z1 >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS z2 FROM (SELECT *, (xor(z0, z0 >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS z1 FROM (SELECT *, (({state})::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z0 FROM {table}))))".replace("(({state})", "((({state})")


@query("splitmix_draws", f"SELECT o_orderkey, (mixed >> 32)::BIGINT AS high, (mixed & 4294967295)::BIGINT AS low FROM {_MIXED.format(state='o_orderkey', table='orders')}")
def splitmix_draws(spark, d):
    z = splitmix64(F.col("o_orderkey"))
    return table(spark, d, "orders").withColumn("z", z).select("o_orderkey", F.shiftrightunsigned("z", 32).alias("high"), F.col("z").bitwiseAND(0xFFFFFFFF).alias("low"))


@query("bagging_counter", f"SELECT o_orderkey FROM {_MIXED.format(state=f'{bag_stream(3, 2)}::UHUGEINT + o_orderkey::UHUGEINT', table='orders')} WHERE (mixed >> 11) / 9007199254740992.0::DOUBLE < 0.3")
def bagging_counter(spark, d):
    return sampling.counter_bag(table(spark, d, "orders"), "o_orderkey", 0.3, 3, 2).select("o_orderkey")


@query("stratified_folds", f"SELECT o_orderstatus, fold::INT AS fold, count(*)::BIGINT AS n FROM (SELECT o_orderstatus, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_U.format(seed=0, key='o_orderkey')}, o_orderkey) - 1) % 5 AS fold FROM orders) GROUP BY 1, 2")
def stratified_folds(spark, d):
    return sampling.stratified_folds(table(spark, d, "orders"), "o_orderkey", "o_orderstatus").groupBy("o_orderstatus", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("langevin_noise", f"SELECT o_orderkey, round(1.0 + sqrt(2.0 / 0.1 / 100.0) * sqrt(-2 * ln(1 - {_U.format(seed=14, key="(o_orderkey || ':g')")})) * cos(6.283185307179586 * {_U.format(seed=15, key="(o_orderkey || ':g')")}), 6) + 0.0 AS g FROM orders")
def langevin_noise(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.lit(1.0).alias("g"))
    return sampling.langevin(rows, "o_orderkey", ["g"], 0.1, 100.0, 7).select("o_orderkey", r6(F.col("g"), "g"))


# --- percentiles, leaf renewal, forced splits, categories --------------------------------------------------------


@query("weighted_percentiles", f"SELECT k AS o_orderstatus, round(value, 6) AS value FROM ({_percentile_sql('SELECT o_orderstatus, o_totalprice / 1000 AS v, (o_orderkey % 3)::DOUBLE AS w FROM orders', 0.3, 'o_orderstatus')})")
def weighted_percentiles(spark, d):
    o = table(spark, d, "orders")
    return ranges.percentile(o, F.col("o_totalprice") / 1000, 0.3, F.col("o_orderkey") % 3, ["o_orderstatus"]).select("o_orderstatus", r6(F.col("value"), "value"))


def _renewed(f, s):
    """The leaves' medians of what the start leaves."""
    return f"SELECT node0::INT AS node, round(quantile_cont(y - (SELECT base0 FROM start), 0.5), 6) + 0.0 AS value, count(*)::BIGINT AS n FROM {s} GROUP BY 1"


@query("gbdt_l1_leaves", Fit(_ROWS, rounds=1, base="quantile_cont(y, 0.5)", grad=lambda y, r: [(f"sign({r[0]} - y)", "1.0")]).sql(_renewed))
def gbdt_l1_leaves(spark, d):
    rows = training_rows(spark, d)
    model = boost.train(rows, FEATURES, "y", _params(objective="l1", num_iterations=1))
    return inspect.node_table(spark, model).filter("feature IS NULL").select("node", r6(F.col("value"), "value"), "n")


@query("gbdt_forced_root", "WITH r AS (SELECT l_quantity <= 20.5 AS l, l_extendedprice / 1000 - (SELECT avg(l_extendedprice / 1000) FROM lineitem) AS y FROM lineitem) SELECT CASE WHEN l THEN 1 ELSE 2 END::INT AS node, round(sum(y) / (count(*) + 1), 6) + 0.0 AS value, count(*)::BIGINT AS n FROM r GROUP BY 1")
def gbdt_forced_root(spark, d):
    rows = training_rows(spark, d)
    model = boost.train(rows, FEATURES, "y", _params(num_iterations=1, max_depth=1, forced={"feature": "l_quantity", "threshold": 20.5}))
    return inspect.node_table(spark, model).filter("feature IS NULL").select("node", r6(F.col("value"), "value"), "n")


@query("leaf_estimation", Fit(_ROWS, rounds=1, base="ln(avg(returned) / (1 - avg(returned)))", grad=_BINARY).sql(
    lambda f, s: f"SELECT node0::INT AS node, round(any_value(v0) - sum({_SIGMOID('(SELECT base0 FROM start) + v0')} - returned) / (sum({_SIGMOID('(SELECT base0 FROM start) + v0')} * (1 - {_SIGMOID('(SELECT base0 FROM start) + v0')})) + 1), 6) + 0.0 AS value FROM {s} GROUP BY 1"))
def leaf_estimation(spark, d):
    model = boost.train(training_rows(spark, d), FEATURES, "returned", _params(objective="binary", num_iterations=1, leaf_estimation_iterations=2))
    return inspect.node_table(spark, model).filter("feature IS NULL").select("node", r6(F.col("value"), "value"))


@query("bin_occupancy", "SELECT 'l_discount' AS feature, bin::INT AS bin, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM (SELECT dense_rank() OVER (ORDER BY l_discount) - 1 AS bin FROM lineitem) GROUP BY 2")
def bin_occupancy(spark, d):
    li = table(spark, d, "lineitem")
    return binning.occupancy(binning.Bins.fit(li, ["l_discount"]).transform(li), ["l_discount"]).select("feature", "bin", "n", r6(F.col("share"), "share"))


# --- target statistics of several classes ------------------------------------------------------------------------

_CLS = "SELECT o_orderkey, o_custkey, (o_totalprice > 80000)::INT + (o_totalprice > 160000)::INT + (o_totalprice > 240000)::INT AS c FROM orders"
_PAST = "WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _classed(spark, d):
    return table(spark, d, "orders").withColumn("c", features.target_classes(F.col("o_totalprice"), [80000.0, 160000.0, 240000.0]))


@query("target_classes", f"SELECT o_orderkey, c::INT AS c FROM ({_CLS})")
def target_classes(spark, d):
    return _classed(spark, d).select("o_orderkey", F.col("c").cast("int").alias("c"))


for _kind, _test in (("Buckets", "c = 1"), ("Borders", "c > 1")):

    def _ctr(spark, d, kind=_kind):
        return features.ordered_ctr_classes(_classed(spark, d), "o_custkey", "c", "o_orderkey", 1, kind).select("o_orderkey", "ctr_bucket")

    query(f"ctr_classes_{_kind.lower()}", f"SELECT o_orderkey, floor((((coalesce(sum(({_test})::INT) OVER w, 0)::FLOAT + 0.5::FLOAT) / (count(*) OVER w + 1)::FLOAT)::FLOAT * 15::FLOAT)::FLOAT)::INT AS ctr_bucket FROM ({_CLS}) {_PAST}")(_ctr)


@query("ctr_mean", f"SELECT o_orderkey, floor((((coalesce(sum(c / 3) OVER w, 0)::FLOAT + 0.5::FLOAT) / (count(*) OVER w + 1)::FLOAT)::FLOAT * 15::FLOAT)::FLOAT)::INT AS ctr_bucket FROM ({_CLS}) {_PAST}")
def ctr_mean(spark, d):
    return features.ordered_ctr_mean(_classed(spark, d), "o_custkey", "c", "o_orderkey", 4).select("o_orderkey", "ctr_bucket")


@query("ctr_permutation", f"SELECT o_orderkey, row_number() OVER (ORDER BY {_U.format(seed=5000017, key='(o_orderkey // 64)')}, o_orderkey) AS place FROM orders")
def ctr_permutation(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", features.permutation(F.col("o_orderkey"), 64, 5, 2).alias("p"))
    return ranges.running(ranges.place(o, ["p"]), {"before": F.lit(1)}, [], ["p"]).select("o_orderkey", (F.col("before") + 1).alias("place"))


# --- query groups, ranking ---------------------------------------------------------------------------------------


@query("group_audit", """WITH r AS (SELECT o_custkey AS q, o_orderkey % 5 AS l, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
p AS (SELECT a.q, count(*) AS pairs FROM r a JOIN r b ON a.q = b.q AND a.i < b.i AND a.l <> b.l WHERE a.i <= 30 GROUP BY 1),
g AS (SELECT q, count(*) AS n, min(l) AS low, max(l) AS high FROM r GROUP BY 1), t AS (SELECT g.*, coalesce(pairs, 0) AS pairs FROM g LEFT JOIN p USING (q))
SELECT count(*)::BIGINT AS n_queries, sum(n)::BIGINT AS n_rows, min(n)::BIGINT AS min_size, max(n)::BIGINT AS max_size, sum((n = 1)::INT)::BIGINT AS n_single, sum((high = 0)::INT)::BIGINT AS n_zero, sum((low = high)::INT)::BIGINT AS n_tied,
  sum((pairs > 0 AND high > 0)::INT)::BIGINT AS n_pairable, sum(CASE WHEN pairs > 0 AND high > 0 THEN pairs ELSE 0 END)::BIGINT AS n_pairs FROM t""")
def group_audit(spark, d):
    return groups.audit(_ranked(spark, d), "o_custkey", "l", "o_orderkey")


@query("group_prune", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING min(o_orderkey % 5) < max(o_orderkey % 5))")
def group_prune(spark, d):
    return groups.prune(_ranked(spark, d), "o_custkey", "l").select("o_orderkey")


@query("group_runs", "SELECT l_orderkey, count(*)::BIGINT AS n, (min(i) - 1)::BIGINT AS start FROM (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem) GROUP BY 1")
def group_runs(spark, d):
    at = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return groups.from_ids(table(spark, d, "lineitem").withColumn("at", at), "l_orderkey", "at")


@query("position_codes", "SELECT position, (row_number() OVER (ORDER BY position) - 1)::INT AS code FROM (SELECT DISTINCT l_linenumber AS position FROM lineitem)")
def position_codes(spark, d):
    return groups.position_codes(table(spark, d, "lineitem"), "l_linenumber")


@query("ndcg_by_query", "WITH r AS (SELECT o_custkey AS q, o_orderkey % 5 AS l, [0, 1, 3, 5, 6][o_orderkey % 5 + 1] AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY [0, 1, 3, 5, 6][o_orderkey % 5 + 1] DESC, o_orderkey) AS i FROM orders), s AS (SELECT q, sum(CASE WHEN k <= 5 THEN g / log2(k + 1) ELSE 0 END) AS a, sum(CASE WHEN i <= 5 THEN g / log2(i + 1) ELSE 0 END) AS b FROM r GROUP BY 1) SELECT q AS o_custkey, round(CASE WHEN b > 0 THEN a / b ELSE 1 END, 6) AS value FROM s")
def ndcg_by_query(spark, d):
    return metrics.ndcg_queries(_ranked(spark, d), "o_custkey", "l", "o_totalprice", "o_orderkey", 5, [0, 1, 3, 5, 6]).select("o_custkey", r6(F.col("value"), "value"))


@query("yetirank_grad", f"""WITH r AS (SELECT o_orderkey AS k, o_custkey AS q, (o_orderkey % 5)::DOUBLE AS l, (o_orderkey % 7) / 4.0::DOUBLE AS s FROM orders),
n AS (SELECT q, k, l, p, s + ln(greatest(u, 1e-300)) - ln(1.000001 - u) AS z FROM (SELECT *, {_U.format(seed=9, key="(k || ':' || p)")} AS u FROM r, range(7) AS t(p))),
o AS (SELECT *, row_number() OVER w AS pos, lead(k) OVER w AS k2, lead(l) OVER w AS l2 FROM n WINDOW w AS (PARTITION BY q, p ORDER BY z DESC, k)),
c AS (SELECT CASE WHEN l > l2 THEN k ELSE k2 END AS win, CASE WHEN l > l2 THEN k2 ELSE k END AS lose, sum(0.15 * pow(0.93, pos - 1) * abs(l - l2)) / 7 AS w FROM o WHERE l2 IS NOT NULL AND l <> l2 GROUP BY 1, 2),
e AS (SELECT win, lose, w, 1 / (1 + exp(a.s - b.s)) AS rho FROM c JOIN r a ON a.k = win JOIN r b ON b.k = lose),
g AS (SELECT win AS k, -w * rho AS g, w * rho * (1 - rho) AS h FROM e UNION ALL SELECT lose, w * rho, w * rho * (1 - rho) FROM e)
SELECT o_orderkey, round(coalesce(sum(g), 0), 4) + 0.0 AS grad, round(coalesce(sum(h), 0), 4) + 0.0 AS hess FROM orders LEFT JOIN g ON k = o_orderkey GROUP BY 1""")
def yetirank_grad(spark, d):
    rows = _ranked(spark, d).withColumn("s", F.col("o_orderkey") % 7 / 4.0)
    return ranking.yetirank(rows, "o_custkey", "l", "s", "o_orderkey", 7, 0.93, 9).select("o_orderkey", (F.round("grad", 4) + 0.0).alias("grad"), (F.round("hess", 4) + 0.0).alias("hess"))


@query("aft_distance", "SELECT o_orderkey, round(CASE WHEN t <= lo OR (hi >= 0 AND t >= hi) THEN least(abs(t - lo), CASE WHEN hi >= 0 THEN abs(t - hi) ELSE 1e300 END) ELSE 0 END, 6) + 0.0 AS distance FROM (SELECT o_orderkey, exp((o_orderkey % 7) / 4.0::DOUBLE) AS t, o_totalprice / 99991 AS lo, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 99991 + 1 ELSE -1 END AS hi FROM orders)")
def aft_distance(spark, d):
    far = O.aft_distance(F.col("y"), F.when(F.col("o_orderkey") % 2 == 0, F.col("y") + 1).otherwise(-1.0), F.col("r"))
    return _scored(spark, d).select("o_orderkey", r6(far, "distance"))


# --- sparse data, bundles, joins by time -------------------------------------------------------------------------


def _cells(spark, d):
    """Cells of four features of orders, most of them zero."""
    o = table(spark, d, "orders")
    zero = lambda c, k: F.when(F.col("o_orderkey") % k == 0, c).otherwise(0.0)
    dense = o.select("o_orderkey", zero(F.col("o_totalprice") / 1000, 7).alias("a"), zero(F.col("o_custkey") % 11, 5).alias("b"), F.when(F.col("o_orderkey") % 7 == 1, F.col("o_orderkey") % 3).otherwise(0.0).alias("c"), F.when(F.col("o_orderkey") % 7 == 2, 4.0).otherwise(0.0).alias("e"))
    return dense, sparse.from_dense(dense, "o_orderkey", ["a", "b", "c", "e"])


_DENSE = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice / 1000 ELSE 0.0 END AS a, CASE WHEN o_orderkey % 5 = 0 THEN (o_custkey % 11)::DOUBLE ELSE 0.0 END AS b, CASE WHEN o_orderkey % 7 = 1 THEN (o_orderkey % 3)::DOUBLE ELSE 0.0 END AS c, CASE WHEN o_orderkey % 7 = 2 THEN 4.0 ELSE 0.0 END AS e FROM orders"
_STORED = f"SELECT * FROM (SELECT o_orderkey AS row_id, unnest([{{'feature': 0, 'value': a}}, {{'feature': 1, 'value': b}}, {{'feature': 2, 'value': c}}, {{'feature': 3, 'value': e::DOUBLE}}], recursive := true) FROM ({_DENSE})) WHERE value <> 0"


@query("sparse_cells", f"SELECT row_id, feature::INT AS feature, round(value, 6) AS value FROM ({_STORED})")
def sparse_cells(spark, d):
    return _cells(spark, d)[1].select("row_id", "feature", r6(F.col("value"), "value"))


@query("sparse_round_trip", f"SELECT o_orderkey AS row_id, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(e::DOUBLE, 6) AS e FROM ({_DENSE})")
def sparse_round_trip(spark, d):
    dense, cells = _cells(spark, d)
    return sparse.to_dense(cells, dense.select(F.col("o_orderkey").alias("row_id")), ["a", "b", "c", "e"]).select("row_id", *[r6(F.col(c), c) for c in "abce"])


@query("sparse_edges", f"""WITH v AS (SELECT 1 AS feature, b AS v FROM ({_DENSE}) UNION ALL SELECT 2, c FROM ({_DENSE}) UNION ALL SELECT 3, e::DOUBLE FROM ({_DENSE}))
SELECT feature::INT AS feature, round((v + nxt) / 2, 6) AS edge FROM (SELECT feature, v, lead(v) OVER (PARTITION BY feature ORDER BY v) AS nxt, sum(count(*)) OVER (PARTITION BY feature ORDER BY v) AS upto, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature) AS t FROM v GROUP BY feature, v)
WHERE nxt IS NOT NULL AND floor((upto * 255 + 254) / t) > floor(((upto - n) * 255 + 254) / t)""")
def sparse_edges(spark, d):
    dense, cells = _cells(spark, d)
    return sparse.edges(cells.filter("feature > 0"), dense.count()).select("feature", r6(F.col("edge"), "edge"))


@query("bundle_conflicts", f"WITH s AS ({_STORED}) SELECT a.feature::INT AS f, b.feature::INT AS g, count(*)::BIGINT AS n FROM s a JOIN s b ON a.row_id = b.row_id AND a.feature < b.feature GROUP BY 1, 2")
def bundle_conflicts(spark, d):
    _, cells = _cells(spark, d)
    return sparse.conflicts(cells.select("row_id", "feature", F.lit(1).alias("bin")), dict.fromkeys(range(4), 0))


@query("bundled_histogram", f"WITH s AS ({_STORED}), b AS (SELECT row_id, feature, CASE WHEN feature = 3 THEN 1 ELSE value::INT END AS bin FROM s WHERE feature >= 2), t AS (SELECT count(*) AS n FROM orders) SELECT feature::INT AS feature, bin::INT AS bin, n::BIGINT AS n FROM (SELECT feature, bin, count(*) AS n FROM b GROUP BY 1, 2 UNION ALL SELECT f, 0, t.n - (SELECT count(*) FROM b WHERE feature = f) FROM t, (VALUES (2), (3)) AS x(f))")
def bundled_histogram(spark, d):
    dense, cells = _cells(spark, d)
    binned = cells.filter("feature >= 2").select("row_id", "feature", F.when(F.col("feature") == 3, 1).otherwise(F.col("value")).cast("int").alias("bin"))
    n, sizes, defaults = dense.count(), {2: 3, 3: 2}, {2: 0, 3: 0}
    plan = [[2, 3]]
    hist = sparse.bundle(binned, plan, sizes, defaults).groupBy("bundle", "bin").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.lit(0.0)).withColumn("h", F.lit(0.0))
    return sparse.unbundle(hist, plan, sizes, defaults, (0.0, 0.0, n)).groupBy("feature", "bin").agg(F.sum("n").alias("n"))


@query("as_of_join", "SELECT e.event_id, p.value AS value_as_of FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def as_of_join(spark, d):
    e = table(spark, d, "events")
    return joins.as_of(e.select("event_id", "user_id", "ts"), e.filter("event_id % 3 = 0").select("user_id", "ts", "value"), "ts", "user_id", ["value"]).select("event_id", "value_as_of")


@query("range_join", "SELECT b.k::INT AS k, count(*)::BIGINT AS n FROM orders JOIN (SELECT k, k * 9000.0 AS low, k * 9000.0 + 20000.0 AS high FROM range(40) AS t(k)) b ON o_totalprice >= low AND o_totalprice < high GROUP BY 1")
def range_join(spark, d):
    bands = spark.range(40).select(F.col("id").cast("int").alias("k"), (F.col("id") * 9000.0).alias("low"), (F.col("id") * 9000.0 + 20000.0).alias("high"))
    return joins.in_range(table(spark, d, "orders"), bands, "o_totalprice", "low", "high", 10000.0).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("row_set_algebra", "(SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 5) UNION SELECT c_custkey FROM customer WHERE c_nationkey = 7 INTERSECT SELECT o_custkey FROM orders")
def row_set_algebra(spark, d):
    o, c = table(spark, d, "orders").select("o_custkey"), table(spark, d, "customer")
    few = c.filter("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    own = c.filter("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    return o.subtract(few).union(own.intersect(o)).distinct()


@query("linear_leaf", "SELECT round(regr_slope(y, f0), 4) AS slope, round(regr_intercept(y, f0), 4) AS intercept FROM (SELECT l_quantity AS f0, l_extendedprice / 1000 AS y FROM lineitem)")
def linear_leaf(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("f0"), (-F.col("l_extendedprice") / 1000).alias("g"), F.lit(1.0).alias("h"), F.lit(0).alias("b_f0"))
    tree = [{"node": 0, "feature": 0, "bin": 0, "missing_bin": None, "default_left": True, "left": 1, "right": 2, "value": 0.0}, {"node": 1, "feature": None, "value": 0.0}, {"node": 2, "feature": None, "value": 0.0}]
    constant, slopes = linear.fit(rows, tree, ["f0"])[1]
    return spark.createDataFrame([(float(slopes["f0"]), float(constant))], "slope double, intercept double").select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("lda_axis", "SELECT label, count(*)::BIGINT AS n FROM embeddings GROUP BY 1")
def lda_axis(spark, d):
    """Rows of each class that the projection keeps: the projection must be finite everywhere."""
    rows = table(spark, d, "embeddings")
    axes = features.lda(rows, "embedding", "label", 2)
    seen = features.project(rows.withColumn("embedding", F.col("embedding").cast("array<double>")), "embedding", axes)
    return seen.filter(F.forall("lda", lambda v: ~F.isnan(v))).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
