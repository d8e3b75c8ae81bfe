import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.estimator import Classifier, Regressor
from timberline.operators import boost, inspect, metrics
from timberline.sources import io
from timberline.streaming import score


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.random((1200, 3))
    y = 3 * x[:, 0] + 2 * (x[:, 1] > 0.5)
    data = [(i, *map(float, r), float(t), int(t > 2.5)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "k long, a double, b double, c double, y double, z int").cache()


def params(**more):
    return boost.Params.of(**{"num_iterations": 4, "learning_rate": 0.5, "max_depth": 3, "num_leaves": 8, "grow_policy": "depthwise", **more})


@pytest.mark.parametrize("policy", ["depthwise", "leafwise", "oblivious"])
def test_error_falls(rows, policy):
    m = boost.train(rows, ["a", "b", "c"], "y", params(grow_policy=policy))
    mse = metrics.pointwise(m.predict(rows), "l2", "y", "prediction").first()["value"]
    var = rows.agg(F.var_pop("y")).first()[0]
    assert mse < 0.2 * var


@pytest.mark.parametrize("kind", [{"boosting": "dart", "skip_drop": 0.0}, {"boosting": "rf", "bagging_fraction": 0.6, "bagging_freq": 1}, {"boosting": "goss"}])
def test_variants_learn(rows, kind):
    m = boost.train(rows, ["a", "b", "c"], "y", params(**kind), key="k")
    assert metrics.pointwise(m.predict(rows), "l2", "y", "prediction").first()["value"] < 0.6 * rows.agg(F.var_pop("y")).first()[0]


def test_first_leaf_values_are_newton_steps(rows):
    m = boost.train(rows, ["a", "b", "c"], "y", params(num_iterations=1, max_depth=1))
    t = m.trees[0]
    binned = m.bins.transform(rows)
    got = binned.groupBy((F.col(f"b_{m.features[t[0]['feature']]}") <= t[0]["bin"]).alias("left")).agg(F.sum(F.lit(m.base[0]) - F.col("y")).alias("g"), F.count(F.lit(1)).alias("n")).collect()
    for r in got:
        assert t[t[0]["left" if r["left"] else "right"]]["value"] == pytest.approx(-r["g"] / (r["n"] + 1))


def test_model_round_trip_and_edits(spark, rows, tmp_path):
    m = boost.train(rows, ["a", "b", "c"], "y", params())
    io.save(spark, m, str(tmp_path / "m"))
    again = io.load(spark, str(tmp_path / "m"))
    a = [r[0] for r in m.predict(rows).orderBy("k").select("prediction").collect()]
    assert a == [r[0] for r in again.predict(rows).orderBy("k").select("prediction").collect()]
    (low, high), = inspect.score_bounds(m)
    assert low - 1e-9 <= min(a) and max(a) <= high + 1e-9
    assert len(inspect.rollback(m, 1).trees) == 3
    assert "end of trees" in io.lightgbm_text(m)
    assert inspect.set_leaf(m, 0, 0, 9.0).trees != m.trees
    assert inspect.importance(inspect.node_table(spark, m)).count() >= 2


def test_contributions_add_up(rows):
    m = boost.train(rows, ["a", "b", "c"], "y", params(num_iterations=2))
    out = inspect.contributions(m.predict(rows, "raw").limit(50), m).collect()
    assert all(sum(r["contributions"]) == pytest.approx(r["prediction"]) for r in out)


def test_contributions_are_shapley_values(spark):
    """Against the sum over all subsets of features, with a missing bin and a feature that is split on twice."""
    from itertools import combinations

    from timberline.operators.binning import Bins

    leaf = lambda i, v, n: {"node": i, "feature": None, "depth": 0, "value": v, "count": n, "gain": None}
    split = lambda i, f, b, left, right, n, dl=True, missing=None: {"node": i, "feature": f, "bin": b, "threshold": b + 0.5, "default_left": dl, "missing_bin": missing, "left": left, "right": right, "gain": 1.0, "value": 0.0, "count": n, "depth": 0}
    tree = [split(0, 0, 1, 1, 2, 100), split(1, 1, 0, 3, 4, 60, False, 3), split(2, 0, 2, 5, 6, 40), leaf(3, 1.0, 20), split(4, 2, 1, 7, 8, 40), leaf(5, -2.0, 10), leaf(6, 4.0, 30), leaf(7, 3.0, 15), leaf(8, -1.0, 25)]
    model = boost.Model(["a", "b", "c"], Bins({c: [0.5, 1.5, 2.5] for c in "abc"}, {"a": None, "b": 4, "c": None}), boost.Params(), [0.5, -1.0], [tree, [leaf(0, 2.0, 9)], tree, tree], [1.0, 0.5, 0.25, 2.0])

    def expected(t, i, row, known):
        n = t[i]
        if n["feature"] is None:
            return n["value"]
        a, b = n["left"], n["right"]
        if n["feature"] in known:
            x = row[n["feature"]]
            return expected(t, a if (n["default_left"] if x == n["missing_bin"] else x <= n["bin"]) else b, row, known)
        return (t[a]["count"] * expected(t, a, row, known) + t[b]["count"] * expected(t, b, row, known)) / n["count"]

    rows = [(float(i), float(j), float(k)) for i in range(4) for j in range(4) for k in range(3)]
    got = inspect.contributions(spark.createDataFrame(rows, "a double, b double, c double"), model).collect()
    for r in got:
        row, want = [int(r["a"]), int(r["b"]), int(r["c"])], []
        for c in range(2):
            phi = [0.0] * 3 + [model.base[c]]
            for t, w in [(model.trees[i], model.weights[i]) for i in range(4) if i % 2 == c]:
                phi[3] += w * expected(t, 0, row, set())
                for f in range(3):
                    others = [x for x in range(3) if x != f]
                    for size in range(3):
                        for s in combinations(others, size):
                            phi[f] += w * [1 / 3, 1 / 6, 1 / 3][size] * (expected(t, 0, row, {*s, f}) - expected(t, 0, row, set(s)))
            want += phi
        assert r["contributions"] == pytest.approx(want)


def test_unknown_parameters_are_refused():
    with pytest.raises(ValueError, match="lamda_l2"):
        boost.Params.of(lamda_l2=5)
    assert boost.Params.parse("objective=quantile alpha=0.25 eta=0.2").args == {"alpha": 0.25}


def test_leaf_wise_trees_follow_the_best_first_order(rows):
    """Grown ahead of need, but split in the order of gains, to the same leaves as one split at a time."""
    p = params(grow_policy="leafwise", num_leaves=12, num_iterations=1, max_depth=-1)
    m = boost.train(rows, ["a", "b", "c"], "y", p)
    t = m.trees[0]
    splits = [n for n in t if n["feature"] is not None]
    assert len(t) == 23 and len(splits) == 11
    order = sorted(splits, key=lambda n: n["left"])
    open_ = {0}
    for n in order:  # each split is the best that was open
        assert n["node"] in open_ and n["gain"] >= max(x["gain"] for x in splits if x["node"] in open_) - 1e-12
        open_ = open_ - {n["node"]} | {n["left"], n["right"]}
    binned = m.bins.transform(rows).withColumn("leaf", boost.route(t, lambda n: F.lit(n["node"]), m.features))
    for r in binned.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y") - m.base[0]).alias("s")).collect():
        assert t[r["leaf"]]["count"] == r["n"] and t[r["leaf"]]["value"] == pytest.approx(r["s"] / (r["n"] + 1))


@pytest.mark.parametrize("objective,alpha", [("l1", 0.5), ("quantile", 0.8), ("mape", 0.5)])
@pytest.mark.parametrize("weight", [None, "w"])
def test_renewed_leaves_are_percentiles_of_residuals(rows, objective, alpha, weight):
    df = rows.withColumn("w", (F.col("k") % 3 + 1) / 2)
    m = boost.train(df, ["a", "b", "c"], "y", params(objective=objective, alpha=alpha, num_iterations=1), weight=weight)
    found = m.bins.transform(df).withColumn("leaf", boost.route(m.trees[0], lambda n: F.lit(n["node"]), m.features)).select("leaf", "y", "w").collect()
    for leaf in {r["leaf"] for r in found}:
        w = lambda r: (r["w"] if weight else 1.0) / (max(1.0, abs(r["y"])) if objective == "mape" else 1.0)
        mine = sorted((r["y"] - m.base[0], w(r)) for r in found if r["leaf"] == leaf)
        if not weight and objective != "mape":
            at = (len(mine) - 1) * alpha
            low = int(at)
            want = mine[low][0] + (mine[min(low + 1, len(mine) - 1)][0] - mine[low][0]) * (at - low)
        else:
            total, goal, want = 0.0, sum(x for _, x in mine) * alpha, None
            for i, (v, x) in enumerate(mine):
                if total + x > goal or i == len(mine) - 1:
                    prev = mine[i - 1][0]
                    want = v if i in (0, len(mine) - 1) else prev + (goal - total) / x * (v - prev) if x >= 1 else prev
                    break
                total += x
        assert m.trees[0][leaf]["value"] == pytest.approx(want)


def test_categories_split_by_sets(spark):
    rng = np.random.default_rng(6)
    names = [f"c{i}" for i in range(9)]
    data = [(i, names[c], float(x), 5.0 * (c in (1, 4, 7)) + float(x)) for i, (c, x) in enumerate(zip(rng.integers(0, 9, 900), rng.random(900)))]
    df = spark.createDataFrame(data + [(1000, None, 0.5, 0.0)], "k long, cat string, x double, y double")
    m = boost.train(df, ["cat", "x"], "y", params(num_iterations=2, categorical=["cat"], cat_l2=1.0))
    root = m.trees[0][0]
    assert m.features[root["feature"]] == "cat" and {m.bins.levels["cat"][c] for c in root["cats"]} in ({"c1", "c4", "c7"}, set(names) - {"c1", "c4", "c7"})
    assert metrics.pointwise(m.predict(df.filter("cat IS NOT NULL")), "l2", "y", "prediction").first()["value"] < 2
    assert m.predict(spark.createDataFrame([("new", 0.5)], "cat string, x double")).count() == 1
    again = io.loads(io.dumps(m))
    assert again.predict(df).agg(F.sum("prediction")).first() == m.predict(df).agg(F.sum("prediction")).first()


def test_rankers_and_survival_learn(spark, rows):
    rows = rows.filter("k < 600").coalesce(2)
    df = rows.withColumn("q", F.floor(F.col("k") / 20)).withColumn("rel", F.least(F.lit(4), F.floor("y")).cast("int"))
    for kind in ("lambdarank", "query_rmse", "pair_logit"):
        m = boost.train(df, ["a", "b", "c"], "rel", params(objective=kind, group="q", num_iterations=1), key="k")
        assert metrics.ndcg(m.predict(df), "q", "rel", "prediction", "k").first()["value"] > 0.9
    times = rows.withColumn("t", F.round(F.exp(2 - F.col("y") / 2), 2)).withColumn("e", (F.col("k") % 4 > 0).cast("int"))
    m = boost.train(times, ["a", "b", "c"], "t", params(objective="cox", event="e", num_iterations=2), key="k")
    scored = m.predict(times).withColumn("zero", F.lit(0.0))
    ll = lambda c: metrics.cox_partial_loglik(scored, "t", "e", c).first()["value"]
    assert ll("prediction") > ll("zero") + 20
    for noise in ("normal", "logistic", "extreme"):
        both = times.withColumn("up", F.when(F.col("e") == 1, F.col("t")).otherwise(-1.0))
        m = boost.train(both, ["a", "b", "c"], "t", params(objective="aft", upper="up", noise=noise, num_iterations=3), key="k")
        out = m.predict(both, "raw").filter("e = 1").withColumn("log", F.log("t"))
        assert out.stat.corr("prediction", "log") > 0.8, noise


def test_several_targets(rows):
    df = rows.withColumn("y2", F.when(F.col("k") % 5 > 0, -2 * F.col("y") + 1))
    m = boost.train(df, ["a", "b", "c"], ["y", "y2"], params(objective="multi_rmse"))
    out = m.predict(df).select("y", "y2", F.col("prediction")[0].alias("p"), F.col("prediction")[1].alias("q"))
    r = out.agg(F.avg((F.col("y") - F.col("p")) ** 2).alias("a"), F.avg((F.col("y2") - F.col("q")) ** 2).alias("b"), F.var_pop("y").alias("v"), F.var_pop("y2").alias("u")).first()
    assert r["a"] < 0.2 * r["v"] and r["b"] < 0.2 * r["u"]


def test_smoothing_pulls_leaves_to_their_parents(rows):
    free = boost.train(rows, ["a", "b", "c"], "y", params(num_iterations=1, max_depth=1))
    firm = boost.train(rows, ["a", "b", "c"], "y", params(num_iterations=1, max_depth=1, path_smooth=1e9))
    spread = lambda m: max(n["value"] for n in m.trees[0]) - min(n["value"] for n in m.trees[0])
    assert spread(firm) < 1e-3 < spread(free)


def test_normal_distribution(spark):
    import math

    from timberline.functions.objectives import normal_cdf

    x = [(k / 7,) for k in range(-80, 81)]
    for r in spark.createDataFrame(x, "x double").select("x", normal_cdf(F.col("x")).alias("p")).collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), rel=1e-9, abs=1e-14)


def test_estimators(rows):
    assert Regressor(["a", "b", "c"], "y", num_iterations=4, eta=0.5, max_depth=3).fit(rows).score(rows) > 0.8
    assert Classifier(["a", "b", "c"], "z", num_iterations=4, eta=0.5, max_depth=3).fit(rows).score(rows) > 0.9


def test_values_and_bins_lead_to_the_same_leaves(spark, rows):
    """With missing values, and with so many edges that they are searched in batches."""
    df = rows.withColumn("a", F.when(F.col("k") % 7 == 0, None).when(F.col("k") % 11 == 0, float("nan")).otherwise(F.col("a"))).withColumn("d", F.col("b") - 0.5)
    names = ["a", "b", "c", "d"]
    m = boost.train(df, names, "y", params(num_iterations=2))
    assert m.bins.size() > 512
    few = boost.train(df, names, "y", params(num_iterations=2, max_bin=40))
    for model in (m, few):
        gap = F.max(F.abs(model.raw()[0] - F.col("prediction"))).alias("gap")
        both = model.bins.transform(model.predict(df, "raw")).agg(gap).first()["gap"]
        assert both < 1e-12
        same = model.bins.binned(df, ["k"]).exceptAll(model.bins.transform(df).select(*[f"b_{c}" for c in names], "k"))
        assert same.count() == 0
    last = m.staged(df).select(F.element_at("staged", -1).alias("s"), "k").join(m.predict(df, "raw"), "k")
    assert last.agg(F.max(F.abs(F.col("s") - F.col("prediction")))).first()[0] < 1e-12


def test_streaming_scores_match(spark, rows, tmp_path):
    m = boost.train(rows, ["a", "b", "c"], "y", params(num_iterations=2))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = score.score(stream, m).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("scored").agg(F.sum("prediction")).first()[0] == pytest.approx(m.predict(rows).agg(F.sum("prediction")).first()[0])


def test_parameters():
    assert boost.Params.parse("eta=0.3 num_round=5").learning_rate == 0.3
    with pytest.raises(ValueError):
        boost.Params.of(eta=0.1, learning_rate=0.2)
    with pytest.raises(ValueError):
        boost.Params.of(learning_rate=0)


def test_metrics_of_hand_sized_inputs(spark):
    df = spark.createDataFrame([(0, 0, 3, 0.5), (1, 0, 2, 0.4), (2, 0, 3, 0.3), (3, 0, 0, 0.2)], "k int, q int, l int, s double")
    assert metrics.ndcg(df, "q", "l", "s", "k", 4).first()["value"] == pytest.approx(0.9594535145926796)
    b = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, s double")
    assert metrics.auc(b, "y", "s").first()["value"] == 1.0
    assert metrics.auc(b.withColumn("s", F.lit(1.0)), "y", "s").first()["value"] == 0.5


def test_windowed_means_of_a_stream(spark, rows, tmp_path):
    m = boost.train(rows, ["a", "b", "c"], "y", params(num_iterations=1))
    timed = rows.withColumn("t", F.timestamp_seconds(F.col("k") * 60))
    timed.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in"))
    q = score.windowed_mean(stream, m, "t").writeStream.format("memory").outputMode("complete").queryName("means").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r[0]: (r[1], r[2]) for r in m.predict(timed).groupBy(F.window("t", "1 hour")["start"]).agg(F.avg("prediction"), F.count(F.lit(1))).collect()}
    got = {r["window_start"]: (r["mean_prediction"], r["n"]) for r in spark.table("means").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
