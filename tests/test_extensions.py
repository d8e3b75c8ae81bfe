import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.operators import boost, features, histogram, linear, metrics, sampling
from timberline.sources import io


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.random((800, 3))
    y = 4 * x[:, 0] + np.sin(9 * x[:, 1]) + x[:, 2] * x[:, 0]
    return spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "k long, a double, b double, c double, y double").cache()


def params(**more):
    return boost.Params.of(**{"num_iterations": 2, "learning_rate": 0.5, "max_depth": 3, "num_leaves": 8, "grow_policy": "depthwise", **more})


def test_monotone_scores_rise(spark, rows):
    m = boost.train(rows, ["a", "b", "c"], "y", params(monotone={"a": 1, "b": -1}))
    line = spark.range(101).select((F.col("id") / 100).alias("a"), F.lit(0.5).alias("b"), F.lit(0.5).alias("c"))
    got = [r[0] for r in m.predict(line).orderBy("a").select("prediction").collect()]
    assert got == sorted(got)


def test_interaction_sets_hold(rows):
    m = boost.train(rows, ["a", "b", "c"], "y", params(interaction=[["a", "c"], ["b"]]))
    for t in m.trees:
        for used in linear.branch_features(t).values():
            assert not (1 in used and len(used) > 1)


def test_lightgbm_round_trip(rows):
    m = boost.train(rows, ["a", "b", "c"], "y", params())
    again = io.from_lightgbm_text(io.lightgbm_text(m))
    a = [r[0] for r in m.predict(rows, "raw").orderBy("k").select("prediction").collect()]
    b = [r[0] for r in again.predict(rows, "raw").orderBy("k").select("prediction").collect()]
    assert a == pytest.approx(b)


def test_sparse_histogram_equals_dense(spark):
    rng = np.random.default_rng(0)
    dense = rng.integers(0, 4, (60, 3)) * (rng.random((60, 3)) < 0.4)
    rows = spark.createDataFrame([(i, float(i % 5) - 2, 1.0, *map(int, r)) for i, r in enumerate(dense)], "row_id long, g double, h double, b_x int, b_y int, b_z int")
    cells = spark.createDataFrame([(i, f, int(v)) for i, r in enumerate(dense) for f, v in enumerate(r) if v], "row_id long, feature int, bin int")
    zero = spark.createDataFrame([(f, 0) for f in range(3)], "feature int, default_bin int")
    got = histogram.sparse_histogram(cells, rows.select("row_id", "g", "h"), zero).select("feature", "bin", "g", "h", "n")
    want = histogram.histogram(rows, ["x", "y", "z"]).select("feature", "bin", "g", "h", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_linear_leaf_fits_a_line(rows):
    t = boost.train(rows, ["a"], "a", params(num_iterations=1, max_depth=1))
    binned = t.bins.transform(rows).withColumn("g", -F.col("a")).withColumn("h", F.lit(1.0))
    leaves = linear.fit(binned, t.trees[0], ["a"])
    gap = binned.select(F.max(F.abs(linear.predict(t.trees[0], leaves, ["a"]) - F.col("a")))).first()[0]
    assert gap < 1e-6


def test_mvs_threshold_meets_the_rate(rows):
    g = rows.withColumn("g", F.col("y") - 2)
    t = sampling.mvs_threshold(g, "g", 0.4, 0.1)
    assert g.agg(F.sum(F.least(F.lit(1.0), F.sqrt(F.col("g") ** 2 + 0.1) / t))).first()[0] == pytest.approx(0.4 * 800, rel=1e-6)


def test_lda_separates(spark):
    rng = np.random.default_rng(2)
    data = [(int(k % 2), [float(x) for x in rng.normal(size=4) + (np.array([3.0, 0, 0, 0]) if k % 2 else 0)]) for k in range(200)]
    df = spark.createDataFrame(data, "label int, v array<double>")
    out = features.project(df, "v", features.lda(df, "v", "label", 1)).select("label", F.col("lda")[0].alias("p"))
    r = out.groupBy("label").agg(F.avg("p").alias("m"), F.stddev("p").alias("s")).orderBy("label").collect()
    assert abs(r[0]["m"] - r[1]["m"]) > 2 * max(r[0]["s"], r[1]["s"])


def test_extra_trees_noise_and_feature_prices(rows):
    m = boost.train(rows, ["a", "b", "c"], "y", params(extra_trees=True, random_strength=0.1))
    assert metrics.pointwise(m.predict(rows), "l2", "y", "prediction").first()["value"] < 0.7 * rows.agg(F.var_pop("y")).first()[0]
    dear = boost.train(rows, ["a", "b", "c"], "y", params(cegb_penalty_feature={"a": 1e9}))
    assert all(n["feature"] != 0 for t in dear.trees for n in t)
    none = boost.train(rows, ["a", "b", "c"], "y", params(cegb_penalty_split=1e9))
    assert not none.trees


def test_multi_target(spark):
    df = spark.createDataFrame([(1.0, None, 2.0, 0.0), (None, None, 0.0, 0.0), (3.0, 1.0, 3.0, 3.0)], "y0 double, y1 double, p0 double, p1 double")
    assert metrics.multi_rmse(df, ["y0", "y1"], ["p0", "p1"]).first()["value"] == pytest.approx((5 / 2) ** 0.5)
