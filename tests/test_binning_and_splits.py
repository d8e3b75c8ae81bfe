import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.operators import binning, histogram, sampling, split, validate


def test_quantile_edges_against_sorting(spark):
    v = np.random.default_rng(1).integers(0, 400, 3000).astype(float)
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    for bins in (8, 32, 100):
        s, n = np.sort(v), len(v)
        want = set()
        for b in range(1, bins):
            i = b * n // bins
            if 0 < i < n:
                above = s[s > s[i - 1]]
                if len(above):
                    want.add((s[i - 1] + above[0]) / 2)
        got = {r["edge"] for r in binning.quantile_edges(df, ["x"], bins, 1).collect()}
        assert got == want


def test_missing_values_take_a_bin(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("nan"),), (3.0,)], "x double")
    b = binning.Bins.fit(df, ["x"], 255, 1)
    assert b.edges["x"] == [1.5, 2.5] and b.missing["x"] == 3
    assert [r["b_x"] for r in b.transform(df).collect()] == [0, 1, 3, 3, 2]


def test_equal_width_constant(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "x double")
    assert {r["bin"] for r in binning.equal_width(df, "x", 4).collect()} == {0}


def test_split_gain_of_eight_rows(spark):
    rows = [(i, -1.0 if i < 4 else 1.0, 1.0) for i in range(8)]
    df = spark.createDataFrame(rows, "b_x int, g double, h double")
    r = split.best(histogram.histogram(df, ["x"]), split.SplitParams(min_data_in_leaf=1)).collect()
    assert len(r) == 1 and (r[0]["feature"], r[0]["bin"]) == (0, 3) and r[0]["gain"] == pytest.approx(6.4)


def test_split_tie_takes_lower_feature(spark):
    df = spark.createDataFrame([(i % 2, i % 2, float(i % 2 * 2 - 1), 1.0) for i in range(50)], "b_x int, b_y int, g double, h double")
    assert split.best(histogram.histogram(df, ["x", "y"]), split.SplitParams()).first()["feature"] == 0


def test_missing_goes_to_the_better_side(spark):
    rows = [(0, -1.0)] * 30 + [(1, 1.0)] * 30 + [(2, 1.0)] * 30
    df = spark.createDataFrame(rows, "b_x int, g double").withColumn("h", F.lit(1.0))
    r = split.best(histogram.histogram(df, ["x"]), split.SplitParams(), {0: 2}).first()
    assert r["bin"] == 0 and not r["default_left"] and r["right_n"] == 60


def test_monotone_rejects_wrong_direction(spark):
    df = spark.createDataFrame([(i // 30, 1.0 if i < 30 else -1.0, 1.0) for i in range(60)], "b_x int, g double, h double")
    hist = histogram.histogram(df, ["x"])
    assert split.best(hist, split.SplitParams(monotone={0: -1})).count() == 0
    assert split.best(hist, split.SplitParams(monotone={0: 1})).count() == 1


def test_bagging_is_never_empty(spark):
    df = spark.range(5).withColumnRenamed("id", "k")
    assert sampling.bag(df, "k", 1e-9).count() == 1


def test_validation_raises(spark):
    df = spark.createDataFrame([(0.0, "a"), (2.0, "b")], "y double, s string")
    with pytest.raises(validate.DataError):
        validate.check_labels(df, "y", "binary")
    with pytest.raises(validate.DataError):
        validate.admit(df, ["s"])
    with pytest.raises(validate.DataError):
        validate.check_labels(df.filter("y > 9"), "y")
