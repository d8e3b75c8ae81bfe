"""Groups, joins by time, sparse data, counter draws, prepared tables, ingest and the command line."""

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timberline.__main__ import main
from timberline.functions.random import mixed, splitmix64
from timberline.operators import boost, groups, joins, sampling, sparse, validate
from timberline.operators.binning import Bins
from timberline.sources import prepared
from timberline.streaming import ingest


def test_groups(spark):
    assert [tuple(r) for r in groups.from_counts(spark, [2, 0, 3], "drop").collect()] == [(0, 2, 0), (2, 3, 2)]
    for bad in ([], [1, -1], [1, 0]):
        with pytest.raises(validate.DataError):
            groups.from_counts(spark, bad)
    rows = spark.createDataFrame([(i, q) for i, q in enumerate([7, 7, 3, 3, 3, 9])], "i long, q long")
    assert sorted(tuple(r) for r in groups.from_ids(rows, "q", "i").collect()) == [(3, 3, 2), (7, 2, 0), (9, 1, 5)]
    with pytest.raises(validate.DataError, match="consecutive"):
        groups.from_ids(rows.unionByName(spark.createDataFrame([(6, 7)], rows.schema)), "q", "i")


def test_counter_draws(spark):
    given = [0, 1, -1, 2**63 - 1, -(2**63), 123456789, 0x7FFFFFFF, 0xFFFFFFFF, 1 << 32]
    got = spark.createDataFrame([(g,) for g in given], "x long").select("x", splitmix64(F.col("x")).alias("z")).collect()
    assert [r["z"] % (1 << 64) for r in got] == [mixed(r["x"] % (1 << 64)) for r in got]
    assert mixed(0) == 0xE220A8397B1DCDAF  # the first number of the published generator
    assert sampling.counter_bag(spark.range(50), "id", 1e-9).count() == 1


def test_as_of(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, "a", 3), (5, None, 3)], "k long, u string, t long")
    right = spark.createDataFrame([("a", 3, 30.0), ("a", 4, None), ("b", 10, 1.0), ("a", 3, 10.0)], "u string, t long, v double")
    got = {r["k"]: r["v_as_of"] for r in joins.as_of(left, right, "t", "u", ["v"]).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 30.0, 5: None}


def test_sparse(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, 4)) * (rng.random((300, 4)) < 0.3)
    y = 4 * x[:, 0] - x[:, 2] + (x[:, 1] > 0)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "row_id long, a double, b double, c double, d double, y double")
    names = ["a", "b", "c", "d"]
    cells = sparse.from_dense(df, "row_id", names)
    sparse.check(cells, 4)
    with pytest.raises(validate.DataError):
        sparse.check(cells.unionByName(cells.limit(1)), 4)
    p = boost.Params.of(num_iterations=2, max_depth=2, num_leaves=4, grow_policy="depthwise", min_data_in_leaf=5)
    dense = boost.train(df, names, "y", p)
    m = sparse.train(cells, df.select("row_id", "y"), names, "y", p)
    shape = lambda x: [[(n["feature"], n.get("bin"), n["count"], pytest.approx(n["value"])) for n in t] for t in x.trees]
    assert shape(m) == shape(dense)
    out = sparse.predict(m, cells, df.select("row_id")).join(dense.predict(df).select("row_id", F.col("prediction").alias("q")), "row_id")
    assert out.agg(F.max(F.abs(F.col("prediction") - F.col("q")))).first()[0] < 1e-12
    binned, defaults = sparse.transform(cells, sparse.of(m.bins))
    whole = m.bins.transform(df)
    rows = df.select("row_id", F.col("y").alias("g"), F.lit(1.0).alias("h"))
    got = {(r["feature"], r["bin"]): (r["n"], round(r["g"], 9)) for r in sparse.histogram(binned, rows, defaults).collect()}
    for f, c in enumerate(names):
        for r in whole.groupBy(f"b_{c}").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("g")).collect():
            assert got[(f, r[0])] == (r["n"], pytest.approx(r["g"], abs=1e-6))
    assert sparse.bundles(4, {(0, 1): 3, (0, 2): 0, (1, 2): 9, (2, 3): 0, (0, 3): 1}, {0: 50, 1: 40, 2: 30, 3: 20}, 100) == [[0, 2], [1, 3]]


def test_prepared_tables(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 9), i % 2) for i in range(100)], "a double, y int")
    bins = Bins.fit(df, ["a"])
    prepared.write_prepared(df, bins, str(tmp_path / "p"))
    again, known = prepared.read_prepared(spark, str(tmp_path / "p"))
    assert prepared.fingerprint(known) == prepared.fingerprint(bins) and again.count() == 100
    assert prepared.checksum(df).first() == prepared.checksum(df.repartition(7)).first() != prepared.checksum(df.limit(99)).first()
    t = pa.table({"a": [1.0, 2.0]})
    assert prepared.from_arrow(spark, t, "r").agg(F.sum("r")).first()[0] == 1
    assert sorted(r["row_id"] for r in prepared.from_chunks(spark, [t, lambda: pd.DataFrame({"a": [3.0]})]).collect()) == [0, 1, 2]
    with pytest.raises(ValueError, match="schema"):
        prepared.from_chunks(spark, [t, pa.table({"b": [1]})])
    assert prepared.from_columns(spark, {"a": [1, 2], "b": np.array([0.5, 1.5])}).count() == 2


def test_checks(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (1, -1.0, 0.0)], "row long, g double, h double")
    validate.check_derivatives(df, "g", "h")
    assert validate.check_shape(df, ["g"]) == validate.check_row_ids(df, "row") == 2
    validate.check_codes(df, "row", 2)
    for bad in (lambda: validate.check_codes(df, "row", 1), lambda: validate.check_row_ids(df, "row", 1), lambda: validate.check_shape(df.limit(0), ["g"]), lambda: validate.check_derivatives(df.withColumn("h", F.lit(0.0)), "g", "h"), lambda: validate.check_derivatives(df.withColumn("g", F.lit(float("nan"))), "g", "h")):
        with pytest.raises(validate.DataError):
            bad()
    leaf = lambda i, v: {"node": i, "feature": None, "value": v}
    tree = [{"node": 0, "feature": 0, "left": 1, "right": 2}, leaf(1, 1.0), leaf(2, 2.0)]
    assert validate.monotone_holds(tree, {0: 1}) and not validate.monotone_holds(tree, {0: -1})


def test_ingest(spark, tmp_path):
    df = spark.range(40).withColumn("v", F.col("id") * 2.0)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "id").awaitTermination()
    got = ingest.coverage(spark, str(tmp_path / "out"), "id").collect()
    assert len(got) == 3 and sum(r["n"] for r in got) == 40


def test_command_line(spark, tmp_path, capsys):
    df = spark.createDataFrame([(float(i % 7), float(i % 3), float(i % 7 > 3)) for i in range(200)], "a double, b double, y double")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    main(["train", str(tmp_path / "d"), str(tmp_path / "m"), "--label", "y", "--params", "num_iterations=2 objective=binary max_depth=2"])
    assert main(["info", str(tmp_path / "m")])["trees"] == 2
    assert main(["predict", str(tmp_path / "d"), str(tmp_path / "m"), str(tmp_path / "o")])["rows"] == 200
    assert json.loads(capsys.readouterr().out.splitlines()[0])["features"] == 2


def test_porting():
    from timberline.sources import port

    p, report = port.port({"objective": "binary:logistic", "eta": 0.2, "lambda": 2.0, "subsample": 0.5, "nthread": 4, "gpu_id": 0}, "xgboost")
    assert (p.objective, p.learning_rate, p.lambda_l2, p.bagging_fraction, p.bagging_freq, p.grow_policy) == ("binary", 0.2, 2.0, 0.5, 1, "depthwise")
    assert {n: s for n, s, _ in report} == {"objective": "renamed" if report[0][1] == "renamed" else "kept", "eta": "renamed", "lambda": "renamed", "subsample": "renamed", "nthread": "machine", "gpu_id": "refused"}
    p, _ = port.port({"loss_function": "MAE", "iterations": 7, "depth": 3}, "catboost")
    assert (p.objective, p.num_iterations, p.max_depth, p.grow_policy, p.lambda_l2) == ("l1", 7, 3, "oblivious", 3.0)
    with pytest.raises(ValueError):
        port.port({}, "other")


def test_imported_trees_tell_missing_values_as_their_text_says(spark):
    from timberline.sources import io

    text = "tree\nnum_class=1\nnum_tree_per_iteration=1\nobjective=regression\nfeature_names=a\n\nTree=0\nnum_leaves=2\nnum_cat=0\nsplit_feature=0\nsplit_gain=1\nthreshold=-1.5\ndecision_type={}\nleft_child=-1\nright_child=-2\nleaf_value=1 2\nleaf_count=3 4\n\nend of trees\n"
    df = spark.createDataFrame([(float("nan"),), (None,), (-2.0,), (0.0,)], "a double")
    value = lambda kind: [r["prediction"] for r in io.from_lightgbm_text(text.format(kind)).predict(df).collect()]
    assert value(2) == [2.0, 2.0, 1.0, 2.0]  # no missing values: they count as 0
    assert value(10) == [1.0, 1.0, 1.0, 2.0] and value(8) == [2.0, 2.0, 1.0, 2.0]
    with pytest.raises(ValueError, match="zeros"):
        io.from_lightgbm_text(text.format(4))


def test_onnx_scores_are_the_models(spark, tmp_path):
    import onnxruntime

    from timberline.sources import onnx

    rng = np.random.default_rng(2)
    x = rng.random((400, 3)).astype(np.float32)
    df = spark.createDataFrame([(i, *map(float, r), int(r[0] > 0.6) + int(r[1] > 0.5)) for i, r in enumerate(x)], "k long, a double, b double, c double, y int")
    for more in ({}, {"objective": "multiclass", "num_class": 3}):
        m = boost.train(df, ["a", "b", "c"], "y", boost.Params.of(num_iterations=2, max_depth=3, num_leaves=8, grow_policy="depthwise", **more))
        onnx.save(m, str(tmp_path / "m.onnx"))
        got = onnxruntime.InferenceSession(str(tmp_path / "m.onnx"), providers=["CPUExecutionProvider"]).run(None, {"features": x})[0]
        rows = m.predict(df, "raw").orderBy("k").collect()
        want = np.array([r["probabilities"] if more else [r["prediction"]] for r in rows])
        assert np.abs(got - want).max() < 1e-5


def test_functional_interface(spark, tmp_path):
    from timberline import api

    df = spark.createDataFrame([(i, float(i % 17), float(i % 5), float(i % 17 > 8)) for i in range(600)], "k long, a double, b double, y double")
    data = api.Dataset(df, "y", key="k")
    assert data.features == ["a", "b"]
    b = api.train({"objective": "binary", "eta": 0.3, "max_depth": 2, "grow_policy": "depthwise"}, data.subset("k % 4 > 0"), 4, data.subset("k % 4 = 0"), early_stopping_rounds=2, metric="auc")
    assert b.num_trees() <= 4 and b.model.history[0]["loss"] == 1.0
    b.save_model(str(tmp_path / "b"))
    again = api.load(spark, str(tmp_path / "b"))
    assert again.model_to_string() == b.model_to_string() and again.feature_importance("gain").count() >= 1
    assert len(b.predict(df.limit(5), pred_contrib=True).first()["contributions"]) == 3
    r = api.cv({"objective": "binary", "max_depth": 1}, data, 1, 3, stratified=True, metric="auc")
    assert len(r["losses"]) == 3 and r["mean"] > 0.9
