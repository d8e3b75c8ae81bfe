"""What only larger tables show."""

from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from timberline.operators import boost, features, split
from timberline.plans import catalogue


def test_categories_of_large_whole_sums(spark):
    cells = [(0, 0, b, g, 1000, 1000) for b, g in enumerate([-4_000_000_000, -3_000_000_000, 3_500_000_000, 4_500_000_000])]
    hist = spark.createDataFrame(cells, "node int, feature int, bin int, g long, h long, n long")
    found = split.best_categorical(hist, split.SplitParams()).first()
    assert found["left"] == [0, 1]
    assert found["gain"] == 7e9 * 7e9 / 2011 + 8e9 * 8e9 / 2011 - 1e9 * 1e9 / 4001


def test_dictionary_without_a_limit(spark):
    texts = [(i, f"word{i} word{i} common") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = [(r["token_id"], r["token"], r["n"]) for r in features.dictionary(docs, "text", 2, None).collect()]
    want = [("common", 40), *sorted((f"word{i}", 2) for i in range(40))]
    assert sorted(got) == [(i, token, n) for i, (token, n) in enumerate(want)]
    assert len(features.dictionary(docs, "text", 2, 7).collect()) == 7


def test_scores_of_texts_take_every_frequent_token(spark, tmp_path):
    """More tokens of 50 places than a dictionary's usual size of 50,000."""
    size = 50_400
    start = F.lit(400) * (F.col("id") % 126)  # every word stands in 50 texts
    docs = spark.range(126 * 50, numPartitions=4).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(start, start + 399), lambda i: i.cast("string")), " ").alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert con.sql(f"SELECT count(*) FROM (SELECT token FROM {catalogue._TOKENS} GROUP BY 1 HAVING count(*) >= 50)").fetchall() == [(size,)]
    for name in ("bm25_apply", "naive_bayes_apply"):
        got = catalogue.QUERIES[name](spark, str(tmp_path))
        want = con.sql(catalogue.ORACLES[name])
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_memory_of_the_one_histogram_task(spark):
    """It does not add up over the shuffle's partitions."""
    rows = spark.range(4000).select((F.col("id") % 61).cast("double").alias("a"), (F.col("id") % 59).cast("double").alias("b"), (F.col("id") % 7).cast("double").alias("y"))
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    usual = spark.conf.get("spark.sql.shuffle.partitions")

    def peak(parts: int) -> int:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        stages = lambda: store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        seen = stages().length()
        try:
            boost.train(rows, ["a", "b"], "y", boost.Params.of(num_iterations=1, num_leaves=4))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", usual)
        every = stages()
        ran = [every.apply(i) for i in range(every.length())]
        ran = sorted(ran, key=lambda s: s.stageId())[seen:]
        return max(s.peakExecutionMemory() for s in ran if s.numTasks() == 1)

    assert peak(48) < 2 * peak(4)


def test_nearest_vectors_of_many_blocks(spark):
    """As by brute force, with copies; distances that are equal after the root are ties, which go by key."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=(300, 6)).astype(np.float32)
    x[200:240] = x[7]
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, v array<float>, label int")
    d = np.sqrt(((x[:, None].astype(float) - x) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = Counter((i, int(j) % 3) for i in range(300) for j in np.lexsort((np.arange(300), d[i]))[:5])
    for block in (70, 1000):
        assert {(r["id"], r["label"]): r["n"] for r in features.knn(rows, "id", "v", "label", block=block).collect()} == want
    close = spark.createDataFrame([(0, [0.0, 0.0], 0), (1, [1.0, 2.0**-26], 1), (2, [1.0, 0.0], 2)], "id long, v array<double>, label int")
    assert features.knn(close, "id", "v", "label", 1).filter("id = 0").first()["label"] == 1
