"""Sparse data as stored cells (row_id, feature, value): what is not stored is 0.0. Bundles of features that rarely meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binning import Bins
from .histogram import sparse_histogram
from .ranges import neighbours, place, running, with_totals
from .validate import DataError


def from_dense(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """The stored cells of a dense table; nulls and NaN stay as NaN, zeros go."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("value")) for i, c in enumerate(features)]))
    out = df.select(F.col(key).alias("row_id"), cells.alias("e")).select("row_id", "e.*").withColumn("value", F.coalesce("value", F.lit(float("nan"))))
    return out.filter("value <> 0")


def to_dense(cells: DataFrame, rows: DataFrame, features: list[str]) -> DataFrame:
    """The dense table of `rows` (row_id, ...): one aggregation over the stored cells."""
    wide = cells.groupBy("row_id").agg(*[F.max(F.when(F.col("feature") == i, F.col("value"))).alias(c) for i, c in enumerate(features)])
    return rows.join(wide, "row_id", "left").fillna(0.0, features)


def check(cells: DataFrame, n_features: int) -> None:
    """Features in range, no cell twice."""
    bad = cells.filter((F.col("feature") < 0) | (F.col("feature") >= n_features) | F.col("feature").isNull() | F.col("row_id").isNull()).limit(1).count()
    if bad:
        raise DataError("a cell lies outside of the matrix")
    if cells.groupBy("row_id", "feature").count().filter("count > 1").limit(1).count():
        raise DataError("a cell is stored twice")


def edges(cells: DataFrame, n_rows: int, max_bin: int = 255, min_data_in_bin: int = 3) -> DataFrame:
    """(feature, edge): quantile edges with the zeros that are not stored counted in, from counts of distinct values."""
    stored = cells.filter(~F.isnan("value")).groupBy("feature", F.col("value").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    held = cells.groupBy("feature").agg(F.count(F.lit(1)).alias("s"))
    zero = held.select("feature", F.lit(0.0).alias("v"), (F.lit(n_rows) - F.col("s")).alias("n")).filter("n > 0")
    counts = stored.unionByName(zero).groupBy("feature", "v").agg(F.sum("n").alias("n"))
    placed = place(counts, ["feature", "v"])
    totals = placed.groupBy("feature").agg(F.sum("n").alias("valid")).withColumn("bins", F.greatest(F.lit(1), F.least(F.lit(max_bin), F.floor(F.col("valid") / min_data_in_bin))))
    run = neighbours(running(with_totals(placed, totals, ["feature"]), {"before": F.col("n")}, ["feature"], ["v"]), "v", ["feature"], ["v"], after="next")
    upto = F.col("before") + F.col("n")
    cutoff = lambda c: F.floor((c * F.col("bins") + F.col("bins") - 1) / F.col("valid"))
    return run.filter(F.col("next").isNotNull() & (cutoff(upto) > cutoff(F.col("before")))).select("feature", ((F.col("v") + F.col("next")) / 2).alias("edge"))


def transform(cells: DataFrame, known: dict[int, list[float]]) -> tuple[DataFrame, dict[int, int]]:
    """(row_id, feature, bin) of the stored cells, NaN in the bin behind the last, and each feature's bin of 0.0."""
    from bisect import bisect_left

    rows = [(f, [float(x) for x in e]) for f, e in known.items()]
    table = F.broadcast(cells.sparkSession.createDataFrame(rows, "feature int, edges array<double>"))  # a row per feature
    at = F.when(F.isnan("value"), F.size("edges") + 1).otherwise(F.size(F.filter("edges", lambda e: e < F.col("value"))))
    return cells.join(table, "feature").select("row_id", "feature", at.cast("int").alias("bin")), {f: bisect_left(e, 0.0) for f, e in known.items()}


def histogram(binned: DataFrame, rows: DataFrame, defaults: dict[int, int]) -> DataFrame:
    """(feature, bin, g, h, n): stored cells are summed, the rest of the totals goes to the default bins."""
    table = binned.sparkSession.createDataFrame(list(defaults.items()), "feature int, default_bin int")
    return sparse_histogram(binned, rows, table)


def train(cells: DataFrame, rows: DataFrame, names: list[str], label: str, params, **more):
    """Boosting over stored cells: they become one wide row of each row_id, once, and the trainer is the dense one."""
    from .boost import train as fit

    return fit(to_dense(cells, rows, names), names, label, params, **more)


def predict(model, cells: DataFrame, rows: DataFrame, **how) -> DataFrame:
    """Scores of `rows` (row_id, ...) from stored cells; only features that the trees use are read."""
    used = sorted({n["feature"] for t in model.trees for n in t if n["feature"] is not None})
    names = [model.features[f] for f in used]
    wide = cells.filter(F.col("feature").isin(used)).groupBy("row_id").agg(*[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(c) for f, c in zip(used, names)]) if used else cells.select("row_id").distinct()
    dense = rows.join(wide, "row_id", "left").fillna(0.0, names)
    for c in model.features:
        if c not in names and c not in dense.columns:
            dense = dense.withColumn(c, F.lit(0.0))
    return model.predict(dense, **how).drop(*[c for c in model.features if c not in rows.columns])


# --- bundles of exclusive features --------------------------------------------------------------------------------


def conflicts(binned: DataFrame, defaults: dict[int, int]) -> DataFrame:
    """(f, g, n): rows in which two features both leave their default bin; from the stored cells of each row."""
    table = F.broadcast(binned.sparkSession.createDataFrame(list(defaults.items()), "feature int, d int"))  # a row per feature
    live = binned.join(table, "feature").filter("bin <> d").select("row_id", "feature")
    each = live.groupBy("row_id").agg(F.sort_array(F.collect_list("feature")).alias("l")).filter(F.size("l") > 1)
    pair = F.flatten(F.transform("l", lambda a, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda b: F.struct(a.alias("f"), b.alias("g")))))
    return each.select(F.explode(pair).alias("p")).groupBy("p.f", "p.g").agg(F.count(F.lit(1)).alias("n"))


def bundles(n_features: int, met: dict[tuple[int, int], int], counts: dict[int, int], n_rows: int, rate: float = 0.0) -> list[list[int]]:
    """Greedy bundles: features by falling number of rows outside their default, each into the first bundle that it meets in
    no more rows than allowed. The table of meetings has features squared entries at most."""
    most, out, spent = int(rate * n_rows), [], []
    for f in sorted(range(n_features), key=lambda x: (-counts.get(x, 0), x)):
        for k, b in enumerate(out):
            n = sum(met.get((min(f, g), max(f, g)), 0) for g in b)
            if spent[k] + n <= most:
                b.append(f)
                spent[k] += n
                break
        else:
            out.append([f])
            spent.append(0)
    return [sorted(b) for b in out]


def bundle(binned: DataFrame, plan: list[list[int]], sizes: dict[int, int], defaults: dict[int, int]) -> DataFrame:
    """(row_id, bundle, bin): bin 0 is all defaults; a feature's other bins follow those of the features before it. Where two
    features of a bundle meet, the later one counts."""
    rows = []
    for k, b in enumerate(plan):
        start = 1
        for f in b:
            rows.append((f, k, start, defaults[f]))
            start += sizes[f]
    table = F.broadcast(binned.sparkSession.createDataFrame(rows, "feature int, bundle int, start int, d int"))  # a row per feature
    live = binned.join(table, "feature").filter("bin <> d")
    return live.groupBy("row_id", "bundle").agg(F.max_by(F.col("start") + F.col("bin"), F.col("feature")).alias("bin"))


def unbundle(hist: DataFrame, plan: list[list[int]], sizes: dict[int, int], defaults: dict[int, int], total: tuple[float, float, int]) -> DataFrame:
    """(feature, bin, g, h, n) from a histogram of bundles (bundle, bin, g, h, n); default bins are what is left of the total."""
    rows = []
    for k, b in enumerate(plan):
        start = 1
        for f in b:
            rows.append((k, f, start, start + sizes[f] - 1, defaults[f]))
            start += sizes[f]
    table = F.broadcast(hist.sparkSession.createDataFrame(rows, "bundle int, feature int, low int, high int, d int"))  # a row per feature
    own = hist.join(table, "bundle").filter("bin BETWEEN low AND high").select("feature", (F.col("bin") - F.col("low")).alias("bin"), "g", "h", "n")
    seen = own.groupBy("feature").agg(*[F.sum(c).alias(f"s{c}") for c in "ghn"])
    rest = table.join(seen, "feature", "left").select("feature", F.col("d").alias("bin"), *[(F.lit(t) - F.coalesce(f"s{c}", F.lit(0))).alias(c) for c, t in zip("ghn", total)])
    return own.unionByName(rest).filter("n > 0")


def of(bins: Bins) -> dict[int, list[float]]:
    """The edges of a dense table's bins, by feature number."""
    return dict(enumerate(bins.edges.values()))
