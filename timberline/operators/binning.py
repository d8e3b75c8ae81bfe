"""Quantization: exact quantile edges, equal width, categories, and the value-to-bin projection."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ranges import neighbours, place, running, with_totals


def stack(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, v): all values of the columns in one pass."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("e")).select("e.*")


def quantile_edges(df: DataFrame, columns: list[str], max_bin: int = 255, min_data_in_bin: int = 3, use_missing: bool = True) -> DataFrame:
    """(feature, edge): exact edges from the counts of distinct values.

    Values are pre-aggregated to (feature, value, count), so a hot value is one row. The counts are dealt into ranges of
    (feature, value); running counts inside a range, from the totals of the ranges before it, give every rank, and an edge
    lies midway between the value at a boundary rank and the next distinct one. With at most as many distinct values as
    bins, edges are cut as soon as a bin has min_data_in_bin rows.
    """
    v = F.when(~F.isnan("v"), F.col("v"))
    counts = stack(df, columns).select("feature", v.alias("v")).groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = place(counts, ["feature", "v"])
    totals = placed.groupBy("feature").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("valid"), F.max(F.col("v").isNull().cast("int")).alias("missing"), F.count("v").alias("levels"))
    room = F.lit(max_bin) - (F.col("missing") if use_missing else F.lit(0))
    totals = totals.withColumn("bins", F.greatest(F.lit(1), F.least(room, F.floor(F.col("valid") / min_data_in_bin)))).withColumn("room", room)
    run = with_totals(placed, totals, ["feature"])
    few = run.filter((F.col("levels") <= F.col("room")) & F.col("v").isNotNull()).groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("l"))  # at most max_bin levels each
    fold = f"""aggregate(sequence(0, size(l) - 1), named_struct('c', 0L, 'e', cast(array() AS array<double>)),
        (a, i) -> if(a.c + l[i].n >= {min_data_in_bin} and i < size(l) - 1,
            named_struct('c', 0L, 'e', concat(a.e, array((l[i].v + l[i + 1].v) / 2))), named_struct('c', a.c + l[i].n, 'e', a.e)), a -> a.e)"""
    # null values are counted apart, the others are ranked: a boundary rank b * valid / bins falls behind the value whose
    # running count reaches it first
    ranked = running(run.filter((F.col("levels") > F.col("room")) & F.col("v").isNotNull()), {"before": F.col("n")}, ["feature"], ["v"])
    ranked = neighbours(ranked, "v", ["feature"], ["v"], after="next")
    upto = F.col("before") + F.col("n")
    reaches = F.floor((upto * F.col("bins") + F.col("bins") - 1) / F.col("valid")) > F.floor((F.col("before") * F.col("bins") + F.col("bins") - 1) / F.col("valid"))
    many = ranked.filter(F.col("next").isNotNull() & reaches)
    return many.select("feature", ((F.col("v") + F.col("next")) / 2).alias("edge")).unionByName(few.select("feature", F.explode(F.expr(fold)).alias("edge")))


def equal_width(df: DataFrame, column: str, bins: int) -> DataFrame:
    """The column's value, its bin of `bins` equal ones from minimum to maximum; a constant column is all bin 0."""
    span = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    b = F.floor((F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins)
    return df.crossJoin(F.broadcast(span)).withColumn("bin", F.when(F.col("__hi") == F.col("__lo"), 0).otherwise(F.least(b, F.lit(bins - 1))).cast("int")).drop("__lo", "__hi")


def border_type_edges(df: DataFrame, column: str, kind: str, n: int) -> DataFrame:
    """(feature, edge) by a named border rule: Median, Uniform or UniformAndQuantiles."""
    if kind == "Median":
        return quantile_edges(df, [column], n + 1, 1)
    if kind == "Uniform":
        s = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
        return s.select(F.lit(column).alias("feature"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (n + 1))).alias("edge"))
    if kind == "UniformAndQuantiles":
        return border_type_edges(df, column, "Median", n - n // 2).unionByName(border_type_edges(df, column, "Uniform", n // 2)).distinct()
    raise ValueError(f"border type {kind} is not supported")


def categories(df: DataFrame, column: str, max_bin: int = 255) -> DataFrame:
    """(category, n, code): kept by frequency when there are more than fit, codes by ascending category."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    kept = counts.orderBy(F.desc("n"), "category").limit(max_bin)
    return kept.withColumn("code", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("category")) - 1)


def encode(df: DataFrame, column: str, table: DataFrame, out: str) -> DataFrame:
    """The code of each category; unseen and missing ones are -1. The table has at most max_bin rows."""
    t = F.broadcast(table.select(F.col("category").alias("__c"), F.col("code").alias(out)))
    return df.join(t, df[column] == F.col("__c"), "left").drop("__c").withColumn(out, F.coalesce(out, F.lit(-1)))


def bin_column(value: Column, edges: list[float], missing_bin: int | None) -> Column:
    """The number of edges below a value, by a binary search written out; missing values take their bin or count as 0."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= edges[middle], search(low, middle)).otherwise(search(middle + 1, high))

    gone = value.isNull() | F.isnan(value)
    return F.when(gone, F.lit(bisect_left(edges, 0.0) if missing_bin is None else missing_bin)).otherwise(search(0, len(edges))).cast("int")


def prefilter(df: DataFrame, columns: list[str], filter_cnt: int) -> DataFrame:
    """(feature, usable): whether some value splits the rows with filter_cnt on both sides.

    The first value with enough rows up to it leaves the most on the other side; it is among the filter_cnt smallest.
    """
    counts = stack(df, columns).groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("all"))
    by = W.partitionBy("feature").orderBy("v")
    low = counts.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= max(1, filter_cnt))  # pruned to these in each task
    low = low.withColumn("left", F.sum("n").over(by)).filter(F.col("left") >= filter_cnt)
    first = low.groupBy("feature").agg(F.min("left").alias("left"))
    return totals.join(first, "feature", "left").select("feature", F.coalesce(F.col("all") - F.col("left") >= filter_cnt, F.lit(False)).alias("usable"))


def occupancy(binned: DataFrame, columns: list[str], prefix: str = "b_") -> DataFrame:
    """(feature, bin, n, share) of binned features, in one pass."""
    cells = binned.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{prefix}{c}").alias("bin")) for c in columns])).alias("e")).select("e.*")
    counts = cells.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("feature")))  # at most max_bin rows each


class Bins:
    """Edges of all features, fitted once and small: at most max_bin numbers for each. Categorical features have their
    levels instead, by code; the codes go by ascending category, and missing and unseen values are -1."""

    def __init__(self, edges: dict[str, list[float]], missing: dict[str, int | None], levels: dict[str, list] | None = None):
        self.edges, self.missing, self.levels = edges, missing, levels or {}

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], max_bin: int = 255, min_data_in_bin: int = 3, use_missing: bool = True, categorical: list[str] = ()) -> "Bins":
        levels = {c: [r["category"] for r in categories(df, c, max_bin).orderBy("code").collect()] for c in categorical}
        numeric = [c for c in columns if c not in levels]
        edges: dict[str, list[float]] = {c: [] for c in numeric}
        if not numeric:
            return cls(edges, {}, levels)
        for r in quantile_edges(df, numeric, max_bin, min_data_in_bin, use_missing).collect():
            edges[r["feature"]].append(r["edge"])
        holes = df.agg(*[F.max((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int")).alias(c) for c in numeric]).first()
        edges = {c: sorted(set(e)) for c, e in edges.items()}
        return cls(edges, {c: len(edges[c]) + 1 if use_missing and holes[c] else None for c in numeric}, levels)

    def size(self) -> int:
        """Bins of all features together."""
        return sum(len(e) + 2 for e in self.edges.values()) + sum(len(v) + 1 for v in self.levels.values())

    def binned(self, df: DataFrame, keep: list[str], prefix: str = "b_") -> DataFrame:
        """The binned features and the columns to keep. Many edges are searched in Arrow batches, a few in the plan."""
        if self.size() <= 512:
            return self.transform(df, prefix).select(*[f"{prefix}{c}" for c in [*self.edges, *self.levels]], *keep)
        import numpy as np
        import pyarrow as pa

        levels = [f"{prefix}{c}" for c in self.levels]
        rows = Bins({}, {}, self.levels).transform(df, prefix) if self.levels else df
        rows = rows.select(*[F.col(c).cast("double").alias(f"{prefix}{c}") for c in self.edges], *levels, *keep)
        edges = [np.array(e) for e in self.edges.values()]
        gone = [bisect_left(e, 0.0) if self.missing[c] is None else self.missing[c] for c, e in self.edges.items()]
        schema = ", ".join([*(f"`{prefix}{c}` int" for c in self.edges), *(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[len(edges) :])])

        def search(batches):
            for batch in batches:
                columns = []
                for k, (e, lost) in enumerate(zip(edges, gone)):
                    v = batch.column(k).to_numpy(zero_copy_only=False)
                    columns.append(pa.array(np.where(np.isnan(v), lost, np.searchsorted(e, v)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*columns, *batch.columns[len(edges) :]], names=batch.schema.names)

        return rows.mapInArrow(search, schema)

    def transform(self, df: DataFrame, prefix: str = "b_") -> DataFrame:
        made = {f"{prefix}{c}": bin_column(F.col(c).cast("double"), e, self.missing[c]) for c, e in self.edges.items()}
        for c, known in self.levels.items():
            code = F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(known) for x in (v, i)]), F.col(c)) if known else F.lit(None)
            made[f"{prefix}{c}"] = F.coalesce(code.cast("int"), F.lit(-1))
        return df.withColumns(made)
