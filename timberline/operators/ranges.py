"""Running sums and exact percentiles over sorted data, by ranges: no task sees more than its range.

A table is dealt into ranges of its order; each range has its totals (a row per range and group), and their running sums
are the offsets from which the windows inside the ranges go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans.storage import cut


def place(df: DataFrame, order: list, parts: int | None = None) -> DataFrame:
    """The table in ranges of `order`, with the range's number in __p; written once, so that the ranges are fixed."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))


def running(placed: DataFrame, sums: dict[str, Column], group: list[str], order: list) -> DataFrame:
    """Add, for every name in `sums`, the sum of its column over all earlier rows of the group."""
    own = {f"__v{k}": c for k, c in enumerate(sums.values())}
    rows = placed.withColumns(own)
    totals = rows.groupBy(*group, "__p").agg(*[F.sum(c).alias(f"{c}t") for c in own])
    by = W.partitionBy(*(group or [F.lit(0)])).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # a row per range and group
    zero = F.lit(0)
    offsets = totals.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__p").alias("__pq"), *[F.coalesce(F.sum(f"{c}t").over(by), zero).alias(f"{c}o") for c in own])
    on = F.col("__p") == F.col("__pq")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inner = W.partitionBy(*group, "__p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = rows.join(F.broadcast(offsets), on)  # a row per range and group
    out = out.withColumns({name: F.col(f"{c}o") + F.coalesce(F.sum(c).over(inner), zero) for name, c in zip(sums, own)})
    return out.drop("__pq", *[f"__g{i}" for i in range(len(group))], *own, *[f"{c}o" for c in own])


def neighbours(placed: DataFrame, value: str, group: list[str], order: list, before: str | None = None, after: str | None = None) -> DataFrame:
    """Add the value of the row before or after, across ranges; null at the group's ends."""
    key = F.struct(*order)
    ends = placed.groupBy(*group, "__p").agg(F.min_by(value, key).alias("__first"), F.max_by(value, key).alias("__last"))
    by = W.partitionBy(*(group or [F.lit(0)])).orderBy("__p")  # a row per range and group
    ends = ends.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__p").alias("__pq"), F.lag("__last").over(by).alias("__prior"), F.lead("__first").over(by).alias("__then"))
    on = F.col("__p") == F.col("__pq")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inner = W.partitionBy(*group, "__p").orderBy(*order)
    out = placed.join(F.broadcast(ends), on)  # a row per range and group
    if before:
        out = out.withColumn(before, F.coalesce(F.lag(value).over(inner), "__prior"))
    if after:
        out = out.withColumn(after, F.coalesce(F.lead(value).over(inner), "__then"))
    return out.drop("__pq", "__prior", "__then", *[f"__g{i}" for i in range(len(group))])


def percentile(df: DataFrame, value: Column, alpha: float, weight: Column | None = None, group: list[str] = ()) -> DataFrame:
    """(group, value): the percentile of every group. Null and NaN values don't count.

    Without weights it lies at position (n - 1) * alpha of the sorted values, between two of them by linear interpolation.
    With weights it is found where the running weight first exceeds alpha of the total: the value there if it is the first
    or last row, else the one before it, moved towards it in proportion if the row weighs at least 1. Rows of one value
    are ordered by weight.
    """
    group = list(group)
    v = value.cast("double")
    rows = df.select(*group, v.alias("__x"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("__w"))
    rows = rows.filter(F.col("__x").isNotNull() & ~F.isnan("__x"))
    blocks = rows.groupBy(*group, "__x", "__w").agg(F.count(F.lit(1)).alias("__n"))
    order = ["__x", "__w"]
    placed = place(blocks, [*group, *order])
    if weight is None:
        run = neighbours(running(placed, {"__b": F.col("__n")}, group, order), "__x", group, order, after="__next")
        totals = placed.groupBy(*group).agg(F.sum("__n").alias("__all"))
        run = with_totals(run, totals, group)
        at = (F.col("__all") - 1) * F.lit(float(alpha))
        low = F.floor(at)
        here = run.filter((F.col("__b") <= low) & (low < F.col("__b") + F.col("__n")))
        upper = F.when(low + 1 < F.col("__b") + F.col("__n"), F.col("__x")).otherwise(F.coalesce("__next", "__x"))
        return here.select(*group, (F.col("__x") + (upper - F.col("__x")) * (at - low)).alias("value"))
    run = running(placed, {"__b": F.col("__n"), "__c": F.col("__w") * F.col("__n")}, group, order)
    run = neighbours(run, "__x", group, order, before="__prev")
    totals = placed.groupBy(*group).agg(F.sum("__n").alias("__all"), F.sum(F.col("__w") * F.col("__n")).alias("__sum"), F.max(F.struct(*order))["__x"].alias("__top"))
    run = with_totals(run, totals, group)
    goal = F.col("__sum") * F.lit(float(alpha))
    ahead = goal - F.col("__c")
    # the first row whose running weight exceeds the goal lies in this block, as its k-th row
    crosses = run.filter((F.col("__w") > 0) & (ahead >= 0) & (ahead < F.col("__w") * F.col("__n")))
    k = F.floor(ahead / F.col("__w"))
    first, last = (F.col("__b") + k) == 0, (F.col("__b") + k) >= F.col("__all") - 1
    moved = F.col("__prev") + ahead / F.col("__w") * (F.col("__x") - F.col("__prev"))
    inside = F.when(F.col("__w") >= 1, moved).otherwise(F.col("__prev"))
    found = crosses.select(*group, F.when(first | last | (k > 0), F.col("__x")).otherwise(inside).alias("__found"))
    # rounding or alpha 1 may leave no row beyond the goal: then it is the last one
    out = totals.select(*[F.col(g).alias(f"__k{i}") for i, g in enumerate(group)], "__top")
    if not group:
        found = found.agg(F.min("__found").alias("__found"))
        return out.crossJoin(found).select(F.coalesce("__found", "__top").alias("value"))  # two rows
    found = found.groupBy(*group).agg(F.min("__found").alias("__found"))
    on = F.lit(True)
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__k{i}"))
    return out.join(found, on, "left").select(*[F.col(f"__k{i}").alias(g) for i, g in enumerate(group)], F.coalesce("__found", "__top").alias("value"))


def with_totals(rows: DataFrame, totals: DataFrame, group: list[str]) -> DataFrame:
    """Join the totals of each group, a row per group."""
    if not group:
        return rows.crossJoin(F.broadcast(totals))
    on = F.lit(True)
    for i, g in enumerate(group):
        totals = totals.withColumnRenamed(g, f"__k{i}")
        on = on & F.col(g).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(F.broadcast(totals), on).drop(*[f"__k{i}" for i in range(len(group))])
