"""Histograms: sums of derivatives and counts per (node, feature, bin)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, features: list[str], grad: str = "g", hess: str = "h", node: str | None = None, prefix: str = "b_") -> DataFrame:
    """(node, feature, bin, g, h, n) in one scan; partial aggregation leaves nodes x features x bins rows per task."""
    key = F.col(node) if node else F.lit(0)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"{prefix}{c}").alias("bin")) for i, c in enumerate(features)]))
    rows = df.select(key.alias("node"), F.col(grad).alias("__g"), F.col(hess).alias("__h"), cells.alias("c"))
    return rows.groupBy("node", F.col("c.feature").alias("feature"), F.col("c.bin").alias("bin")).agg(F.sum("__g").alias("g"), F.sum("__h").alias("h"), F.count(F.lit(1)).alias("n"))


def subtract(parent: DataFrame, child: DataFrame) -> DataFrame:
    """The sibling's histogram: parent minus child on the same (feature, bin)."""
    c = child.select("feature", "bin", F.col("g").alias("__g"), F.col("h").alias("__h"), F.col("n").alias("__n"))
    z = F.lit(0)
    out = parent.join(c, ["feature", "bin"], "left")
    return out.select("node", "feature", "bin", (F.col("g") - F.coalesce("__g", z)).alias("g"), (F.col("h") - F.coalesce("__h", z)).alias("h"), (F.col("n") - F.coalesce("__n", z)).alias("n")).filter("n > 0")


def totals(hist: DataFrame) -> DataFrame:
    """Node totals, from one feature's bins."""
    return hist.filter("feature = 0").groupBy("node").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def lattice(df: DataFrame, grad: str = "g", hess: str = "h", bits: int = 40) -> DataFrame:
    """Derivatives as integers on a power-of-two lattice, so that sums don't depend on their order."""
    top = df.agg(F.sum(F.abs(grad)).alias("g"), F.sum(F.abs(hess)).alias("h"))
    for c in ("g", "h"):
        top = top.withColumn(f"__s{c}", F.pow(F.lit(2.0), bits - F.ceil(F.log2(F.greatest(F.col(c), F.lit(1e-300)))))).drop(c)
    out = df.crossJoin(F.broadcast(top))  # one row
    return out.withColumns({"g_int": F.round(F.col(grad) * F.col("__sg")).cast("long"), "h_int": F.round(F.col(hess) * F.col("__sh")).cast("long")})


def sparse_histogram(cells: DataFrame, rows: DataFrame, defaults: DataFrame) -> DataFrame:
    """(feature, bin, g, h, n) of sparse data: stored cells (row_id, feature, bin) are summed, and what is missing from
    the totals of `rows` (row_id, g, h) goes to each feature's default bin (feature, default_bin)."""
    stored = cells.join(rows, "row_id").groupBy("feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))
    whole = rows.agg(F.sum("g").alias("__g"), F.sum("h").alias("__h"), F.count(F.lit(1)).alias("__n"))
    seen = stored.groupBy("feature").agg(*[F.sum(c).alias(f"s{c}") for c in "ghn"])
    z = F.lit(0)
    rest = defaults.join(seen, "feature", "left").crossJoin(F.broadcast(whole))  # one row
    rest = rest.select("feature", F.col("default_bin").alias("bin"), *[(F.col(f"__{c}") - F.coalesce(f"s{c}", z)).alias(c) for c in "ghn"])
    return stored.unionByName(rest).groupBy("feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"]).filter("n > 0")
