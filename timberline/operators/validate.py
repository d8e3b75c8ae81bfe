"""Checks that raise, each one aggregate over the data, and the per-column report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType)
#: Largest integer a double holds exactly (fixed value).
EXACT = 9007199254740992


class DataError(ValueError):
    """The data break a rule."""


def admit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Features as doubles with null for missing; strings, times, decimals and nested types are refused by name."""
    out = []
    for f in df.schema:
        if f.name not in columns:
            out.append(F.col(f.name))
        elif isinstance(f.dataType, T.NullType):
            out.append(F.lit(None).cast("double").alias(f.name))
        elif isinstance(f.dataType, NUMERIC):
            c = F.col(f.name).cast("double")
            out.append(F.when(~F.isnan(c), c).alias(f.name))
        else:
            hint = {T.StringType: "encode it as a category", T.DecimalType: "cast it to double", T.TimestampType: "use unix_micros()", T.DateType: "use unix_date()"}.get(type(f.dataType), "flatten it first")
            raise DataError(f"column {f.name} of type {f.dataType.simpleString()} is no feature; {hint}")
    longs = [f.name for f in df.schema if f.name in columns and isinstance(f.dataType, T.LongType)]
    if longs:
        over = df.agg(*[F.max(F.abs(F.col(c))).alias(c) for c in longs]).first()
        for c in longs:
            if over[c] is not None and over[c] > EXACT:
                raise DataError(f"column {c} holds integers beyond 2**53")
    return df.select(*out)


def column_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, n_rows, n_missing, n_distinct, min_value, max_value, is_constant for each column, in one pass."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("e")).select("e.*")
    v = F.when(~F.isnan("v"), F.col("v"))
    return stacked.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count(F.lit(1)) - F.count(v)).alias("n_missing"),
        F.countDistinct(v).alias("n_distinct"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        (F.countDistinct(v) <= 1).alias("is_constant"),
    )


def check_labels(df: DataFrame, label: str, objective: str = "l2", classes: int | None = None) -> None:
    """Labels are finite; binary labels are 0 or 1, positive objectives have no negative ones, classes are all there."""
    y = F.col(label).cast("double")
    bad = F.coalesce(F.isnan(y) | (F.abs(y) == float("inf")), F.lit(True))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("int")).alias("bad"), F.min(y).alias("low"), F.max(y).alias("high"), F.sum((y != F.floor(y)).cast("int")).alias("frac"), F.sum(y).alias("total")).first()
    if not r["n"]:
        raise DataError("there are no rows")
    if r["bad"]:
        raise DataError(f"{r['bad']} labels are missing or not finite")
    if objective == "binary" and (r["low"] < 0 or r["high"] > 1 or r["frac"]):
        raise DataError("binary labels are 0 and 1")
    if objective == "cross_entropy" and (r["low"] < 0 or r["high"] > 1):
        raise DataError("cross-entropy labels lie in [0, 1]")
    if objective in ("poisson", "tweedie") and (r["low"] < 0 or not r["total"]) or objective == "gamma" and r["low"] <= 0:
        raise DataError(f"{objective} needs positive labels")
    if classes is not None:
        present = df.select(label).distinct().count()
        if r["frac"] or r["low"] < 0 or r["high"] >= classes or present < classes:
            raise DataError(f"class codes must be all of 0..{classes - 1}")


def check_weights(df: DataFrame, weight: str) -> None:
    w = F.col(weight).cast("double")
    bad = F.coalesce(F.isnan(w) | (w < 0) | (w == float("inf")), F.lit(True))
    r = df.agg(F.sum(bad.cast("int")).alias("bad"), F.sum(w).alias("total")).first()
    if r["bad"] or not r["total"]:
        raise DataError("weights must be finite, not negative, and not all zero")


def check_relevance(df: DataFrame, label: str, most: int = 30) -> None:
    """Relevance labels are integers from 0 to 30."""
    r = df.agg(F.min(label).alias("low"), F.max(label).alias("high"), F.sum((F.col(label) != F.floor(label)).cast("int")).alias("frac")).first()
    if r["frac"] or (r["low"] or 0) < 0 or (r["high"] or 0) > most:
        raise DataError(f"relevance labels are integers from 0 to {most}")


def check_group_weights(df: DataFrame, group: str, weight: str) -> None:
    if df.groupBy(group).agg((F.max(weight) != F.min(weight)).alias("x")).filter("x").limit(1).count():
        raise DataError("a query's rows must share one weight")


def check_model(nodes: list[dict]) -> None:
    """A tree: one root, every other node the child of exactly one earlier split."""
    ids, child = {n["node"] for n in nodes}, [c for n in nodes if n["feature"] is not None for c in (n["left"], n["right"])]
    if sorted(child) != sorted(ids - {0}) or any(c <= n["node"] for n in nodes if n["feature"] is not None for c in (n["left"], n["right"])):
        raise DataError("the node table is no tree")


def check_shape(df: DataFrame, features: list[str]) -> int:
    """Rows, if there are any and the cells can be counted in 64 bits."""
    n = df.count()
    if not n or not features:
        raise DataError("a table needs rows and features")
    if n * len(features) >= 1 << 63:
        raise DataError("there are more cells than 64 bits can count")
    return n


def check_derivatives(df: DataFrame, grad: str, hess: str) -> None:
    """Finite gradients and hessians, none of these negative, and a positive total."""
    odd = lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True))
    r = df.agg(F.sum(odd(grad).cast("int")).alias("g"), F.sum((odd(hess) | (F.col(hess) < 0)).cast("int")).alias("h"), F.sum(hess).alias("total")).first()
    if r["g"] or r["h"]:
        raise DataError("gradients and hessians must be finite, hessians not negative")
    if not (r["total"] or 0) > 0:
        raise DataError("the hessians need a positive total")


def check_codes(df: DataFrame, column: str, size: int) -> None:
    """Category codes are integers from -1 (missing or unseen) to size - 1."""
    c = F.col(column)
    if df.filter(c.isNull() | (c != F.floor(c)) | (c < -1) | (c >= size)).limit(1).count():
        raise DataError(f"codes of {column} must be integers from -1 to {size - 1}")


def check_row_ids(df: DataFrame, row: str, start: int = 0) -> int:
    """Row ids are start, start + 1, ... without gaps or repeats; how many there are."""
    r = df.agg(F.count(row).alias("n"), F.count(F.lit(1)).alias("all"), F.min(row).alias("low"), F.max(row).alias("high"), F.countDistinct(row).alias("k")).first()
    if r["all"] and (r["n"] != r["all"] or r["k"] != r["n"] or r["low"] != start or r["high"] != start + r["n"] - 1):
        raise DataError(f"row ids must run from {start} without gaps or repeats")
    return r["all"]


def monotone_holds(tree: list[dict], signs: dict[int, int]) -> bool:
    """Whether every split on a constrained feature keeps all leaves of its two sides in order."""

    def span(i: int) -> tuple[float, float]:
        n = tree[i]
        if n["feature"] is None:
            return n["value"], n["value"]
        a, b = span(n["left"]), span(n["right"])
        return min(a[0], b[0]), max(a[1], b[1])

    for n in tree:
        sign = signs.get(n["feature"], 0) if n["feature"] is not None else 0
        if sign:
            (al, ah), (bl, bh) = span(n["left"]), span(n["right"])
            if sign > 0 and ah > bl + 1e-12 or sign < 0 and al < bh - 1e-12:
                return False
    return True
