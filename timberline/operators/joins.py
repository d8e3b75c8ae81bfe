"""Joins by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def as_of(left: DataFrame, right: DataFrame, time: str, by: str, values: list[str], right_time: str | None = None) -> DataFrame:
    """Every left row with the values of the last right row of its key at or before its time; null where there is none.

    Both sides are one table sorted by (key, time), in which the last value is carried forward: one shuffle, no join. Of
    right rows with one time, the one with the largest values counts.
    """
    own = [F.col(c).alias(f"__l{i}") for i, c in enumerate(left.columns)]
    a = left.select(F.col(by).alias("__k"), F.col(time).alias("__t"), F.lit(1).alias("__side"), F.struct(*own).alias("__row"), F.lit(None).alias("__v"))
    b = right.select(F.col(by).alias("__k"), F.col(right_time or time).alias("__t"), F.lit(0).alias("__side"), F.struct(*[F.col(v).alias(f"__v{i}") for i, v in enumerate(values)]).alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = W.partitionBy("__k").orderBy("__t", "__side", F.col("__v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("__last", F.last("__v", ignorenulls=True).over(order)).filter("__side = 1")
    return found.select(*[F.col(f"__row.__l{i}").alias(c) for i, c in enumerate(left.columns)], *[F.col(f"__last.__v{i}").alias(f"{v}_as_of") for i, v in enumerate(values)])


def in_range(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= value < high. Ranges are cut into cells of `width`, so that this is an equi-join on cells."""
    cell = lambda c: F.floor(F.col(c) / width)
    a = left.withColumn("__c", cell(value))
    b = right.filter(F.col(low) < F.col(high)).withColumn("__c", F.explode(F.sequence(cell(low), cell(high))))
    return a.join(b, "__c").filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("__c")
