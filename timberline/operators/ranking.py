"""Query groups and ranking derivatives as window functions and in-query joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.random import uniform
from .ranges import place, running


def groups(df: DataFrame, group: str) -> DataFrame:
    """(group, n, start): rows per query and where it starts when queries follow each other by id.

    Starts are a running sum over ranges of queries, offset by range totals, so no task sees all queries.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return running(place(sizes, [group]), {"start": F.col("n")}, [], [group]).select(group, "n", "start")


def query_rmse(df: DataFrame, group: str, label: str, raw: str) -> DataFrame:
    """Derivatives of the squared error after removing each query's mean residual."""
    r = F.col(raw) - F.col(label)
    return df.withColumn("grad", r - F.avg(r).over(W.partitionBy(group))).withColumn("hess", F.lit(1.0))


def pairs(df: DataFrame, group: str, label: str, key: str, columns: list[str]) -> DataFrame:
    """All pairs of a query with different labels, the higher one as the winner. Queries are bounded lists."""
    a = df.select(F.col(group).alias("__q"), F.col(key).alias("winner"), F.col(label).alias("wl"), *[F.col(c).alias(f"w_{c}") for c in columns])
    b = df.select(F.col(group).alias("__q"), F.col(key).alias("loser"), F.col(label).alias("ll"), *[F.col(c).alias(f"l_{c}") for c in columns])
    return a.join(b, "__q").filter("wl > ll")


def pair_logit(df: DataFrame, group: str, label: str, raw: str, key: str) -> DataFrame:
    """(key, grad, hess) of the pairwise logistic loss."""
    p = pairs(df, group, label, key, [raw]).withColumn("rho", 1 / (1 + F.exp(F.col(f"w_{raw}") - F.col(f"l_{raw}"))))
    h = F.col("rho") * (1 - F.col("rho"))
    both = p.select(F.explode(F.array(F.struct(F.col("winner").alias("__k"), (-F.col("rho")).alias("g"), h.alias("h")), F.struct(F.col("loser").alias("__k"), F.col("rho").alias("g"), h.alias("h")))).alias("e")).select("e.*")
    sums = both.groupBy("__k").agg(F.sum("g").alias("grad"), F.sum("h").alias("hess"))
    return df.select(F.col(key)).join(sums, F.col(key) == F.col("__k"), "left").select(key, F.coalesce("grad", F.lit(0.0)).alias("grad"), F.coalesce("hess", F.lit(0.0)).alias("hess"))


def yetirank_pairs(df: DataFrame, group: str, label: str, raw: str, key: str, permutations: int = 10, decay: float = 0.99, seed: int = 0) -> DataFrame:
    """(group, winner, loser, w): neighbours in noisy orders of a query. In each of `permutations` draws, scores get logistic
    noise and are sorted; of two neighbours with different labels the more relevant one wins 0.15 * decay**place * difference."""
    draw = uniform(F.concat_ws(":", F.col(key).cast("string"), F.col("__d").cast("string")), seed)
    noisy = F.col(raw) + F.log(F.greatest(draw, F.lit(1e-300))) - F.log(1.000001 - draw)
    rows = df.select(F.col(group).alias("__q"), F.col(key).alias("__k"), F.col(label).cast("double").alias("__l"), F.col(raw), F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("__d"), *([] if key in (group, label, raw) else [F.col(key)]))
    by = W.partitionBy("__q", "__d").orderBy(F.desc("__s"), "__k")
    rows = rows.withColumn("__s", noisy).select("__q", "__k", "__l", F.row_number().over(by).alias("__at"), F.lead("__k").over(by).alias("__k2"), F.lead("__l").over(by).alias("__l2"))
    met = rows.filter("__l2 IS NOT NULL AND __l <> __l2")
    charge = 0.15 * F.pow(F.lit(decay), F.col("__at") - 1) * F.abs(F.col("__l") - F.col("__l2"))
    first = F.col("__l") > F.col("__l2")
    met = met.select("__q", F.when(first, F.col("__k")).otherwise(F.col("__k2")).alias("winner"), F.when(first, F.col("__k2")).otherwise(F.col("__k")).alias("loser"), charge.alias("__c"))
    return met.groupBy("__q", "winner", "loser").agg((F.sum("__c") / permutations).alias("w"))


def yetirank(df: DataFrame, group: str, label: str, raw: str, key: str, permutations: int = 10, decay: float = 0.99, seed: int = 0) -> DataFrame:
    """(key, grad, hess): the pairwise logistic loss of the noisy neighbours. Pairs are as many as rows and draws at most."""
    p = yetirank_pairs(df, group, label, raw, key, permutations, decay, seed)
    score = df.select(F.col(key).alias("__n"), F.col(raw).alias("__r"))
    p = p.join(score.select(F.col("__n").alias("winner"), F.col("__r").alias("__wr")), "winner").join(score.select(F.col("__n").alias("loser"), F.col("__r").alias("__lr")), "loser")
    p = p.withColumn("__rho", 1 / (1 + F.exp(F.col("__wr") - F.col("__lr"))))
    g, h = F.col("w") * F.col("__rho"), F.col("w") * F.col("__rho") * (1 - F.col("__rho"))
    both = p.select(F.explode(F.array(F.struct(F.col("winner").alias("__k"), (-g).alias("g"), h.alias("h")), F.struct(F.col("loser").alias("__k"), g.alias("g"), h.alias("h")))).alias("e")).select("e.*")
    sums = both.groupBy("__k").agg(F.sum("g").alias("__g"), F.sum("h").alias("__h"))
    return df.select(key).join(sums, F.col(key) == F.col("__k"), "left").select(key, F.coalesce("__g", F.lit(0.0)).alias("grad"), F.coalesce("__h", F.lit(0.0)).alias("hess"))


def lambdarank(df: DataFrame, group: str, label: str, raw: str, key: str, truncation: int = 30, norm: bool = True, sigma: float = 1.0) -> DataFrame:
    """(key, grad, hess): pairwise logistic derivatives weighted by the change of NDCG, of pairs that reach into the
    first `truncation` ranks; with `norm`, a query's derivatives are scaled by log2(1 + sum) / sum.

    Only rows of the first ranks are joined with the rows behind them, so a query of n rows has truncation * n pairs.
    """
    by = W.partitionBy("__q")
    r = df.select(F.col(group).alias("__q"), F.col(key).alias("__k"), F.col(label).cast("double").alias("__l"), F.col(raw).cast("double").alias("__s"))
    gain = F.pow(F.lit(2.0), F.col("__l")) - 1
    r = r.withColumns({"__rank": F.row_number().over(by.orderBy(F.desc("__s"), "__k")), "__ideal": F.row_number().over(by.orderBy(F.desc("__l"), "__k")), "__gain": gain})
    most = F.sum(F.when(F.col("__ideal") <= truncation, F.col("__gain") / F.log2(F.col("__ideal") + 1)).otherwise(0.0)).over(by)
    r = r.withColumns({"__max": most, "__best": F.max("__s").over(by), "__worst": F.min("__s").over(by)})
    doc = F.struct(F.col("__k").alias("k"), F.col("__l").alias("l"), F.col("__s").alias("s"), F.col("__rank").alias("rank"), F.col("__gain").alias("gain"))
    top = r.filter(F.col("__rank") <= truncation).select("__q", doc.alias("x"), "__max", (F.col("__best") != F.col("__worst")).alias("__apart")).filter("__max > 0")
    p = top.join(r.select("__q", doc.alias("y")), "__q").filter("y.rank > x.rank AND x.l <> y.l")
    first = F.col("x.l") > F.col("y.l")
    p = p.select("__q", "__max", "__apart", F.when(first, F.col("x")).otherwise(F.col("y")).alias("w"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("o"))
    delta = (F.col("w.gain") - F.col("o.gain")) * F.abs(1 / F.log2(F.col("w.rank") + 1) - 1 / F.log2(F.col("o.rank") + 1)) / F.col("__max")
    if norm:
        delta = F.when(F.col("__apart"), delta / (0.01 + F.abs(F.col("w.s") - F.col("o.s")))).otherwise(delta)
    p = p.withColumns({"__rho": 1 / (1 + F.exp(sigma * (F.col("w.s") - F.col("o.s")))), "__delta": delta})
    lam, hes = sigma * F.col("__rho") * F.col("__delta"), sigma * sigma * F.col("__rho") * (1 - F.col("__rho")) * F.col("__delta")
    both = p.select("__q", F.explode(F.array(F.struct(F.col("w.k").alias("__k"), (-lam).alias("g"), hes.alias("h"), (2 * lam).alias("s")), F.struct(F.col("o.k").alias("__k"), lam.alias("g"), hes.alias("h"), F.lit(0.0).alias("s")))).alias("e")).select("__q", "e.*")
    sums = both.groupBy("__q", "__k").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("s").alias("s")).withColumn("s", F.sum("s").over(by))
    scale = F.when(F.col("s") > 0, F.log2(1 + F.col("s")) / F.col("s")).otherwise(1.0) if norm else F.lit(1.0)
    sums = sums.select("__k", (F.col("g") * scale).alias("__g"), (F.col("h") * scale).alias("__h"))
    return df.select(key).join(sums, F.col(key) == F.col("__k"), "left").select(key, F.coalesce("__g", F.lit(0.0)).alias("grad"), F.coalesce("__h", F.lit(0.0)).alias("hess"))


def cox(df: DataFrame, time: str, event: str, raw: str, key: str) -> DataFrame:
    """(key, grad, hess) of the Cox partial likelihood; times are pre-aggregated before the running sums."""
    t = df.groupBy(F.col(time).alias("__t")).agg(F.sum(F.exp(raw)).alias("__e"), F.sum((F.col(event) > 0).cast("int")).alias("__d"))
    placed = place(t, ["__t"])
    whole = placed.agg(F.sum("__e").alias("__all"))
    # the risk set of a time is all that lies at or behind it; its sums then run on over the same ranges
    risk = running(placed, {"__earlier": F.col("__e")}, [], ["__t"]).crossJoin(F.broadcast(whole)).withColumn("__risk", F.col("__all") - F.col("__earlier"))  # one row
    first, second = F.col("__d") / F.col("__risk"), F.col("__d") / (F.col("__risk") * F.col("__risk"))
    t = running(risk, {"__rk": first, "__sk": second}, [], ["__t"]).select("__t", (F.col("__rk") + first).alias("__rk"), (F.col("__sk") + second).alias("__sk"))
    e = F.exp(F.col(raw))
    out = df.join(t, df[time] == t["__t"])
    return out.select(key, (e * F.col("__rk") - (F.col(event) > 0).cast("double")).alias("grad"), (e * F.col("__rk") - e * e * F.col("__sk")).alias("hess"))
