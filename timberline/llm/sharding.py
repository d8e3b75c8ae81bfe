"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless


def draws(key: Column, weights: list[float]) -> Column:
    """For each shard with a positive weight, the exponential variate that it draws from the key and its own number."""
    if not any(w > 0 for w in weights):
        raise ValueError("at least one shard needs a positive weight")
    text = F.coalesce(key.cast("string"), F.lit(""))
    drawn = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            bits = F.conv(F.substring(F.md5(F.concat(text, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
            drawn.append(F.struct((-F.log((bits + 1) / float(1 << 52)) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard")))
    return F.array(*drawn)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key: each shard draws an exponential variate from the key and its own number; the smallest wins.

    A variate is -ln(u) / weight, so a shard wins in proportion to its weight; a shard with weight 0 or less never
    does. Adding a shard changes no other shard's variate, so rows move only into the new one. Null keys count as ''.
    """
    return F.array_min(draws(key, weights))["shard"]


def shard(df: DataFrame, key: str, weights: list[float], column: str = "shard") -> DataFrame:
    """Add the shard of every row (0 .. len(weights)-1); other columns, repeated rows and empty tables pass through."""
    return df.withColumn(column, rendezvous(F.col(key), weights))


def moved_share(old: list[float], new: list[float]) -> float:
    """The least share of rows that has to move when weights change from old to new; rendezvous hashing attains it."""
    n, a, b = max(len(old), len(new)), sum(old), sum(new)
    old, new = [*old, *[0] * (n - len(old))], [*new, *[0] * (n - len(new))]
    return sum(max(0.0, y / b - x / a) for x, y in zip(old, new))


def assign(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Shard, gapless slot within the shard and shard after growth by one, for every document.

    A null text has no bytes and the CRC of the empty text; null ids are keys like any other; repeated rows share a
    shard and get a slot each.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = rows.withColumn("__d", draws(F.col("doc_id"), [1.0] * (shards + 1)))
    first, new = F.array_min(F.slice("__d", 1, shards)), F.element_at("__d", shards + 1)
    rows = rows.withColumn("shard", first["shard"]).withColumn("grown_shard", F.least(first, new)["shard"]).drop("__d")
    out = gapless(rows, "shard", ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def oracle(shards: int = 24) -> str:
    """The same in DuckDB SQL; the CRC runs over the UTF-8 bytes of the text, its table being linear over bits."""
    table = []
    for k in range(8):
        c = 1 << k
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    step = "xor(c >> 8, " + "".join(f"xor(((xor(c, b) >> {k}) & 1) * {t}, " for k, t in enumerate(table)) + "0" + ")" * 9
    draw = "(-ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || s), 1, 13))::BIGINT + 1) / 4503599627370496.0))"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, row_number() OVER () AS r FROM documents),
code AS (SELECT r, list_transform(string_split(x, ''), lambda ch: unicode(ch)::BIGINT) AS u FROM t WHERE x <> ''),
bytes AS (SELECT r, flatten(list_transform(u, lambda p: CASE WHEN p < 128 THEN [p] WHEN p < 2048 THEN [192 + (p >> 6), 128 + (p & 63)]
  WHEN p < 65536 THEN [224 + (p >> 12), 128 + ((p >> 6) & 63), 128 + (p & 63)] ELSE [240 + (p >> 18), 128 + ((p >> 12) & 63), 128 + ((p >> 6) & 63), 128 + (p & 63)] END)) AS b FROM code),
crc AS (SELECT r, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, b: {step}), 4294967295) AS crc FROM bytes),
rows AS (SELECT t.r, doc_id, (octet_length(encode(x)) + 8)::BIGINT AS size, coalesce(crc, 0)::BIGINT AS text_crc32 FROM t LEFT JOIN crc USING (r)),
draw AS (SELECT r, s, {draw} AS cost FROM rows, range({shards + 1}) AS g(s)),
place AS (SELECT r, arg_min(s, cost) FILTER (s < {shards}) AS shard, arg_min(s, cost) AS grown FROM draw GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8), doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, grown::INT AS grown_shard
FROM rows JOIN place USING (r)
"""
