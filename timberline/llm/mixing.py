"""Mixing sources to target weights by a Pfair schedule.

Time is cut into slots, and a slot takes one block (`BLOCK` consecutive documents) of one source. Block j of a source
with the share w of all weights is released at floor(j / w) and due at ceil((j + 1) / w); every slot goes to the
released block with the earliest deadline. As the shares add up to one, every block meets its window, so after any
number of slots each source that has not run out is less than one block from its target. Shares are exact fractions of
the weights asked for, and every source has blocks of its own, however many there are. The driver deals the slots in
one pass over the blocks: it holds a row per source and one per block, a `BLOCK`th of the documents. When a source has
run out, others may take its slots as they are released; no row is dropped or repeated.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless

#: Documents per block, and slots per cycle in the rounded view of the weights.
BLOCK, CYCLE = 16, 1024
#: Where no weights are given, a source weighs its number of documents to this power.
TEMPERATURE = 0.7


def named():
    """The key of a source: 's' and its name, '' for null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))


def sizes(docs: DataFrame) -> dict[str, int]:
    """Documents of every source, in the order of their keys."""
    return dict(sorted((r["g"], r["count"]) for r in docs.groupBy(named().alias("g")).count().collect()))


def exact(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in the very proportions of the weights."""
    parts = {g: float(w).as_integer_ratio() for g, w in weights.items()}
    whole = max((d for _, d in parts.values()), default=1)  # powers of two
    shares = {g: n * (whole // d) for g, (n, d) in parts.items()}
    common = math.gcd(*shares.values()) or 1
    return {g: n // common for g, n in shares.items()}


def targets(counts: dict[str, int], given: dict | None = None, power: float = TEMPERATURE) -> list[dict[str, int]]:
    """Shares of the sources that are mixed first and of those that follow them: with weights given, those without one."""
    if not given:
        return [exact({g: float(n) ** power for g, n in counts.items()})]
    if not all(0 <= v < math.inf for v in given.values()):
        raise ValueError("weights must be finite and not negative")
    asked = {"" if k is None else "s" + k: v for k, v in given.items()}
    first = {g: asked[g] for g in counts if asked.get(g, 0) > 0}
    return [exact(first), exact({g: float(n) ** power for g, n in counts.items() if g not in first})]


def deal(shares: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) by slots: the released block with the earliest deadline, then first key.

    Slots in which nothing is released are left out.
    """
    total = sum(shares.values())
    ready: list[tuple[int, str, int, int]] = []
    later = [(0, g, 0) for g in shares if shares[g] and blocks[g]]
    heapq.heapify(later)
    slot = 0
    while ready or later:
        if not ready:
            slot = max(slot, later[0][0])
        while later and later[0][0] <= slot:
            release, g, j = heapq.heappop(later)
            heapq.heappush(ready, (-(-(j + 1) * total // shares[g]), g, j, release))
        deadline, g, j, release = heapq.heappop(ready)
        yield g, j, slot, release, deadline
        slot += 1
        if j + 1 < blocks[g]:
            heapq.heappush(later, ((j + 1) * total // shares[g], g, j + 1))


def weights(docs: DataFrame, given: dict | None = None, power: float = TEMPERATURE, cycle: int = CYCLE) -> DataFrame:
    """(g, e): the targets as whole slots of one cycle, `cycle` together, by largest remainder; `mix` doesn't round."""
    shares = targets(sizes(docs), given, power)[0]
    total = sum(shares.values()) or 1
    slots = {g: cycle * n // total for g, n in shares.items()}
    for g in sorted(shares, key=lambda g: (-(cycle * shares[g] % total), g))[: cycle - sum(slots.values())]:
        slots[g] += 1
    return docs.sparkSession.createDataFrame(list(slots.items()), "g string, e int")


def schedule(slots: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """(g, k, slot, e): the slot of every source's k-th block in one cycle of whole slots."""
    e = {r["g"]: r["e"] for r in slots.collect()}
    rows = [(g, j, slot, e[g]) for g, j, slot, _, _ in deal(e, e) if slot < cycle]
    return slots.sparkSession.createDataFrame(rows, "g string, k int, slot int, e int")


def mix(docs: DataFrame, given: dict | None = None, block: int = BLOCK, key: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The key columns of every row with block (of its source), slot, release, deadline and position.

    `position` orders the mix; it grows without repeats but leaves gaps where a source has run out or ends within a
    block. Rows of a source are ordered by a hash of doc_id. A null source is a source of its own, called None in
    `given`. With given weights, sources without one (or 0) follow all others, mixed by their numbers of documents.
    Null ids are keys like any other; repeated rows take a place each. An empty table gives an empty mix.
    """
    counts = sizes(docs)
    blocks = {g: -(-n // block) for g, n in counts.items()}
    fields = ("__g", "__k", "slot", "release", "deadline")
    columns: tuple[list, ...] = ([], [], [], [], [])
    start = 0
    for shares in targets(counts, given):
        last = start
        for g, j, *times in deal(shares, blocks):
            last = start + times[0] + 1
            for column, value in zip(columns, (g, j, *(start + t for t in times))):
                column.append(value)
        start = last
    plan = pa.table([pa.array(c, pa.int64() if k else pa.string()) for k, c in enumerate(columns)], names=list(fields))
    plan = docs.sparkSession.createDataFrame(plan)
    rows = gapless(docs.select(*key).withColumn("__src", named()), "__src", [k for k in key if k != "source"], "__j")
    rows = rows.withColumn("block", F.floor(F.col("__j") / block))
    rows = rows.join(plan, (F.col("__src") == F.col("__g")) & (F.col("block") == F.col("__k")))
    return rows.select(*key, "block", "slot", "release", "deadline", (F.col("slot") * block + F.col("__j") % block).alias("position"))


def oracle(block: int = BLOCK, power: float = TEMPERATURE) -> str:
    """The same in DuckDB SQL: the slots are dealt one by one, with shares as 128-bit integers. Without weights given."""
    return f"""
WITH RECURSIVE src AS (SELECT coalesce('s' || source, '') AS g, count(*) AS n FROM documents GROUP BY 1),
share AS MATERIALIZED (SELECT list(g ORDER BY g) AS g, list((pow(n, {power}) * 4503599627370496)::HUGEINT ORDER BY g) AS w, list((n + {block - 1}) // {block} ORDER BY g) AS b FROM src),
deal(slot, turn, k) AS (
  SELECT 0::BIGINT, 0::BIGINT, list_transform(w, lambda x: 0::BIGINT) FROM share
  UNION ALL
  SELECT nxt + 1, pick, list_transform(k, lambda v, i: CASE WHEN i = pick THEN v + 1 ELSE v END) FROM (
    SELECT nxt, k, list_min(list_transform(list_filter(cand, lambda c: c.release <= nxt), lambda c: (c.deadline, c.i)))[2] AS pick FROM (
      SELECT k, cand, greatest(slot, list_min(list_transform(cand, lambda c: c.release))) AS nxt FROM (
        SELECT slot, k, list_filter(list_transform(range(1, len(w) + 1), lambda i: {{'i': i, 'live': k[i] < b[i], 'release': ((k[i] * list_sum(w)::HUGEINT) // w[i])::BIGINT, 'deadline': (((k[i] + 1) * list_sum(w)::HUGEINT + w[i] - 1) // w[i])::BIGINT}}), lambda c: c.live) AS cand
        FROM deal, share) WHERE len(cand) > 0))),
plan AS (SELECT share.g[turn] AS g, k[turn] - 1 AS block, slot - 1 AS slot, (((k[turn] - 1) * list_sum(w)::HUGEINT) // w[turn])::BIGINT AS release, ((k[turn] * list_sum(w)::HUGEINT + w[turn] - 1) // w[turn])::BIGINT AS deadline FROM deal, share WHERE turn > 0),
rows AS (SELECT doc_id, source, coalesce('s' || source, '') AS g, row_number() OVER (PARTITION BY source ORDER BY substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8), doc_id NULLS FIRST) - 1 AS j FROM documents)
SELECT doc_id, source, block::BIGINT AS block, slot::BIGINT AS slot, release::BIGINT AS release, deadline::BIGINT AS deadline, (slot * {block} + j % {block})::BIGINT AS position
FROM rows JOIN plan ON rows.g = plan.g AND block = j // {block}
"""
