"""Near-duplicate embeddings by cross-polytope hashing.

Vectors are rotated by rounds of sign flips and fast Hadamard transforms; the signed axis closest to the rotated
vector is its hash, and `width` hashes make a bucket of a table. Every vector also enters the next-best buckets of each
table (multiprobe). The width grows with the logarithm of the number of vectors, so that buckets stay small, and the
number of tables with it, so that a pair at the threshold is missed with a chance of `MISS` at most. Ids alone are
dealt to buckets; only buckets that hold two vectors or more get the vectors, in single or double precision as they
came. Pairs that meet in a bucket are verified by cosine in double precision; a pair counts only in the first bucket in
which it meets, so links can be counted without listing them. Large buckets are cut into blocks, and pairs of blocks are
compared in tasks of their own.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import materialise, partitions, released
from .components import components

PROBES, COSINE, MOST = 4, 0.93, 1024
#: The chance that a pair at the threshold meets in no bucket, and buckets for each vector of the largest label.
MISS, ROOM = 0.001, 64
#: Pairs that are compared at once.
PAIRS = 50_000


@functools.lru_cache(256)
def signs(wide: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (3, wide))


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform over a power-of-two width."""
    n, d = x.shape
    wide = 1 << max(1, (d - 1).bit_length())
    y = np.zeros((n, wide))
    y[:, :d] = x
    for sign in signs(wide, seed):
        y *= sign
        h = 1
        while h < wide:
            y = y.reshape(n, wide // (2 * h), 2, h)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, wide)
            h *= 2
        y /= np.sqrt(wide)
    return y


def buckets(x: np.ndarray, width: int, tables: int, probes: int = PROBES) -> np.ndarray:
    """(vectors, tables, probes) bucket numbers, the best first. Probes swap the axes whose change costs least.

    Numbers are folded to 32 bits; two buckets that fold to one number are one bucket.
    """
    n = len(x)
    out = np.zeros((n, tables, probes), np.int32)
    for t in range(tables):
        total = code = None
        for w in range(width):
            y = rotate(x, 1000 * t + w)
            both = np.concatenate([y, -y], 1)
            top = min(probes, both.shape[1])
            axis = np.argpartition(-both, top - 1, axis=1)[:, :top]
            value = np.take_along_axis(both, axis, 1)
            order = np.argsort(-value, axis=1, kind="stable")
            axis, value = np.take_along_axis(axis, order, 1).astype(np.uint64), np.take_along_axis(value, order, 1)
            cost = value[:, :1] - value
            if code is None:
                total, code = cost, axis
            else:  # of all choices of axes only the cheapest go on
                total = (total[:, :, None] + cost[:, None, :]).reshape(n, -1)
                code = (code[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + axis[:, None, :] + np.uint64(1)).reshape(n, -1)
                best = np.argsort(total, axis=1, kind="stable")[:, :probes]
                total, code = np.take_along_axis(total, best, 1), np.take_along_axis(code, best, 1)
        folded = ((code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        out[:, t, : folded.shape[1]] = folded
        out[:, t, folded.shape[1] :] = folded[:, :1]
    return out


@functools.lru_cache(64)
def plan(n: int, dim: int, cosine: float = COSINE, probes: int = PROBES, miss: float = MISS, room: int = ROOM) -> tuple[int, int]:
    """(width, tables) for n vectors: `room` buckets a vector, and tables by the measured chance that 2,000 pairs at the
    threshold meet in one."""
    wide = 1 << max(1, (dim - 1).bit_length())
    width = max(1, math.ceil(math.log(max(2, room * n), 2 * wide)))
    draw = np.random.default_rng(dim)
    a = draw.normal(size=(2000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = draw.normal(size=(2000, dim))
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    b = cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * b
    met = (buckets(a, width, 1, probes)[:, 0, :, None] == buckets(b, width, 1, probes)[:, 0, None, :]).any((1, 2)).mean()
    return width, max(1, math.ceil(math.log(miss) / math.log(1 - min(0.999, max(0.05, met)))))


def close(x: np.ndarray, size: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i < j) of rows of one group with a cosine of `cosine` at least; groups of `size` rows follow each other."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    norm = np.linalg.norm(x, axis=1)
    start = np.r_[0, np.cumsum(size)]
    left, right = [], []
    small = np.repeat(size <= 64, size)
    after = np.where(small, np.repeat(start[1:], size) - np.arange(len(x)) - 1, 0)
    upto = np.r_[0, np.cumsum(after)]
    at = 0
    while at < len(x):  # small groups: their pairs in one go
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, side="right")) - 1)
        i = np.repeat(np.arange(at, stop), after[at:stop])
        j = i + 1 + np.arange(len(i)) - (upto[i] - upto[at])
        left.append(i), right.append(j)
        at = stop
    for g in np.flatnonzero(size > 64):
        for at in range(start[g], start[g + 1], 512):
            i, j = np.nonzero(unit[at : min(at + 512, start[g + 1])] @ unit[start[g] : start[g + 1]].T >= cosine - 1e-9)
            i, j = i + at, j + start[g]
            left.append(i[i < j]), right.append(j[i < j])
    found = []
    for i, j in zip(left, right):
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            ok = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= cosine
            found.append((a[ok], b[ok]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def first_met(i: np.ndarray, j: np.ndarray, table: np.ndarray, bucket: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Whether a pair meets in no table before `table` and in no smaller bucket of it."""
    new = np.ones(len(i), bool)
    for at in range(0, len(i), PAIRS):
        a, b = i[at : at + PAIRS], j[at : at + PAIRS]
        for t in range(int(table[a].max()) + 1 if len(a) else 0):
            met = sig[a, t][:, :, None] == sig[b, t][:, None, :]
            met &= ((table[a] > t)[:, None] | (table[a] == t)[:, None] & (sig[a, t] < bucket[a][:, None]))[:, :, None]
            new[at : at + PAIRS] &= ~met.any((1, 2))
    return new


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows, the smallest row that it is connected with by the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


LINKS = "a bigint, b bigint, n bigint"


def pack(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, embedding) with the vector's bytes, null where it can't link."""
    for whole in released(batches):
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            lists = batch.column(2)
            size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            value = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), kind) + 0  # no negative zero
            edge = np.r_[0, np.cumsum(size)]
            bad, full = (np.r_[0, np.cumsum(v)] for v in (~np.isfinite(value), value != 0))
            ok = (np.diff(bad[edge]) == 0) & (np.diff(full[edge]) > 0)
            ok &= batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            vec = [value[a:b].tobytes() if k else None for a, b, k in zip(edge[:-1].tolist(), edge[1:].tolist(), ok.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vec, pa.binary())], names=["vec_id", "label", "vec"])


def dedup(vectors: DataFrame, cosine: float = COSINE, probes: int = PROBES, most: int = MOST, miss: float = MISS, room: int = ROOM) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept.

    Vectors with a null vec_id or label, null, empty or zero vectors and those with null or non-finite components
    link with nothing (component_id is their own vec_id). Vectors of different length do not link. Equal vectors of
    a label form one class that travels once; repeated rows count as vectors of their own, and rows that share a
    vec_id but not the vector are classes of their own. An empty table gives an empty result; other columns don't matter.
    """
    spark = vectors.sparkSession
    single = isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    kind, wide = ("f4", "float") if single else ("f8", "double")
    label = vectors.schema["label"].dataType.simpleString()
    cells = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col("embedding").cast(f"array<{wide}>").alias("embedding"))
    rows = cells.mapInArrow(lambda batches: pack(batches, kind), f"vec_id bigint, label {label}, vec binary").withColumn("c", F.md5("vec"))
    rows = materialise(rows, "vectors")
    classes = rows.filter("c IS NOT NULL").groupBy("label", "c").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("many"), F.first("vec").alias("vec"))
    classes = classes.withColumn("id", F.monotonically_increasing_id()).withColumn("d", (F.octet_length("vec") / np.dtype(kind).itemsize).cast("int"))
    classes = materialise(classes, "classes")  # from here on the ids are fixed
    shapes = {r["d"]: r["n"] for r in classes.groupBy("label", "d").count().groupBy("d").agg(F.max("count").alias("n")).collect()}  # a row per length
    plans = {d: plan(1 << max(0, n - 1).bit_length(), d, cosine, probes, miss, room) for d, n in shapes.items()}
    tables = max((t for _, t in plans.values()), default=1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in released(batches):
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                size, vec = batch.column(1).to_numpy(), batch.column(2).to_pylist()
                sig: list = [None] * len(vec)
                for d in np.unique(size).tolist():
                    pick = np.flatnonzero(size == d)
                    x = np.frombuffer(b"".join([vec[k] for k in pick]), kind).reshape(len(pick), d).astype(float)
                    own = buckets(x / np.abs(x).max(1, keepdims=True), *plans[d], probes)
                    for k, s in zip(pick.tolist(), own.reshape(len(pick), -1)):
                        sig[k] = s
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig, pa.list_(pa.int32()))], names=["id", "sig"])

    signed = materialise(classes.select("id", "d", "vec").mapInArrow(sign, "id bigint, sig array<int>").join(classes.select("id", "label", "d", "many", "vec"), "id"), "signed")
    key = F.array_distinct(F.transform("sig", lambda b, p: F.struct(F.floor(p / probes).cast("int").alias("t"), b.alias("b"))))
    keys = signed.select("id", "label", "d", F.explode(key).alias("k")).select("id", "label", "d", "k.t", "k.b")
    counts = keys.groupBy("label", "d", "t", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keys = keys.join(counts, ["label", "d", "t", "b"]).withColumn("k", F.ceil(F.col("n") / most).cast("int"))
    keys = keys.withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    keys = keys.select("id", "t", "b", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    by = ["label", "d", "t", "b", "i", "j"]
    placed = keys.join(signed, "id").select(*by, "own", "id", "many", "vec", F.slice("sig", 1, (F.col("t") + 1) * probes).alias("sig"))
    placed = placed.repartition(partitions(spark), *by).sortWithinPartitions(*by)

    def settle(rows: pa.RecordBatch, edge: np.ndarray) -> pa.RecordBatch:
        """Links of whole groups, which begin at `edge`: (class, linked copies) and, for each class, one it is linked with."""
        size = np.diff(np.r_[edge, rows.num_rows])
        t, b, i, j, own, ids = (rows.column(k).to_numpy() for k in (2, 3, 4, 5, 6, 7))
        many = rows.column(8).to_numpy().astype(float)
        dims, vec = rows.column(1).to_numpy(), rows.column(9)
        lists = rows.column(10)
        length = pc.list_value_length(lists).to_numpy().astype(np.int64)
        sig = np.zeros((len(ids), int(length.max())), np.int32)
        sig[np.arange(sig.shape[1])[None, :] < length[:, None]] = lists.flatten().to_numpy()
        sig = sig.reshape(len(ids), -1, probes)
        out: dict[str, list] = {"a": [], "b": [], "n": []}
        for d in np.unique(dims).tolist():  # groups of one length are compared together
            part = np.flatnonzero(dims == d)
            x = np.frombuffer(b"".join(vec.take(pa.array(part)).to_pylist()), kind).reshape(len(part), d).astype(float)
            x /= np.abs(x).max(1, keepdims=True)
            p, q = close(x, size[dims[edge] == d], cosine)
            p, q = part[p], part[q]
            ok = (own[p] != own[q]) | (i[p] == j[p])
            p, q = p[ok], q[ok]
            ok = first_met(p, q, t, b, sig)
            p, q = p[ok], q[ok]
            n = np.bincount(p, many[q], len(ids)) + np.bincount(q, many[p], len(ids))
            root = stars(len(ids), p, q)
            hit, hung = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(ids)))
            out["a"] += [*ids[hit].tolist(), *ids[hung].tolist()]
            out["b"] += [*[None] * len(hit), *ids[root[hung]].tolist()]
            out["n"] += [*n[hit].astype(np.int64).tolist(), *[0] * len(hung)]
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for whole in released(batches):
            for at in range(0, whole.num_rows, 2000):
                part = whole.slice(at, 2000)
                held = part if held is None else pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                edge = edges_of(held)
                if len(edge) > 1 and edge[-1]:  # the last group may go on
                    yield settle(held.slice(0, int(edge[-1])), edge[:-1])
                    held = held.slice(int(edge[-1]))
        if held is not None and held.num_rows:
            yield settle(held, edges_of(held))

    found = materialise(placed.mapInArrow(verify, LINKS), "links")
    linked = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = materialise(components(found.filter("b IS NOT NULL").select("a", "b")), "roots").select(F.col("node").alias("id"), "root")
    least = roots.join(classes.select("id", "low"), "id").groupBy("root").agg(F.min("low").alias("component"))
    roots = roots.join(least, "root").select("id", "component")
    known = classes.select("id", "label", "c", "many", "low").join(linked, "id", "left").join(roots, "id", "left")
    known = known.select("label", "c", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "low").alias("component_id"))
    out = rows.select("vec_id", "label", "c").join(known, ["label", "c"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def edges_of(rows: pa.RecordBatch) -> np.ndarray:
    """Where the groups of rows sorted by the first six columns begin."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for k in range(6):
        c = rows.column(k)
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, max(0, rows.num_rows - 1))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def oracle(cosine: float = COSINE) -> str:
    """The same in DuckDB SQL, by comparing all pairs of a label."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {cosine}),
r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.a WHERE r.c < p.b),
n AS (SELECT a, count(*) AS n FROM p GROUP BY 1), m AS (SELECT a, min(c) AS c FROM r GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id)::BIGINT AS component_id, coalesce(vec_id = coalesce(c, vec_id), false) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""
