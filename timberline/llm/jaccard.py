"""N-gram Jaccard join by vertical partitioning.

The distinct word shingles of all documents are one universe, cut into fragments. Every fragment sees, of every
document, the shingles that fall into it, and counts by itself how many of them any other document shares; the counts
are summed per document. A document whose sum is below the threshold's share of its set can have no partner and is
done. The others get back their shared shingles with the exact document counts, which fix the global order, rare
first; their prefixes gather candidate groups, and inside a group partial overlaps are counted fragment by fragment of
the order and summed per pair. Equal sets travel once. Copies of a text never meet in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, released, slices
from .components import components
from .kernel import mix, spans, window_hashes, word_hashes, words

U = np.uint64
SIZE, PERCENT = 5, 80
#: Documents of a candidate group that are compared in one task; larger groups are cut into blocks.
MOST = 1500
#: Shingles that a task holds before it sends them to their fragments, and parts in which a fragment is counted.
HELD, PIECES = 1 << 20, 4
#: Stands for a null doc_id inside this operator.
NOBODY = -(1 << 63)
PACKED = pa.schema([("kind", pa.int32()), ("at", pa.int32()), ("doc", pa.binary()), ("n", pa.binary()), ("k1", pa.binary()), ("k2", pa.binary()), ("h", pa.binary()), ("df", pa.binary())])
PACKED_SQL = "kind int, at int, doc binary, n binary, k1 binary, k2 binary, h binary, df binary"
SEGMENT, OWN, ALIAS = 0, 1, 2


def shingle_sets(text: pa.Array, size: int = SIZE):
    """(row, hash) of the distinct shingles of each text, sorted by both, and each row's number of shingles."""
    raw, start, end, first = words(text, lower=True)
    word = word_hashes(raw, start, end)
    n = np.diff(first)
    full = window_hashes(word, size)
    doc = np.searchsorted(first, np.arange(len(full)), side="right") - 1
    ok = np.arange(len(full)) + size <= first[doc + 1] if len(full) else np.zeros(0, bool)
    short = np.flatnonzero((n > 0) & (n < size))
    h = np.r_[full[ok], spans(word, 0xD6E8FEB86659FD93, first[short], first[short + 1])]
    row = np.r_[doc[ok], short]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
    h, row = h[new], row[new]
    return row, h, np.bincount(row, minlength=len(n))


def sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    total = np.r_[U(0), np.cumsum(values, dtype=U)]
    at = np.searchsorted(row, np.arange(rows + 1))
    return total[at[1:]] - total[at[:-1]]


def packed(kind: int, at: int, doc, n, k1=None, k2=None, h=None, df=None) -> list:
    return [kind, at, *(None if x is None else np.ascontiguousarray(x).tobytes() for x in (doc, n, k1, k2, h, df))]


def batch_of(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), PACKED)], schema=PACKED)


def cut_sets(docs: DataFrame, fragments: int) -> DataFrame:
    """Packed rows: the segment of each fragment, each document's size and set key, and copies met in the same task."""

    def dealt(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        doc, h = (np.concatenate(c) for c in zip(*held))
        part = ((h >> U(32)) * U(fragments) >> U(32)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        doc, h, edge = doc[order], h[order], np.searchsorted(part[order], np.arange(fragments + 1))
        rows = []
        for f in np.flatnonzero(np.diff(edge)):
            d = doc[edge[f] : edge[f + 1]]
            first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            rows.append(packed(SEGMENT, int(f), d[first], np.diff(np.r_[first, len(d)]).astype(np.int32), h=h[edge[f] : edge[f + 1]]))
            if len(rows) == 1000:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        turn = size = 0
        for whole in released(batches):
            for batch in slices(whole, "text"):
                ids = batch.column(0).fill_null(NOBODY).to_numpy(zero_copy_only=False).astype(np.int64)
                row, h, n = shingle_sets(batch.column(1))
                k1, k2 = sums(mix(h), row, len(ids)), sums(mix(h ^ U(0x5851F42D4C957F2D)), row, len(ids))
                rep = ids.copy()
                for i, key in enumerate(zip(k1.tolist(), k2.tolist())):
                    if n[i] and ids[i] != NOBODY:
                        rep[i] = seen.setdefault(key, int(ids[i]))
                if len(seen) > 500_000:
                    seen.clear()
                own = rep == ids
                rows = []
                turn += 1
                if (~own).any():
                    rows.append(packed(ALIAS, turn % fragments, ids[~own], n[~own].astype(np.int32), k1=rep[~own]))
                rows.append(packed(OWN, turn % fragments, ids[own], n[own].astype(np.int32), k1[own], k2[own]))
                yield batch_of(rows)
                live = (own & (ids != NOBODY))[row]
                held.append((ids[row[live]], h[live]))
                size += len(held[-1][1])
                if size >= HELD:
                    yield from dealt(held)
                    held, size = [], 0
        if size:
            yield from dealt(held)

    return docs.select("doc_id", "text").mapInArrow(run, PACKED_SQL)


def numbers(value: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(value, kind)


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each value of `at`, which follow each other."""
    held: list[dict] = []
    for batch in released(batches):
        for at in range(0, batch.num_rows, 200):
            for row in batch.slice(at, 200).to_pylist():
                if held and held[0]["at"] != row["at"]:
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def count_fragments(cut: DataFrame, parts: int, buckets: int) -> DataFrame:
    """In every fragment: document counts of its shingles; shared ones go back to the documents, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches):
            out = []
            for r in rows:
                if r["kind"] == ALIAS:
                    out.append(packed(ALIAS, r["at"] % buckets, numbers(r["doc"]), numbers(r["n"], np.int32), numbers(r["k1"])))
            segments = [r for r in rows if r["kind"] == SEGMENT]
            shared: list[tuple[np.ndarray, ...]] = []
            for piece in range(PIECES if segments else 0):  # by bits of the hash that don't choose the fragment
                doc, h = [], []
                for r in segments:
                    value = numbers(r["h"], U)
                    mine = value & U(PIECES - 1) == U(piece)
                    doc.append(np.repeat(numbers(r["doc"]), numbers(r["n"], np.int32))[mine])
                    h.append(value[mine])
                doc, h = np.concatenate(doc), np.concatenate(h)
                order = np.argsort(h, kind="stable")
                doc, h = doc[order], h[order]
                edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
                size = np.diff(np.r_[edge, len(h)])
                df = np.repeat(size, size)
                shared.append((doc[df > 1], h[df > 1], df[df > 1].astype(np.int32)))
            if shared:
                doc, h, df = (np.concatenate(c) for c in zip(*shared))
                at = (mix(doc.view(U)) % U(buckets)).astype(np.int32)
                order = np.lexsort((doc, at))
                doc, h, df, at = doc[order], h[order], df[order], at[order]
                edge = np.searchsorted(at, np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(edge)):
                    d = doc[edge[b] : edge[b + 1]]
                    first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                    out.append(packed(SEGMENT, int(b), d[first], np.diff(np.r_[first, len(d)]).astype(np.int32), h=h[edge[b] : edge[b + 1]], df=df[edge[b] : edge[b + 1]]))
            for r in rows:
                if r["kind"] == OWN:
                    doc, n, k1, k2 = numbers(r["doc"]), numbers(r["n"], np.int32), numbers(r["k1"]), numbers(r["k2"])
                    at = (mix(doc.view(U)) % U(buckets)).astype(np.int64)
                    for b in np.unique(at):
                        pick = at == b
                        out.append(packed(OWN, int(b), doc[pick], n[pick], k1[pick], k2[pick]))
            for i in range(0, len(out), 1000):
                yield batch_of(out[i : i + 1000])

    return cut.repartitionById(parts, F.pmod("at", F.lit(parts))).sortWithinPartitions("at").mapInArrow(run, PACKED_SQL)


def gather(counted: DataFrame, parts: int) -> DataFrame:
    """(doc, n, rep, k1, k2, h, df, prefix): the shared shingles in the global order, rare first, with their document counts,
    and the prefix are set where enough are shared for a partner."""
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("rep", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("h", pa.binary()), ("df", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches):
            out: list[tuple] = []
            for r in rows:
                if r["kind"] == ALIAS:
                    out += [(d, n, k, None, None, None, None, None) for d, n, k in zip(numbers(r["doc"]).tolist(), numbers(r["n"], np.int32).tolist(), numbers(r["k1"]).tolist())]
            segments = [r for r in rows if r["kind"] == SEGMENT]
            shared: dict[int, slice] = {}
            if segments:
                doc = np.concatenate([np.repeat(numbers(r["doc"]), numbers(r["n"], np.int32)) for r in segments])
                h = np.concatenate([numbers(r["h"], U) for r in segments])
                df = np.concatenate([numbers(r["df"], np.int32) for r in segments])
                order = np.lexsort((h, df, doc))
                doc, h, df = doc[order], h[order], df[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
                doc, h, df = doc[new], h[new], df[new]
                edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                shared = {d: slice(a, b) for d, a, b in zip(doc[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(doc)])}
            for r in rows:
                if r["kind"] == OWN:
                    for d, n, k1, k2 in zip(numbers(r["doc"]).tolist(), numbers(r["n"], np.int32).tolist(), numbers(r["k1"]).tolist(), numbers(r["k2"]).tolist()):
                        at = shared.get(d, slice(0, 0))
                        if d == NOBODY or d not in shared or 100 * (at.stop - at.start) < PERCENT * n:
                            out.append((d, n, d, None, None, None, None, None))
                            continue
                        mine = h[at]
                        need = -(-PERCENT * n // 100)  # a partner shares at least this many
                        prefix = mine[: max(0, len(mine) - need + 1)]  # those that no one shares come first in the order
                        out.append((d, n, d, k1, k2, mine.tobytes(), df[at].tobytes(), prefix.view(np.int64)))
            for i in range(0, len(out), 500):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out[i : i + 500]), schema)], schema=schema)

    return counted.repartitionById(parts, F.pmod("at", F.lit(parts))).sortWithinPartitions("at").mapInArrow(run, "doc bigint, n bigint, rep bigint, k1 bigint, k2 bigint, h binary, df binary, prefix array<bigint>")


def link(ids: list[int], label: list[int], n: np.ndarray, sets: list[np.ndarray], counts: list[np.ndarray], pieces: int = 4) -> dict[int, int]:
    """Unite the labels of all linked documents: {label: smallest label}.

    Each document outside the largest component is compared with all outside its own; partial overlaps are counted
    for each fragment of the global order, summed per pair, and pairs that can no longer reach the threshold are given up.
    Fragments hold equal numbers of the group's shingle places, so the first ones hold the rarest shingles.
    """
    parent = {x: x for x in label}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size = {x: 0 for x in parent}
    for x in label:
        size[x] += 1
    where = np.repeat(np.arange(len(ids)), [len(s) for s in sets])
    flat, df = np.concatenate(sets), np.concatenate(counts)
    order = np.lexsort((flat, df))  # the global order
    ordered = flat[order]
    rank = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
    code = np.empty(len(flat), np.int64)
    code[order] = rank
    values = ordered[np.r_[True, ordered[1:] != ordered[:-1]]]
    cuts = [rank[min(len(rank) - 1, len(rank) * k // pieces)] for k in range(pieces)]
    fragment = np.maximum(np.searchsorted(cuts, code, side="right") - 1, 0)
    parts = [(code[fragment == k], where[fragment == k]) for k in range(pieces)]
    left = np.stack([np.bincount(w, minlength=len(ids)) for _, w in parts], 1)
    rest = left[:, ::-1].cumsum(1)[:, ::-1]
    edges = np.r_[0, np.cumsum([len(s) for s in sets])]
    mark = np.zeros(len(values), bool)
    done = [False] * len(ids)
    while True:
        largest = max(size, key=size.get)
        todo = [i for i in range(len(ids)) if not done[i] and root(label[i]) != largest]
        if not todo:
            return {x: root(x) for x in parent}
        for i in todo:
            mine = root(label[i])
            if mine == max(size, key=size.get) if len(size) < 64 else size[mine] * 2 > len(ids):
                continue
            done[i] = True
            need = PERCENT * (n + n[i]) / (100 + PERCENT)
            open_ = np.array([root(x) != mine for x in label]) & (100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i]))
            own = code[edges[i] : edges[i + 1]]
            mark[own] = True
            total = np.zeros(len(ids))
            for k, (c, w) in enumerate(parts):
                if not open_.any():
                    break
                total += np.bincount(w[mark[c]], minlength=len(ids))
                if k + 1 < pieces:
                    open_ &= total + np.minimum(rest[:, k + 1], rest[i, k + 1]) >= need
            mark[own] = False
            for j in np.flatnonzero(open_ & (100 * total >= PERCENT * (n + n[i] - total))):
                a, b = root(label[i]), root(label[j])
                if a != b:
                    a, b = min(a, b), max(a, b)
                    parent[b] = a
                    size[a] += size.pop(b)


def verify(groups: DataFrame, parts: int) -> DataFrame:
    """Edges (a, b) between labels, from rows (g, block, doc, label, n, h, df) grouped by g and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        edges: list[tuple[int, int]] = []

        def settle() -> None:
            if len(held) > 1:
                found = link([h["doc"] for h in held], [h["label"] for h in held], np.array([h["n"] for h in held]), [numbers(h["h"], U) for h in held], [numbers(h["df"], np.int32) for h in held])
                edges.extend((x, r) for x, r in found.items() if x != r)
            held.clear()

        for batch in released(batches):
            for at in range(0, batch.num_rows, 100):
                for row in batch.slice(at, 100).to_pylist():
                    if held and (held[0]["g"], held[0]["block"]) != (row["g"], row["block"]):
                        settle()
                    held.append(row)
        settle()
        yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

    placed = groups.select("g", "block", "doc", "label", "n", "h", "df").repartition(parts, "g", "block").sortWithinPartitions("g", "block")
    return placed.mapInArrow(run, "a bigint, b bigint")


def join(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    A null or empty text has no shingles and is its own component, as is a document without a link. Rows with a null
    doc_id link with nothing and have a null component. doc_id is the identity: repeated rows share it.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    fragments = 2 * parts  # small ones: a task holds a whole fragment
    sets = materialise(gather(count_fragments(cut_sets(docs, fragments), fragments, parts), parts), "sets")
    live = sets.filter("h IS NOT NULL")
    equal = live.groupBy("k1", "k2", "n").agg(F.min("doc").alias("top"))
    tops = live.select("doc", "k1", "k2", "n").join(equal, ["k1", "k2", "n"]).select("doc", "top").distinct()
    tops = materialise(tops, "tops")
    heads = live.join(tops.filter("doc = top").select("doc"), "doc", "left_semi").dropDuplicates(["doc"])

    postings = heads.select("doc", F.explode("prefix").alias("s"))
    least = postings.groupBy("s").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high")
    coarse = components(postings.join(least, "s").select(F.col("doc").alias("a"), F.col("low").alias("b")))
    coarse = materialise(coarse.select(F.col("node").alias("doc"), F.col("root").alias("g")), "groups")

    blocks = coarse.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks"))
    members = heads.select("doc", "n", "h", "df").join(coarse.join(blocks, "g"), "doc")
    first = members.withColumn("label", F.col("doc")).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    edges = materialise(verify(first, parts), "links")
    if blocks.filter("blocks > 1").limit(1).count():  # groups in several blocks: join what the blocks left apart
        wide = materialise(first.filter("blocks > 1"), "wide")

        def labelled(known: DataFrame) -> DataFrame:
            roots = components(known)
            return wide.drop("label").join(roots.select(F.col("node").alias("doc"), F.col("root").alias("label")), "doc", "left").withColumn("label", F.coalesce("label", "doc"))

        now = labelled(edges)
        heads_only = now.filter("doc = label").withColumn("block", F.pmod(F.xxhash64("doc", F.lit(1)), F.ceil(F.col("blocks") / 8)).cast("int"))
        edges = materialise(edges.unionByName(verify(heads_only, parts)), "links")
        # the largest label of a group stays in its blocks; all other documents visit every block
        now = materialise(labelled(edges), "labels")
        each = now.groupBy("g", "label").agg(F.count(F.lit(1)).alias("c"))
        main = each.groupBy("g").agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").select("g", "main")
        visit = now.join(main, "g").withColumn("block", F.explode(F.when(F.col("label") == F.col("main"), F.array("block")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
        edges = materialise(edges.unionByName(verify(visit, parts)), "links")
        roots = components(edges)
    else:
        roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

    roots = tops.join(roots, tops["top"] == roots["node"], "left").select("doc", F.coalesce("root", "top").alias("root"))
    out = sets.select("doc", "n", "rep").join(roots.withColumnRenamed("doc", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    # a root is the smallest of the documents that were compared; only where a copy has a smaller id is there more to say
    low = out.groupBy("root").agg(F.min("doc").alias("least")).filter("least < root")
    null = F.col("doc") == F.lit(NOBODY)
    out = out.join(low, "root", "left").withColumn("component_id", F.coalesce("least", "root"))
    return out.select(F.when(~null, F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(~null, F.col("component_id")).alias("component_id"))


def oracle() -> str:
    """The same in DuckDB SQL, by counting the shared shingles of all pairs that share any."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i + 1 : i + {SIZE}], ' ')) AS h FROM d, range(greatest(1, len(w) - {SIZE - 1})) AS t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS k FROM n UNION SELECT p.b, r.k FROM r JOIN p ON p.a = r.a WHERE r.k < p.b),
m AS (SELECT a, min(k) AS k FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(k, doc_id)::BIGINT AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON a = doc_id
"""
