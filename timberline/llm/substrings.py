"""Removal of word windows that repeat across documents, by super-k-mer partitioning.

A window is `WINDOW` consecutive words. Its minimiser is the run of `MINIMISER` words in it with the least hash.
Consecutive windows that share a minimiser travel as one packed string to the minimiser's bucket, where windows are
sorted and the smallest doc_id of each is found. A window that stands in two documents has a minimiser that does, so a
Bloom filter of repeated minimisers holds back all other strings; its false positives only add traffic. Equal strings
are reduced to their smallest and largest doc_id before they are shuffled, so a bucket holds different strings only.
Buckets of more than `CROWD` bytes are split by window: their windows are dealt by their own hashes, and the smallest
doc_id of each is found by an aggregation with map-side combine. Either way a string gets back runs of its windows with
the smallest doc_id of each run.

Strings and windows are told apart by two independent 64-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, released, slices
from .kernel import WORD_BASE, mix, spans, window_hashes, word_hashes, words

U = np.uint64
WINDOW, MINIMISER = 50, 10
#: Bits of the filter of repeated minimisers: so many for each of them, up to 32 MB in all. Beyond some 40 million
#: repeated minimisers the filter holds back fewer strings; results stay the same.
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Bytes of different strings in a bucket that are sorted in one place; larger buckets are split by window.
CROWD = 1 << 20
#: Bytes of packed strings that are sorted at once, several buckets together.
SORTED_BYTES = 1 << 18


def runs(word: np.ndarray, first: np.ndarray):
    """(start, windows, minimiser, doc) of every super-k-mer: runs of windows with one minimiser in one text."""
    n = len(word) - WINDOW + 1
    if n <= 0:
        return [np.zeros(0, np.int64)] * 2 + [np.zeros(0, U), np.zeros(0, np.int64)]
    # grams may cross texts; windows that do are left out below, so their minimisers don't count
    gram = window_hashes(word, MINIMISER)
    wide = WINDOW - MINIMISER + 1
    least = gram
    have = 1
    while have < wide:  # sliding minimum by doubling
        step = min(have, wide - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    doc = np.searchsorted(first, np.arange(n), side="right") - 1
    ok = np.arange(n) + WINDOW <= first[doc + 1]
    begin = ok & np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | ~ok[:-1]]
    start = np.flatnonzero(begin)
    stop = np.r_[begin[1:] | ~ok[1:], True] & ok
    return start, np.flatnonzero(stop) - start + 1, least[start], doc[start]


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(h & U(bits - 1)).astype(np.int64), (mix(h) & U(bits - 1)).astype(np.int64)]


def scan(docs: DataFrame, schema: str, make) -> DataFrame:
    """Apply `make(doc_id array, raw, word starts, word ends, word hashes, first word, text key)` to slices of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in released(batches):
            for batch in slices(whole, "text"):
                raw, start, end, first = words(batch.column(2))
                ids = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
                out = make(ids[0], raw, start, end, word_hashes(raw, start, end), first, ids[1])
                if out is not None and out.num_rows:
                    yield out

    return keyed(docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())).mapInArrow(run, schema)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): the key tells rows with one doc_id apart by their texts."""
    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text")


def repeated(docs: DataFrame, most_bits: int) -> np.ndarray:
    """The Bloom filter, in bytes, of minimisers that stand in two documents or more."""

    def minimisers(doc, raw, start, end, word, first, key):
        _, _, least, owner = runs(word, first)
        if not len(least):
            return None
        h = least.view(np.int64)
        order = np.lexsort((doc[owner], h))
        h, d = h[order], doc[owner][order]
        cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(h[cut]), pa.array(d[cut]), pa.array(d[np.r_[cut[1:], len(h)] - 1])], names=["m", "low", "high"])

    known = scan(docs, "m bigint, low bigint, high bigint", minimisers).groupBy("m").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    known = materialise(known.filter("low < high").select("m"), "minimisers")
    bits = 1 << 10
    while bits < min(most_bits, BITS_EACH * known.count()):
        bits *= 2
    page = min(bits // 8, 1 << 16)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.zeros((bits // 8 // page, page), np.uint8)
        for b in batches:
            for p in probes(b.column(0).to_numpy().view(U), bits):
                np.bitwise_or.at(used.reshape(-1), p >> 3, np.uint8(128) >> (p & 7).astype(np.uint8))
        for k in np.flatnonzero(used.any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(k)]), pa.array([used[k].tobytes()], pa.binary())], names=["i", "bits"])

    packed = np.zeros((bits // 8 // page, page), np.uint8)
    for r in known.coalesce(max(1, min(16, bits >> 22))).mapInArrow(fill, "i bigint, bits binary").toLocalIterator():
        packed[r["i"]] |= np.frombuffer(r["bits"], np.uint8)
    return packed.reshape(-1)


def member(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each minimiser is, or by a false positive seems, repeated."""
    out = np.ones(len(h), bool)
    for p in probes(h, 8 * len(known)):
        out &= (known[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def text_of(raw: np.ndarray, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """The words a .. b-1 of each string, joined by one space."""
    buffer = raw.tobytes()
    s, e = start.tolist(), end.tolist()
    return pa.array([b" ".join([buffer[s[k] : e[k]] for k in range(x, y)]) for x, y in zip(a.tolist(), b.tolist())], pa.binary()).cast(pa.string())


def travelling(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(bucket, id, id2, doc_id, key, start, packed): the strings whose minimiser may repeat."""
    known = docs.sparkSession.sparkContext.broadcast(repeated(docs, most_bits))

    def pack(doc, raw, start, end, word, first, key):
        at, n, least, owner = runs(word, first)
        keep = member(known.value, least)
        at, n, least, owner = at[keep], n[keep], least[keep], owner[keep]
        if not len(at):
            return None
        stop = at + n + WINDOW - 1
        ids = [spans(word_hashes(raw, start, end, w) if w else word, WORD_BASE[w], at, stop).view(np.int64) for w in (0, 1)]
        columns = [least.view(np.int64), *ids, doc[owner].astype(np.int64), key[owner].astype(np.int64), (at - first[owner]).astype(np.int32)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), text_of(raw, start, end, at, stop)], names=["bucket", "id", "id2", "doc_id", "key", "start", "packed"])

    strings = materialise(scan(docs, "bucket bigint, id bigint, id2 bigint, doc_id bigint, key bigint, start int, packed string", pack), "superkmers")
    known.destroy()
    return strings


def window_keys(text: pa.Array):
    """(string, window in it, hash, second hash) of every window of packed strings."""
    raw, start, end, first = words(text)
    n = np.maximum(np.diff(first) - WINDOW + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = inner + first[:-1][row]
    return row, inner, *[spans(word_hashes(raw, start, end, w), WORD_BASE[w], at, at + WINDOW) for w in (0, 1)]


SETTLED = "id bigint, id2 bigint, runs array<struct<at:int,n:int,low:bigint>>"
RUN = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("low", pa.int64())])


def settle(group: list[pa.RecordBatch]) -> pa.RecordBatch | None:
    """The runs of windows of whole buckets that stand in a document smaller than the largest one of their string.

    Rows are (bucket, id, id2, packed, low, high); windows of all strings are sorted, and the smallest low of each goes
    to all that are equal.
    """
    whole = pa.Table.from_batches(group).combine_chunks().to_batches()[0]
    row, inner, key, second = window_keys(whole.column(3))
    low, high = whole.column(4).to_numpy(), whole.column(5).to_numpy()
    order = np.lexsort((low[row], second, key))
    a, b = key[order], second[order]
    begin = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    least = np.empty(len(row), np.int64)
    least[order] = low[row][order][np.maximum.accumulate(np.where(begin, np.arange(len(row)), 0))]
    hit = least < high[row]
    row, inner, least = row[hit], inner[hit], least[hit]
    if not len(row):
        return None
    edge = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (inner[1:] != inner[:-1] + 1) | (least[1:] != least[:-1])])
    n = np.diff(np.r_[edge, len(row)])
    row, inner, least = row[edge], inner[edge], least[edge]
    owner = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    run = pa.StructArray.from_arrays([pa.array(inner.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(least)], fields=list(RUN))
    lists = pa.ListArray.from_arrays(pa.array(np.r_[owner, len(row)].astype(np.int32)), run)
    picked = pa.array(row[owner])
    return pa.RecordBatch.from_arrays([whole.column(1).take(picked), whole.column(2).take(picked), lists], names=["id", "id2", "runs"])


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settle rows sorted by bucket, some `SORTED_BYTES` at a time, cut where a bucket ends."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for whole in released(batches):
        for part in slices(whole, "packed", SORTED_BYTES):
            bucket = part.column(0).to_numpy()
            if size >= SORTED_BYTES:
                edge = np.flatnonzero(np.r_[bucket[0] != last, bucket[1:] != bucket[:-1]])
                if len(edge):
                    if edge[0]:
                        held.append(part.slice(0, int(edge[0])))
                    if (out := settle(held)) is not None:
                        yield out
                    held, size, part = [], 0, part.slice(int(edge[0]))
            held.append(part)
            size, last = size + part.nbytes, bucket[-1]
    if held and (out := settle(held)) is not None:
        yield out


def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of strings (id, id2, packed, low, high), by its two hashes."""
    for whole in released(batches):
        for part in slices(whole, "packed", SORTED_BYTES):
            row, inner, key, second = window_keys(part.column(2))
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(second.view(np.int64)), part.column(0).take(row), part.column(1).take(row), pa.array(inner.astype(np.int32)), part.column(3).take(row), part.column(4).take(row)],
                names=["h", "h2", "id", "id2", "at", "low", "high"],
            )


def removable(docs: DataFrame, most_bits: int = MOST_BITS, crowd: int = CROWD) -> DataFrame:
    """(doc_id, key, runs): the runs (at, n) of windows of each text that also start in a document with a smaller doc_id."""
    spark = docs.sparkSession
    strings = travelling(docs, most_bits)
    least = strings.groupBy("id", "id2").agg(F.first("bucket").alias("bucket"), F.first("packed").alias("packed"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    least = materialise(least, "strings")
    each = least.groupBy("bucket").agg(F.sum(F.octet_length("packed")).alias("bytes"), F.min("low").alias("least"), F.max("high").alias("most"))
    each = materialise(each.filter("least < most").select("bucket", (F.col("bytes") > crowd).alias("crowded")), "buckets")
    placed = least.join(each, "bucket")
    calm = placed.filter("NOT crowded").select("bucket", "id", "id2", "packed", "low", "high")
    calm = calm.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(by_bucket, SETTLED)
    split = placed.filter("crowded").select("id", "id2", "packed", "low", "high")
    split = materialise(split.mapInArrow(windows_of, "h bigint, h2 bigint, id bigint, id2 bigint, at int, low bigint, high bigint"), "windows")
    smallest = split.groupBy("h", "h2").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least < most").select("h", "h2", "least")
    split = split.join(smallest, ["h", "h2"]).filter("least < high")
    split = split.groupBy("id", "id2").agg(F.collect_list(F.struct("at", F.lit(1).alias("n"), F.col("least").alias("low"))).alias("runs"))
    settled = calm.unionByName(split)
    met = strings.select("id", "id2", "doc_id", "key", "start").join(settled, ["id", "id2"])
    mine = F.transform(F.filter("runs", lambda r: r["low"] < F.col("doc_id")), lambda r: F.struct((F.col("start") + r["at"]).alias("at"), r["n"].alias("n")))
    met = met.select("doc_id", "key", mine.alias("runs")).filter(F.size("runs") > 0)
    return met.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def dedup(docs: DataFrame, text: bool = False, most_bits: int = MOST_BITS, crowd: int = CROWD) -> DataFrame:
    """Per document: n_words, n_removed and the SHA-256 of what is kept; with `text` all columns with the text kept.

    A null text has no words. Documents under 50 words have no window and keep all. Rows with a null doc_id neither
    lose words nor take any from others; rows with one doc_id don't take words from each other. With `text`, a text
    that loses nothing stays as it is, and a null text stays null. Other columns may have any names.
    """
    hits = removable(docs.select("doc_id", "text"), most_bits, crowd)
    columns = docs.columns
    wanted = docs.select(*columns) if text else docs.select("doc_id", "text")
    carried = wanted.columns
    own = [f"c{k}" for k in range(len(carried))]  # names of ours, whatever the table's are
    wanted = wanted.toDF(*own).withColumn("key", F.xxhash64(own[carried.index("text")]))
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key"), "runs")
    # the texts are dealt once, in small partitions, and not sorted: a partition's hits are few next to its texts
    ident = own[carried.index("doc_id")]
    wanted = wanted.repartition(4 * partitions(docs.sparkSession), ident, "key")
    joined = wanted.join(hits.hint("shuffle_hash"), (F.col(ident) == F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left").select(*own, "runs")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) if text else "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    where = carried.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in released(batches):
            for batch in slices(whole, own[where]):
                column, found = batch.column(where), batch.column(len(own))
                raw, start, end, first = words(column)
                buffer = raw.tobytes()
                total, gone, sums, texts = [], [], [], []
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    lost = np.zeros(b - a + 1, np.int64)
                    if found[i].is_valid:
                        got = found[i].values
                        at, n = (np.asarray(got.field(k).to_numpy(), np.int64) for k in (0, 1))
                        np.add.at(lost, at, 1)
                        np.add.at(lost, at + n + WINDOW - 1, -1)
                    keep = np.flatnonzero(np.cumsum(lost)[:-1] == 0) + a
                    total.append(b - a)
                    gone.append(b - a - len(keep))
                    if text and not gone[-1]:
                        texts.append(column[i].as_py())
                        continue
                    joined = b" ".join([buffer[x:y] for x, y in zip(start[keep].tolist(), end[keep].tolist())])
                    if text:
                        texts.append(joined.decode())
                    else:
                        sums.append(hashlib.sha256(joined).hexdigest())
                if text:
                    out = [pa.array(texts, pa.string()) if k == where else batch.column(k) for k in range(len(own))]
                    yield pa.RecordBatch.from_arrays(out, names=columns)
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, schema)


def oracle() -> str:
    """The same in DuckDB SQL, by grouping all windows."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(w[i + 1 : i + {WINDOW}], ' ')) AS k FROM d, range(len(w) - {WINDOW - 1}) AS t(i) WHERE doc_id IS NOT NULL),
low AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT r, i + j AS j FROM win JOIN low USING (k), range({WINDOW}) AS t(j) WHERE m < doc_id),
word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS j FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS t FROM word ANTI JOIN gone USING (r, j) GROUP BY r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)
"""
