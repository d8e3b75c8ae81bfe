"""SimHash fingerprints, their likeness, and a search within a Hamming radius by permuted block tables."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, released
from .kernel import mix, window_hashes, word_hashes, words

U = np.uint64
#: Fingerprint length; terms are runs of two and of three words, the longer ones with double weight. Texts of fewer
#: than `SHORT` words have runs of three bytes as terms.
BITS, SHORT = 256, 8
RADIUS = 7


def terms(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes of a text and their weights: the square root of the count, doubled for three words."""
    out, weight = [], []
    for size, w in ((2, 1.0), (3, 2.0)):
        h, n = np.unique(window_hashes(word, size), return_counts=True)
        out.append(h)
        weight.append(np.sqrt(n) * w)
    return np.concatenate(out), np.concatenate(weight).astype(np.float32)


def vote(h: np.ndarray, weight: np.ndarray) -> bytes:
    """Every term adds its weight to the bits set in its hash and takes it from the others; the signs are the bits."""
    total = np.zeros(BITS, np.float64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        wide = np.stack([mix(part + U(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(BITS // 64)], 1)
        bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1)
        total += 2.0 * (weight[at : at + 4096] @ bits.astype(np.float32)) - weight[at : at + 4096].sum()
    return np.packbits(total > 0).tobytes()


def fingerprints(texts: list[str]) -> list[bytes]:
    """The fingerprint of each text; equal texts have equal ones, and a text without words has all bits 0."""
    array = pa.array(texts, pa.large_string())
    raw, start, end, first = words(array, lower=True)
    word = word_hashes(raw, start, end)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= SHORT:
            out.append(vote(*terms(word[a:b])))
        else:
            letters = raw[start[a] : end[b - 1]].astype(U) + U(1) if b > a else np.zeros(0, U)
            h, n = np.unique(window_hashes(np.r_[U(0), letters, U(0)], 3) if b > a else letters, return_counts=True)
            out.append(vote(h, np.sqrt(n).astype(np.float32)))
    return out


def likeness(a: bytes, b: bytes) -> float:
    """The cosine that the Hamming distance stands for: 1 at distance 0, 0 at half of the bits and beyond."""
    return max(0.0, math.cos(math.pi * (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS))


def edited(text: str, after: str) -> str:
    """The text with its last third replaced by the beginning of the next document."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def with_next(docs: DataFrame) -> tuple[DataFrame, str]:
    """Deal the documents into ranges of descending doc_id and add the first document of the next range to each.

    Returns rows (part, doc_id, text, seam) to be sorted by (part, seam, doc_id desc), of which the seams, one per
    range, only serve as the next document of the range's last. Range bounds are quantiles of doc_id; bounds and seam
    ids are as many as ranges.
    """
    spark = docs.sparkSession
    n = 4 * partitions(spark)
    ids = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("m"))
    bounds = docs.filter(F.col("doc_id").isNotNull()).select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    bounds = sorted({int(b) for b in bounds})
    literal = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>") if bounds else None

    def part(c):  # the first range has the largest ids, the last the null ones
        low = F.size(F.filter(literal, lambda b: b < c)) if bounds else F.lit(0)
        return F.when(c.isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - low)

    heads = ids.groupBy(part(F.col("doc_id")).alias("part")).agg(F.max(F.struct("doc_id", "m")).alias("head")).orderBy("part").collect()
    rows = docs.select(part(F.col("doc_id")).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if not heads:
        return rows.withColumn("seam", F.lit(0)), "empty"
    seams = [(heads[i]["head"]["doc_id"], heads[i]["head"]["m"], heads[i - 1]["part"]) for i in range(len(heads))]
    seams = F.broadcast(spark.createDataFrame([(d, m, int(p)) for d, m, p in seams], "s bigint, sm string, target int"))  # a row per range
    extra = rows.withColumn("m", F.md5("text")).join(seams, F.col("doc_id").eqNullSafe(F.col("s")) & (F.col("m") == F.col("sm")))
    extra = extra.select(F.col("target").alias("part"), "doc_id", "text", F.lit(1).alias("seam"))
    return rows.withColumn("seam", F.lit(0)).unionByName(extra), "full"


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they and the next document are.

    Documents follow each other by descending doc_id, null ids last, those with one id by descending MD5 of the text;
    after the last comes the first. A null text is empty. A lone document is its own next.
    """
    rows, _ = with_next(docs)
    order = [F.col("part"), F.col("seam"), F.col("doc_id").desc_nulls_last(), F.md5("text").desc()]
    placed = rows.repartition(partitions(docs.sparkSession), "part").sortWithinPartitions(*order).select("part", "doc_id", "text", "seam")
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (part, doc_id, text, fingerprint) that waits for its next document
        for whole in released(batches):
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256).to_pydict()
                prints = fingerprints(batch["text"])
                pairs = []
                for p, d, t, s, f in zip(batch["part"], batch["doc_id"], batch["text"], batch["seam"], prints):
                    if held is not None and held[0] == p:
                        pairs.append((*held, t, f))
                    held = None if s else (p, d, t, f)
                changed = [edited(a[2], a[4]) for a in pairs]
                after = fingerprints(changed)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[1] for a in pairs], pa.int64()),
                        pa.array([len(a[2]) for a in pairs], pa.int64()),
                        pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
                        pa.array([a[3].hex() for a in pairs], pa.string()),
                        pa.array([f.hex() for f in after], pa.string()),
                        pa.array([likeness(a[3], f) for a, f in zip(pairs, after)], pa.float64()),
                        pa.array([likeness(a[3], a[5]) for a in pairs], pa.float64()),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return placed.mapInArrow(run, schema)


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every whole text, as hexadecimal digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in released(batches):
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                prints = [f.hex() for f in fingerprints([t or "" for t in batch.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fingerprint string")


def search(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, fingerprint, distance): all distinct fingerprints within `radius` of each distinct query fingerprint.

    Cut into radius + 1 blocks, two fingerprints within the radius agree in at least one; table k is keyed by block
    k, the block permuted to the front. A pair counts in the first table in which it meets, so no pair is repeated.
    The default radius is for almost exact copies: of copies at a Jaccard similarity of 0.8 it finds hardly any.
    """
    digits = BITS // 4
    edges = [round(i * digits / (radius + 1)) for i in range(radius + 2)]

    def cut(df: DataFrame, name: str) -> DataFrame:
        one = df.filter(F.col("fingerprint").isNotNull()).select(F.col("fingerprint").alias(name)).distinct()
        blocks = F.array(*[F.substring(name, a + 1, b - a) for a, b in zip(edges, edges[1:])])
        return one.select(name, F.posexplode(blocks).alias("k", "block"))

    def bits(k):
        a, b = F.substring("query", 8 * k + 1, 8), F.substring("fingerprint", 8 * k + 1, 8)
        return F.bit_count(F.conv(a, 16, 10).cast("bigint").bitwiseXOR(F.conv(b, 16, 10).cast("bigint")))

    distance = sum((bits(k) for k in range(1, BITS // 32)), bits(0))
    earlier = F.lit(False)
    for k in range(radius):
        a, n = edges[k] + 1, edges[k + 1] - edges[k]
        earlier = earlier | ((F.col("k") > k) & (F.substring("query", a, n) == F.substring("fingerprint", a, n)))
    met = cut(queries, "query").join(cut(prints, "fingerprint"), ["k", "block"]).filter(~earlier)
    return met.withColumn("distance", distance.cast("int")).filter(F.col("distance") <= radius).select("query", "fingerprint", "distance")
