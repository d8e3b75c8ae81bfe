"""Language identification with language-bitmask n-gram filters.

Each language gets a set of character n-grams that are typical of it. All sets live in one bit-sliced Bloom filter:
slot i holds a bit mask of languages, in as many words of 64 bits as they need, so the AND of an n-gram's slots names every language that contains it. Per
language the hits are counted, corrected for the filter's false positives at that language's fill, and compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialise, released, slices
from .kernel import mix

U = np.uint64
GRAMS = (2, 3, 4)
#: Documented bounds of the fit: training rows per language, n-grams kept per language, slots and hashes.
SAMPLE_ROWS, KEPT, SLOTS, HASHES = 2_000, 30_000, 1 << 21, 3
#: Languages in a word of the masks.
WORD = 64

_letters = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)], bool)
    return _letters


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number) of every n-gram of the lower-cased letters, words padded by one blank, and letters per text."""
    low = [" " + t.lower() + " " for t in texts]
    size = np.array([len(t) for t in low], np.int64)
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[code]
    owner = np.repeat(np.arange(len(low)), size)
    count = np.bincount(owner[letter], minlength=len(low))
    code = np.where(letter, code, 32)
    keep = letter | np.r_[True, letter[:-1]]  # one blank between words
    keep[np.cumsum(size) - size] = True  # and before the first of each text
    code, owner, letter = code[keep].astype(U), owner[keep], letter[keep]
    hashes, owners = [], []
    for n in GRAMS:
        if len(code) < n:
            continue
        m = len(code) - n + 1
        h = np.full(m, n, U)
        inner = np.ones(m, bool)
        for k in range(n):
            h = h * U(0x100000001B3) + code[k : k + m] * U(0x9E3779B97F4A7C15)
            if 0 < k < n - 1:
                inner &= letter[k : k + m]
        ok = inner & (owner[:m] == owner[n - 1 :]) & (letter[:m] | letter[n - 1 :])
        hashes.append(mix(h[ok]))
        owners.append(owner[:m][ok])
    if not hashes:
        return np.zeros(0, U), np.zeros(0, np.int64), count
    return np.concatenate(hashes), np.concatenate(owners), count


class Model:
    """The languages, the filter and its false-positive rate per language."""

    def __init__(self, languages: list[str], sets: list[np.ndarray], slots: int = SLOTS):
        self.languages, self.size = languages, slots
        self.filters = [np.zeros(slots, U) for _ in range(0, len(languages), WORD)]
        for i, members in enumerate(sets):
            for slot in self.slots(members):
                np.bitwise_or.at(self.filters[i // WORD], slot, U(1) << U(i % WORD))
        fill = np.array([np.count_nonzero(self.filters[i // WORD] >> U(i % WORD) & U(1)) / slots for i in range(len(languages))])
        self.false = fill**HASHES

    def slots(self, h: np.ndarray) -> list[np.ndarray]:
        step = (h >> U(32)) | U(1)
        return [((h + U(k) * step) % U(self.size)).astype(np.int64) for k in range(HASHES)]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """A language (or und) and a score for each text."""
        h, owner, count = grams(texts)
        slots = self.slots(h)
        total = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        share = np.zeros((len(texts), max(1, len(self.languages))))
        for i in range(len(self.languages)):
            if i % WORD == 0:
                mask = np.full(len(h), ~U(0))
                for slot in slots:
                    mask &= self.filters[i // WORD][slot]
            hits = np.bincount(owner[(mask >> U(i % WORD) & U(1)).astype(bool)], minlength=len(texts))
            share[:, i] = np.clip((hits / total - self.false[i]) / max(1e-9, 1 - self.false[i]), 0, 1)
        best = share.argmax(1)
        known = (count > 0) & bool(self.languages)
        score = np.where(known, share.max(1), 0.0)
        return [self.languages[b] if k else "und" for b, k in zip(best, known)], score


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, kept: int = KEPT) -> Model:
    """Learn from text and non-null lang of rows that are not held out.

    The fit uses at most `sample_rows` whole texts of every language, those with the smallest hash of doc_id. An n-gram enters a language's set if at least half of its weight, with equal
    weight for all languages, lies in it or in one more language; the `kept` heaviest are taken.
    """
    spark = docs.sparkSession
    learn = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    counts = learn.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Model([], [])
    size = {r["lang"]: r["count"] for r in counts}
    # a hash threshold thins each language to a little over the bound before rows of one language meet
    share = [(k, min(1.0, 1.2 * sample_rows / n + 20 / n)) for k, n in size.items()]
    share = F.broadcast(spark.createDataFrame(share, "__l string, __s double"))  # a row per language
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    thin = learn.join(share, F.col("lang") == F.col("__l")).withColumn("__d", draw).filter(F.col("__d") < F.col("__s") * float(1 << 30))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("__d", "doc_id"))
    sample = thin.select("lang", "text", "doc_id", "__d").withColumn("__r", rank).filter(F.col("__r") <= sample_rows).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in released(batches):
            for batch in slices(whole, "text"):
                lang = np.array(batch.column(0).to_pylist(), dtype=object)
                h, owner, _ = grams(batch.column(1).to_pylist())
                for k in dict.fromkeys(lang.tolist()):
                    value, n = np.unique(h[(lang == k)[owner]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(value), pa.string()), pa.array(value.view(np.int64)), pa.array(n)], names=["lang", "h", "n"])

    table = sample.mapInArrow(count, "lang string, h bigint, n bigint").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    table = table.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("lang")))
    table = table.withColumn("share", F.col("p") / F.sum("p").over(W.partitionBy("h")))
    top = table.filter((F.col("n") >= 2) & (F.col("share") >= 0.5)).withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("p"), "h"))).filter(F.col("r") <= kept)
    top = top.select("lang", "h")
    if len(languages) > WORD:  # fetched by words of the masks, so that the driver holds few n-grams twice
        top = materialise(top, "grams")
    sets: list[np.ndarray] = []
    for at in range(0, len(languages), WORD):
        names = languages[at : at + WORD]
        got = top.filter(F.col("lang").isin(names)).toPandas().groupby("lang")["h"]
        have = {k: v.to_numpy(np.int64).view(U) for k, v in got}
        sets += [have.get(k, np.zeros(0, U)) for k in names]
    return Model(languages, sets)


def predict(docs: DataFrame, model: Model, extra: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The kept columns with language and score (0 to 1), under `names`; only the text is looked at.

    Null texts and texts without a letter give `und` and 0; a text that matches no language gets the first language
    with score 0; ties go to the language that sorts first. Without a learned language all rows give `und`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*extra).schema), f"`{names[0]}` string, `{names[1]}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in released(batches):
            for batch in slices(whole, "text"):
                lang, score = known.predict([t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()])
                kept = [batch.column(batch.schema.get_field_index(c)) for c in extra]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score)], names=[*extra, *names])

    return docs.select(*dict.fromkeys([*extra, "text"])).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, predict every row."""
    out = predict(docs, fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
