import hashlib
import math
import os
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_keep_the_columns_and_do_their_work(spark, tmp_path):
    words = [f"The{i} ing{i % 9} tion" for i in range(60)]
    one = " ".join(words)
    rows = [(i, f"{one} {i}", "en", f"s{i % 2}", 1, "x", 0.5) for i in range(4)]
    rows += [(10 + i, " ".join(f"der{i}ung{k} sch{k * i}" for k in range(90)), "de", None, 1, None, None) for i in range(8)]
    rows += [(30, None, None, None, None, None, None), (31, "123 456", "en", "s0", 7, None, None), (32, " ".join(["neu"] * 3 + words + [f"alt{k}" for k in range(70)]), "de", "s1", 5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred double")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / str(k)))
            docs = spark.read.parquet(str(tmp_path / str(k)))
            seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(seen[0]) == {*range(4), *range(10, 18), 32}
    assert set(seen[1]) == {0, *range(10, 18), 32}
    assert "neu neu neu" in seen[2][32] and words[5] not in seen[2][32]
    assert seen[3] == seen[2]
    assert out.count() == len(seen[3]) and out.filter(F.col("n_tokens") == 0).count() == 0


def test_the_mix_shows_in_the_rows(spark, tmp_path):
    counts = {"a": 700, "b": 300, None: 90}
    rows = [(i, f"text {i}", "en", g, 1) for i, g in enumerate(g for g, n in counts.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    (_, mixture), (_, tokens) = corpus_pipeline.STAGES[3:]
    mixture(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / "mixed"))
    out = {r["mix_position"]: r["doc_id"] for r in tokens(spark, spark.read.parquet(str(tmp_path / "mixed")), str(tmp_path)).collect()}
    assert sorted(out) == list(range(len(rows))) and sorted(out.values()) == [r[0] for r in rows]
    weight = {g: Fraction(float(n) ** 0.7) for g, n in counts.items()}
    share = {g: w / sum(weight.values()) for g, w in weight.items()}
    left, taken, want, t = dict(counts), dict.fromkeys(counts, 0), [], 0
    while any(left.values()):  # earliest deadline first among the released
        ready = [(math.ceil((taken[g] + 1) / share[g]), "s" + g if g else "", g) for g in counts if left[g] and math.floor(taken[g] / share[g]) <= t]
        if ready:
            g = min(ready)[2]
            n = min(16, left[g])
            want += [g] * n
            left[g], taken[g] = left[g] - n, taken[g] + 1
        t += 1
    assert [rows[out[p]][3] for p in range(len(rows))] == want


def test_against_brute_force(spark, tmp_path):
    """The five stages one after the other, each worked out plainly on what the one before has kept."""
    from tokenizers import Tokenizer

    from timberline.llm import bpe, langid

    rng = random.Random(3)
    tongue = {"en": ["the", "ing", "tion", "wh"], "de": ["sch", "der", "ung", "ein"]}
    prose = lambda lang, n: " ".join("".join(rng.choices(tongue[lang], k=3)) + str(rng.randrange(50)) for _ in range(n))
    shared = prose("en", 70)
    texts = [prose("en" if i % 3 else "de", 40 + i) for i in range(60)]
    texts += [texts[5] + " tail", texts[5], texts[7].replace(" ", "\n"), f"{prose('de', 20)} {shared} {prose('de', 30)}", shared + " " + prose("en", 25), shared, None, "", "12 34 !", "the"]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    # 1: the model is the operator's, its reading of each text is checked elsewhere
    found, score = langid.fit(docs).predict([t or "" for t in texts])
    kept = [r for r, lang, s in zip(rows, found, score) if lang != "und" and s > 0]
    # 2: all pairs
    sets = {}
    for d, t, *_ in kept:
        w = t.lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}
    parent = {d: d for d in sets}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    kept = [r for r in kept if root(r[0]) == r[0]]
    # 3: all windows
    first = {}
    for d, t, *_ in kept:
        w = t.split()
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    out = {}
    for d, t, _, source, _ in kept:
        w = t.split()
        gone = set().union(*[range(i, i + 50) for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d])
        out[d] = (t if not gone else " ".join(x for i, x in enumerate(w) if i not in gone), source)
    # 4: the schedule, slot by slot; rows of a source in the order of the MD5 of their id
    queue = {}
    for d in sorted(out, key=lambda d: (hashlib.md5(str(d).encode()).hexdigest()[:8], d)):
        queue.setdefault(out[d][1], []).append(d)
    weight = {g: Fraction(float(len(q)) ** 0.7) for g, q in queue.items()}
    share, taken, order, t = {g: w / sum(weight.values()) for g, w in weight.items()}, dict.fromkeys(queue, 0), [], 0
    left = {g: list(q) for g, q in queue.items()}
    while any(left.values()):
        ready = [(math.ceil((taken[g] + 1) / share[g]), "s" + g if g else "", g) for g in queue if left[g] and math.floor(taken[g] / share[g]) <= t]
        if ready:
            g = min(ready)[2]
            order += left[g][:16]
            left[g], taken[g] = left[g][16:], taken[g] + 1
        t += 1
    # 5: the tokenizers library
    known = Tokenizer.from_file(bpe.default_path())
    want = {d: (k, len(known.encode(out[d][0], add_special_tokens=False).ids)) for k, d in enumerate(order)}
    got = {r["doc_id"]: (r["mix_position"], r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and not {60, 61, 62, 66, 67, 68} & set(got)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_empty_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
