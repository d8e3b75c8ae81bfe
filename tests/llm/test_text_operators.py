"""Each operator against brute force on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import bpe, embeddings, html_text, jaccard, langid, licenses, mixing, queries, sharding, simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    shared, long = prose(70), prose(6000)
    texts = [None, "", " \t\n", "one", "one two three", long, long + " tail", shared, prose(30) + "\n" + shared + " " + prose(40), shared + " " + prose(10)]
    base = prose(300).split()
    for k in range(30):  # near copies
        copy = list(base)
        copy[k * 7 % 300] = f"edit{k}"
        texts.append(" ".join(copy))
    texts += [texts[10]] * 5 + ["x " * 200, "x " * 130] + [prose(80) for _ in range(20)]
    rows = [(i, t, "en" if i % 2 else "de", f"src{i % 3}" if i % 5 else None, None) for i, t in enumerate(texts)]
    return rows + [(None, shared, None, None, None), rows[7]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def without_repeats(rows):
    """(doc_id, words, words removed, SHA-256 of the rest) of rows (doc_id, text, ...), by brute force."""
    first = {}
    for d, t, *_ in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - 49) if d is not None else ():
            k = tuple(w[i : i + 50])
            first[k] = min(d, first.get(k, d))
    out = []
    for d, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


# a filter that is full holds nothing back; with a small crowd all buckets, or most, are split by window
PATHS = pytest.mark.parametrize("bits,crowd", [(substrings.MOST_BITS, substrings.CROWD), (1 << 10, substrings.CROWD), (substrings.MOST_BITS, 0), (1 << 10, 2000)])


@PATHS
def test_substrings(docs, empty, bits, crowd):
    want = without_repeats(corpus())
    got = [tuple(r) for r in substrings.dedup(docs, most_bits=bits, crowd=crowd).collect()]
    assert sorted(got, key=str) == want
    assert substrings.dedup(empty).count() == 0
    whole = {r["doc_id"]: r["text"] for r in substrings.dedup(docs, text=True).collect()}
    assert whole[0] is None and whole[3] == "one"


@PATHS
def test_substrings_of_one_id_and_of_many_edges(spark, bits, crowd):
    rng = random.Random(8)
    prose = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    common, period = prose(61), " ".join(f"p{k % 3}" for k in range(400))
    rows = [(5, prose(20) + " " + common), (5, common + " " + prose(90)), (5, common), (2, prose(120)), (2, period)]
    rows += [(10 + k, f"{prose(k)} {common} {prose(60 - k)}") for k in range(60)]  # one passage between other words
    rows += [(80 + k, " ".join(period.split()[k:])) for k in range(4)] + [(3, rows[3][1] + " " + rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substrings.dedup(docs, most_bits=bits, crowd=crowd).collect()
    assert sorted((tuple(r) for r in got), key=str) == without_repeats(rows)


def test_substrings_with_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(60))
    clash = ("runs", "key", "c0", "hit_id", "__d", "__starts", "Bucket")
    docs = spark.createDataFrame([(i, *range(7), text) for i in range(3)], ", ".join(["doc_id long", *(f"{c} long" for c in clash), "text string"]))
    out = substrings.dedup(docs, text=True)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["hit_id"], r["text"]) for r in out.collect()) == [(0, 3, text), (1, 3, ""), (2, 3, "")]


@PATHS
def test_substrings_with_other_blanks_in_words(spark, bits, crowd):
    rng = random.Random(6)
    odd = ["\u00a0", "\u3000", "\u0085", "\u001c", "\u2028", "\u2003"]
    rows = []
    for k, c in enumerate(odd):
        w = [f"v{rng.randrange(300)}" for _ in range(140)]
        for at in (3, 70, 100, 138):
            w[at] = f"a{c}b{c}{k}"
        whole = " ".join(w)
        new = [f"n{k}{c}{i}" for i in range(40)]
        rows += [whole, whole.replace(" ", "\t\n"), " ".join(new + w[60:] + new), " ".join(w[:90] + new), " ".join(w[91:] + new)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in substrings.dedup(docs, most_bits=bits, crowd=crowd).collect()), key=str) == without_repeats(list(enumerate(rows)))


@pytest.mark.parametrize("most", [1500, 4])
def test_jaccard(docs, empty, most):
    rows = [r for r in corpus() if r[0] is not None]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, parent = {}, {}
    for d, t, *_ in rows:
        w = WORD.findall((t or "").translate(low))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
        parent[d] = d

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs, most).collect() if r["doc_id"] is not None}
    assert got == {d: (len(s), root(d)) for d, s in sets.items()}
    if most > 4:
        assert jaccard.join(empty).count() == 0


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(bpe.default_path())
    extra = ["<|endoftext|>a<|endoftext|>", "aaaaaaa aaaa", "日本語 😀\n\n  x", "I'll we've  "]
    rows = [t or "" for _, t, *_ in corpus()] + extra
    vocab = bpe.vocabulary(bpe.default_path())
    for text, packed in zip(rows, vocab.encode_batch(rows)):
        ids = known.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert vocab.decode(packed) == known.decode(ids, skip_special_tokens=False)
    out = bpe.encode(docs, ids=True).filter("doc_id = 4").first()
    assert out["decoded"] == "one two three" and out["n_tokens"] == len(out["ids"])
    assert bpe.encode(empty).count() == 0


def test_bpe_digests(docs):
    import struct

    from tokenizers import Tokenizer

    known = Tokenizer.from_file(bpe.default_path())
    known.no_truncation(), known.no_padding()
    want = []
    for d, t, *_ in corpus():
        ids = known.encode(t or "", add_special_tokens=False).ids
        packed = b"".join(struct.pack("<I", i) for i in ids)
        want.append((d, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(known.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((tuple(r) for r in bpe.encode(docs).collect()), key=str) == sorted(want, key=str)


def test_sharding(docs, empty):
    rows = sharding.assign(docs).collect()
    assert len(rows) == len(corpus())
    for s in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in rows)
    assert sharding.assign(empty).count() == 0
    big = docs.sparkSession.range(6000)
    share = {r["shard"]: r["count"] / 6000 for r in sharding.shard(big, "id", [1, 2, 0, 3]).groupBy("shard").count().collect()}
    assert set(share) == {0, 1, 3} and abs(share[3] - 0.5) < 0.03 and abs(share[0] - 1 / 6) < 0.03


def test_mixing_is_the_simulated_schedule(spark, empty):
    docs = spark.createDataFrame([(i, "a" if i % 6 < 3 else "b" if i % 6 < 5 else None) for i in range(3000)], "doc_id long, source string")
    rows = sorted(mixing.mix(docs, block=8).collect(), key=lambda r: r["position"])
    assert len({r["position"] for r in rows}) == 3000 == len({r["doc_id"] for r in rows})
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    share = {r["g"]: r["e"] for r in mixing.weights(docs).collect()}
    assert sum(share.values()) == mixing.CYCLE
    taken, slots = dict.fromkeys(share, 0), {}
    for t in range(mixing.CYCLE):  # earliest deadline first among the released
        ready = [(-(-(taken[g] + 1) * mixing.CYCLE // e), g) for g, e in sorted(share.items()) if taken[g] * mixing.CYCLE // e <= t]
        g = min(ready)[1]
        slots[t] = g
        taken[g] += 1
        assert all(abs(taken[x] - (t + 1) * e / mixing.CYCLE) < 1 for x, e in share.items())
    assert {r["slot"]: r["g"] for r in mixing.schedule(mixing.weights(docs)).collect()} == slots
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs, {"a": 3.0, "b": 1.0}).count() == 3000


def test_licenses_against_sql(docs, empty, spark):
    import duckdb

    texts = ["Licensed under CC BY-NC 4.0.", "All Rights\nreserved. all rights reserved", "x\n\nReleased under the MIT License\n\ny", "GNU general public LICENSE version", "cc by cc by"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    table = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text").unionByName(more)
    documents = table.toPandas()  # noqa: F841
    want = duckdb.sql(licenses.oracle())
    got = licenses.scan(table)
    assert sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1004]["n_base"] == 2 and by[1001]["n_base"] == 2 and by[1002]["labels"] == "mit"
    assert licenses.scan(empty).count() == 0
    odd = [(None, texts[2]), (None, "nothing"), (7, texts[2]), (7, "nothing"), (None, texts[2]), (8, None)]
    rows = licenses.scan(spark.createDataFrame(odd, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("blocks", F.lit("x"))).collect()
    assert sorted((str(r["doc_id"]), r["labels"]) for r in rows) == [("7", ""), ("7", "mit"), ("8", ""), ("None", ""), ("None", "mit"), ("None", "mit")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small documents table with nulls, repeated texts and letters of one to four bytes."""
    at = tmp_path_factory.mktemp("tables")
    rows = [r for r in corpus()[:-2] if r[0] is not None] + [(900, "é😀ß漢 " * 30, None, "src0", None), (901, "one two three", "en", "src1", 3)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(at / "documents.parquet"))
    return str(at)


@pytest.mark.parametrize("name", ["op2_licenses", "op3_substrings", "op6_sharding", "op7_mixing", "op9_jaccard"])
def test_queries_against_sql(spark, tables, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet/*.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, tables)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_simhash(docs, empty):
    rows = sorted({(d, t or "") for d, t, *_ in corpus() if d is not None}, key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in simhash.compare(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()}
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(t) // 3
        e = t[: len(t) - k] + after[:k]
        assert got[d]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert got[d]["fingerprint"] == simhash.fingerprints([t])[0].hex()
    assert simhash.compare(docs).count() == len(corpus())
    assert simhash.compare(empty).count() == 0


def vote_by_hand(text):
    """A fingerprint bit by bit: every term's hash bits vote with its weight."""
    low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = WORD.findall(low)
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def poly(values, base):
        return mix(sum(v * pow(base, k, 1 << 64) for k, v in enumerate(values)) + len(values) & mask)

    def runs(values, size):
        return [poly(values[i : i + size], 0xD6E8FEB86659FD93) for i in range(len(values) - size + 1)]

    counts = {}
    if len(words) >= simhash.SHORT:
        own = [poly([b + 1 for b in w.encode()], 0x9E3779B97F4A7C15) for w in words]
        for size, weight in ((2, 1.0), (3, 2.0)):
            for h in runs(own, size):
                counts.setdefault((size, h), [0, weight])[0] += 1
    elif words:
        span = low[low.index(words[0]) : low.rindex(words[-1]) + len(words[-1])]
        for h in runs([0, *(b + 1 for b in span.encode()), 0], 3):
            counts.setdefault((3, h), [0, 1.0])[0] += 1
    votes = [0.0] * 256
    for (_, h), (n, weight) in counts.items():
        for k in range(4):
            bits = mix(h + k * 0x9E3779B97F4A7C15 & mask)
            for byte in range(8):
                for bit in range(8):
                    at = 64 * k + 8 * byte + bit
                    votes[at] += n**0.5 * weight * (1 if bits >> 8 * byte + 7 - bit & 1 else -1)
    return votes


def test_fingerprints_by_hand(docs):
    import math

    rows = sorted({(d, t or "") for d, t, *_ in corpus() if d is not None}, key=lambda r: -r[0])[:24]
    table = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in simhash.compare(table).collect()}
    for d, t in rows:
        votes, bits = vote_by_hand(t), int(got[d]["fingerprint"], 16)
        for at, v in enumerate(votes):
            if abs(v) > 1e-3:  # sums of single-precision weights
                assert (bits >> 255 - at & 1) == (v > 0)
    for d, t in rows[:-1]:
        r, after = got[d], got[rows[[x for x, _ in rows].index(d) + 1][0]]
        for other, near in ((r["edited_fingerprint"], r["near_edited"]), (after["fingerprint"], r["near_next"])):
            apart = (int(r["fingerprint"], 16) ^ int(other, 16)).bit_count()
            assert near == pytest.approx(max(0.0, math.cos(math.pi * apart / 256)))


def test_search_query_finds_the_copies(spark, tables):
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in simhash.fingerprint(spark.read.parquet(tables + "/documents.parquet")).collect()}
    got = {(r["query"], r["fingerprint"], r["distance"]) for r in queries.simhash_search(spark, tables).collect()}
    want = {(f"{prints[q]:064x}", f"{p:064x}", (prints[q] ^ p).bit_count()) for q in prints if q % 50 == 0 for p in prints.values() if (prints[q] ^ p).bit_count() <= simhash.RADIUS}
    assert got == want and got


def test_hamming_search(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(256) for _ in range(40)]
    prints = base + [b ^ sum(1 << i for i in rng.sample(range(256), k)) for b in base for k in (1, 7, 8)]
    df = spark.createDataFrame([(f"{p:064x}",) for p in prints], "fingerprint string")
    got = {(r["query"], r["fingerprint"], r["distance"]) for r in simhash.search(df, df.limit(30)).collect()}
    queries = {r["fingerprint"] for r in df.limit(30).collect()}
    want = {(q, f"{p:064x}", (int(q, 16) ^ p).bit_count()) for q in queries for p in prints if (int(q, 16) ^ p).bit_count() <= 7}
    assert got == want


def test_language(spark, empty):
    rng = random.Random(1)
    parts = {"en": ["the", "ing", "tion", "wh"], "de": ["sch", "der", "ung", "ß"], "fr": ["eau", "é", "que", "ment"]}
    rows = []
    for i in range(600):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(20)), lang))
    rows += [(1000, None, "en"), (1001, "12 !?", "en"), (1002, "", None)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in out if r["held_out"] and r["doc_id"] < 1000]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.99 * len(held)
    assert {r["lang_pred"] for r in out if r["doc_id"] >= 1000} == {"und"}
    assert langid.identify(empty).count() == 0


def test_language_filters_against_sets():
    """Shares by the filters are those by exact sets of n-grams, but for what the correction of false positives leaves."""
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choices("abcdefghij" if k % 2 else "fghijklmno", k=4)) for _ in range(60)) for k in range(8)]
    members = [np.unique(langid.grams(texts[k : k + 1])[0]) for k in range(4)] + [np.unique(np.concatenate([langid.grams(texts[k : k + 1])[0] for k in (4, 5)]))]
    for slots in (1 << 21, 1 << 13):
        model = langid.Model([f"l{k}" for k in range(5)], members, slots)
        found, score = model.predict(texts)
        for k, t in enumerate(texts):
            h = langid.grams([t])[0]
            share = [np.isin(h, m).mean() for m in members]
            assert abs(score[k] - max(share)) < (0.002 if slots > 1 << 20 else 0.08)
            if sorted(share)[-1] - sorted(share)[-2] > 0.1:
                assert found[k] == f"l{int(np.argmax(share))}"
    hash_, owner, letters = langid.grams(["Ab c", "", "é1é"])
    # all n-grams of a word between blanks, but not the whole with both
    size = lambda words: sum(len(w) + 3 - n - (n == len(w) + 2) for w in words for n in langid.GRAMS if len(w) + 2 >= n)
    assert [int((owner == k).sum()) for k in range(3)] == [size(["ab", "c"]), 0, size(["é", "é"])]
    for k, t in enumerate(texts):  # a text reads the same wherever it stands in a batch
        assert np.array_equal(np.sort(langid.grams(texts)[0][langid.grams(texts)[1] == k]), np.sort(langid.grams([t])[0]))
    assert letters.tolist() == [3, 0, 2]


def test_html(spark):
    page = '<html><head><title>t</title><script>var x="</p>";</script></head><body><nav><a href="/">menu</a></nav><div class="ad">buy</div><article><h1>Head &amp; line</h1><p><b>First,  one.<br>x<p>Second é&eacute; par\nagraph, long enough.</p><ul><li>a<li>b</ul><aside>side</aside></article><div id="comments"><p>reader, comment</p></div><footer>&copy;</footer>'
    assert html_text.main_text(page) == "Head & line\nFirst, one. x\nSecond éé par agraph, long enough.\na\nb"
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>un" + "<div>" * 3000 + "deep</p>")], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert out[2]["text"] == out[3]["text"] == "" and out[2]["n_chars"] == 0
    assert "deep" in out[4]["text"] and out[1]["n_chars"] == len(out[1]["text"])


def deviation(spark, counts, given=None, slots=4000):
    """The farthest any source gets from its requested weight, in blocks, while none has run out; the rows, by slot."""
    rows = [(i, g) for i, g in enumerate(g for g, n in counts.items() for _ in range(n))]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), given, block=1).orderBy("position").collect()
    assert len(out) == len(rows) == len({r["position"] for r in out}) and {r["doc_id"] for r in out} == {i for i, _ in rows}
    want = given or {g: n**mixing.TEMPERATURE for g, n in counts.items()}
    taken, total, worst = dict.fromkeys(want, 0), sum(want.values()), 0.0
    for t, r in enumerate(out[:slots]):
        assert r["release"] <= r["slot"] == t < r["deadline"]
        taken[r["source"]] += 1
        worst = max(worst, *(abs(n * total - (t + 1) * want[g]) / total for g, n in taken.items()))
        if taken[r["source"]] == counts[r["source"]]:
            break
    return worst, t + 1


def test_mixing_keeps_to_the_weights_asked_for(spark):
    ten = {f"s{k}": 4500 if k == 0 else 60 for k in range(10)}
    worst, slots = deviation(spark, ten, {f"s{k}": 81 if k == 0 else 1 for k in range(10)})
    assert worst < 1 and slots > 3 * mixing.CYCLE
    many = {f"s{k}": 2600 if k == 0 else 5 for k in range(512)}
    worst, slots = deviation(spark, many, {f"s{k}": 511 if k == 0 else 1 for k in range(512)})
    assert worst < 1 and slots > 3 * mixing.CYCLE
    # a hot source, and targets by the number of documents
    worst, slots = deviation(spark, {f"s{k}": 600 if k == 0 else 5 for k in range(300)})
    assert worst < 1 and slots > mixing.CYCLE
    after = mixing.mix(spark.createDataFrame([(i, "abc"[i % 3]) for i in range(300)], "doc_id long, source string"), {"a": 3.0, "b": 1.0}, block=8).orderBy("position").collect()
    assert len(after) == 300 and all(r["source"] == "c" for r in after[200:])


def test_mixing_has_no_rest_group(spark):
    counts = {f"s{k:03}": 900 if k == 0 else 3 for k in range(700)} | {None: 40}
    worst, slots = deviation(spark, counts)
    assert worst < 1 and slots > mixing.CYCLE
    given = {g: 700 if g == "s000" else 30 if g is None else 1 for g in counts}
    worst, slots = deviation(spark, counts, given)
    assert worst < 1 and slots > mixing.CYCLE
    rows = mixing.mix(spark.createDataFrame([(i, g) for i, g in enumerate(counts)], "doc_id long, source string"))
    assert {r["block"] for r in rows.collect()} == {0}  # every source counts its own blocks


ONE, TWO = "One paragraph, long enough to read.", "Two, with more, and more words."
#: (page, text): what is kept and what goes, one shape each.
SHAPES = [
    ("<article><p>{0}</p><p>{1}</p></article>", "{0}\n{1}"),
    ("<div class='sidebar'><p>{0}</p></div>", ""),
    ("<aside><p>{0}</p></aside><form><p>{1}</p></form>", ""),
    ("<nav><ul><li><a href='/'>home</a></ul></nav><footer>{0}</footer>", ""),
    ("<main><p>{0}</p><article class='comment'><p>{1}</p></article></main>", "{0}"),
    ("<main><p>{0}</p><article id='comment-12'><p>{1}</p></article><article id='comment-13'><p>{1}</p></article></main>", "{0}"),
    ("<div id='story'><p>{0}</p></div><article class='reply'><p>{1}</p><p>{1}</p></article>", "{0}"),
    ("<article><p class=it's>{0}</p><p title=don't>{1}</p></article>", "{0}\n{1}"),
    ("<article><p class=it's>{0}</p><p>It's {1}</p></article>", "{0}\nIt's {1}"),
    ("<article><p title='a > b' data-x=\"<p>\">{0}</p></article>", "{0}"),
    ("<article><p title = 'a' hidden>{1}</p><p title=>{0}</p></article>", "{0}"),
    ("<article><p title=\"never closed>{0}</p><p>{1}</p></article>", "{0}\n{1}"),
    ("<article><header><h1>Head</h1><p>by someone</p></header><p>{0}</p></article>", "Head\n{0}"),
    ("<header><h1>The site</h1></header><article><p>{0}</p></article>", "{0}"),
    ("<article><header class='ad'><h1>Buy</h1></header><p>{0}</p></article>", "{0}"),
    ("<article><p>{0}<p>{1}</article>", "{0}\n{1}"),
    ("<article><p>{0}</p></span></b></table>{1}</article>", "{0}\n{1}"),
    ("<article><p>a&amp;b &lt;i&gt; &#x41;&#66; &nbsp; {0}</p></article>", "a&b <i> AB {0}"),
    ("<article>  <p>\n {0}\t\n</p>  </article>", "{0}"),
    ("<article><p>x<br>y<br/>{0}</p></article>", "x y {0}"),
    ("<article><script>if (a < b) '</p>'</script><style>p > a</style><p>{0}</p><noscript><p>no</p></noscript></article>", "{0}"),
    ("<article><!-- <p>gone</p> --><p>{0}</p><!-- never closed <p>{1}</p></article>", "{0}"),
    ("<article><p>{0}</p><div style='display: none'><p>{1}</p></div><div aria-hidden=true>{1}</div></article>", "{0}"),
    ("<ARTICLE><P>{0}</P><TABLE><TR><TD>a<TD>b</TABLE></ARTICLE>", "{0}\na\nb"),
    ("<article><div class='cookie-notice'><p>{1}</p></div><p>{0}</p><div class=share><a href=x>share</a></div></article>", "{0}"),
    ("<div class=ad>{1}</div><article><h1>x</h1></article>", "x"),
    ("a < b and {0}", "a < b and {0}"),
    ("<p>{0}", "{0}"),
    ("", ""),
]


@pytest.mark.parametrize("page,want", SHAPES)
def test_html_shapes(page, want):
    for wrap in ("{}", "<html><head><title>t</title></head><body><nav><a href='/'>menu</a></nav>{}</body></html>", "<!DOCTYPE html>\n<body>{}<footer>end</footer>"):
        if "never closed <p>" in page and "footer" in wrap:
            continue
        assert html_text.main_text(wrap.format(page.format(ONE, TWO))) == want.format(ONE, TWO)


def test_html_tables(spark):
    pages = [(i % 3 if i else None, f"u{i % 2}", p.format(ONE, TWO)) for i, (p, _) in enumerate(SHAPES)] + [(5, None, None), (5, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("parsed", F.lit(1)).repartition(3)
    want = [(i, u, html_text.main_text(h), len(html_text.main_text(h))) for i, u, h in pages]
    assert sorted((tuple(r) for r in html_text.extract(df).collect()), key=str) == sorted(want, key=str)
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<article>" + "<b>" * 40000 + "</p>" * 40000 + "x", "<b>" * 40000 + "<hr>" * 40000 + "x", "<div>" * 40000 + "</x>" * 40000 + "x", "<a b='" * 40000, '<p title="' + "<p>x" * 40000, "<p a=b c" * 40000])
def test_html_of_broken_pages_takes_time_in_proportion(page):
    import time

    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 5


def paragraphs(name, n, commas):
    return [f"{name} {k} of the story" + ", and more" * commas + " to be told at length." for k in range(n)]


@pytest.mark.parametrize("page", ["<div class='content'><div class='text'>{}</div><div class='text'>{}</div></div>", "<article>{}</article><article>{}</article>", "<article>{1}</article><article>{0}</article>", "<main><div class='row'><article>{}</article></div><div class='row'><article>{}</article></div></main>", "<div id='a' class='post-body'>{}</div><div class='ad'><p>buy, now</p></div><div class='entry'>{}</div>"])
def test_html_of_articles_in_several_containers(page):
    long, short = paragraphs("First", 9, 3), paragraphs("Second", 2, 2)
    tagged = ["".join(f"<p>{t}</p>" for t in part) for part in (long, short)]
    want = short + long if page.startswith("<article>{1}") else long + short
    got = html_text.main_text("<html><body><nav><a href='/'>menu</a></nav>" + page.format(*tagged) + "<div id='comments'><p>reader, comment</p></div></body></html>")
    assert got == "\n".join(want)


@pytest.mark.parametrize("name", ["layout sidebar-right", "content-sidebar", "search-page", "login-enabled"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_html_of_wrappers_that_are_called_like_noise(name, tag):
    text = paragraphs("First", 6, 2)
    inner = f"<{tag}>" + "".join(f"<p>{t}</p>" for t in text) + f"</{tag}>"
    comments = "<div class='comments'>" + "".join(f"<p>{t}</p>" for t in paragraphs("Reader", 4, 1)) + "</div>"
    for outside in ("<p>Skip to content</p>{}", "{}<p>Copyright 2020, all rights reserved</p>", "<div>Skip</div>{}<div><p>A line</p></div>"):
        got = html_text.main_text("<body>" + outside.format(f"<div class='{name}'><ul class='menu'><li><a href='/'>home</a></ul>{inner}{comments}</div>") + "</body>")
        assert "\n".join(text) in got and "Reader" not in got and "home" not in got
    # what is noise stays noise, however long
    long = "".join(f"<p>{t}</p>" for t in paragraphs("Reader", 40, 3))
    for page in (f"{inner}<div class='comments'>{long}</div>", f"{inner}<div class='comments'><article>{long}</article></div>"):
        assert html_text.main_text(page) == "\n".join(text) or tag == "div" and "article>" in page


def test_more_languages_than_bits_in_a_word(spark):
    rng = random.Random(7)
    rows = []
    for k in range(70):
        parts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(6)]
        for i in range(24 if k % 9 else 16):
            rows.append((len(rows), " ".join("".join(rng.choices(parts, k=2)) for _ in range(20)), f"l{k:02}"))
    truth = {r[0]: r[2] for r in rows}
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    held = [r for r in out if r["held_out"]]
    assert {truth[r["doc_id"]] for r in held} == set(truth.values()) == {r["lang_pred"] for r in held}
    assert all(r["lang_pred"] == truth[r["doc_id"]] for r in out)


def components_of(nodes, pairs):
    """{node: smallest node reachable}."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


# small blocks: buckets are cut, and pairs of blocks compared in tasks of their own; little room: large buckets
@pytest.mark.parametrize("most,room", [(embeddings.MOST, embeddings.ROOM), (8, embeddings.ROOM), (8, 0.01)])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings(spark, most, room, kind):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(60):
        centre = rng.normal(size=32)
        for k in range(1 + c % 6 if c else 90):  # the first group has more members than are paired at once
            rows.append((len(rows), [float(np.float32(x)) for x in centre + rng.normal(size=32) * 0.16], f"l{c % 2}"))
    rows += [(len(rows) + k, rows[3][1], rows[3][2]) for k in range(4)]
    n = len(rows)
    rows += [(n, None, "l1"), (n + 1, [0.0] * 32, "l1"), (n + 2, [float("nan")] * 32, "l0"), (n + 3, rows[0][1], None), (n + 4, rows[0][1][:-1] + [None], "l0"), (n + 5, [], "l0"), (n + 6, rows[0][1] + [0.0] * 1024, "l0"), (n + 7, [1.0], "l0"), (n + 8, [2.0], "l0"), (n + 9, [-2.0], "l0")]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label string").withColumn("extra", F.lit(1)).withColumn("sig", F.lit(2))
    x = np.array([r[1] for r in rows[:n]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:n]])
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    root = components_of(range(n), [(int(a), int(b)) for a, b in np.argwhere(link) if a < b])
    got = {r["vec_id"]: r for r in embeddings.dedup(df, most=most, room=room).collect()}
    assert [got[i]["n_links"] for i in range(n)] == link.sum(1).tolist()
    assert {i: got[i]["component_id"] for i in range(n)} == root and all(got[i]["kept"] == (root[i] == i) for i in range(n))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in [*range(n, n + 7), n + 9])
    assert (got[n + 7]["n_links"], got[n + 8]["n_links"], got[n + 8]["component_id"]) == (1, 1, n + 7)


def test_embeddings_with_repeated_ids(spark):
    a, b, c = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0], [1.0, 0.0, 0.12]
    rows = [(1, a, 0), (1, b, 0), (2, a, 0), (3, b, 0), (None, a, 0), (4, c, 0), (5, c, 1), (5, c, 1)]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False), (None, 0, None, False), (4, 2, 1, False), (5, 1, 5, True), (5, 1, 5, True)], key=str)
    assert embeddings.dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pairs_at_the_threshold_meet():
    rng = np.random.default_rng(9)
    for n, dim in ((2_000, 64), (5_000_000, 64), (50_000, 256)):
        width, tables = embeddings.plan(n, dim)
        a = rng.normal(size=(3000, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.normal(size=(3000, dim))
        b -= (b * a).sum(1, keepdims=True) * a
        b = 0.93 * a + (1 - 0.93**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
        met = embeddings.buckets(a, width, tables)[:, :, :, None] == embeddings.buckets(b, width, tables)[:, :, None, :]
        assert met.any((1, 2, 3)).mean() >= 0.995
