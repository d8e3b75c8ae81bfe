"""License scans: phrases by place, and licence notices by exact set-similarity join.

A block (lines up to a blank line) meets a template when it holds at least `THRESHOLD` of the template's distinct
words. Words are put in one global order, rare first, by their number of blocks over all documents. A block that meets a template
of n words shares at least a = ceil(THRESHOLD * n) words with it, so (length) it has at least a template words,
(prefix) the first |block| - a + 1 of them and the first n - a + 1 of the template share a word, and (position) at the
first shared word enough words must be left on both sides. What passes is counted exactly. Words outside all templates
cannot be shared; the order puts them last and they are left out of the blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, materialise

#: Phrases whose places are counted, and their labels (fixed values of the contract).
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Licence notices: label and text. Every word of a notice is lower-cased.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("apache-notice", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("warranty", "the software is provided as is without warranty of any kind express or implied"),
)
THRESHOLD = 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of 0-9, a-z and non-ASCII characters of an already lower-cased text."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def templates(spark: SparkSession, given=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(label, word, size, need): one row per distinct word of a template; the table is as long as the templates."""
    rows = [(label, w, len(set(t.split())), math.ceil(threshold * len(set(t.split())) - 1e-9)) for label, t in given for w in sorted(set(t.split()))]
    return spark.createDataFrame(rows, "label string, word string, size int, need int")


def phrase_places(word: Column, phrase: str) -> Column:
    """The word indices at which the words of a phrase stand consecutively."""
    parts = phrase.split()
    last = F.size(word) - len(parts)

    def here(i):
        hit = F.get(word, i) == parts[0]
        for k in range(1, len(parts)):
            hit = hit & (F.get(word, i + k) == parts[k])
        return hit

    return F.when(F.array_contains(word, parts[-1]) & (last >= 0), F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, given=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Words, phrase places and labels of every whole text.

    Null and empty texts have no words, no labels and score 0. score is the largest share of a template held by a
    block, of the templates met, and 1 where a phrase stands. Every row stands for itself, whatever its doc_id:
    rows with a null or repeated id have the labels of their own text.
    """
    spark = docs.sparkSession
    known = templates(spark, given, threshold)
    vocabulary = sorted({w for _, t in given for w in t.split()})
    least = min(math.ceil(threshold * len(set(t.split())) - 1e-9) for _, t in given)
    text = F.coalesce(F.col("text"), F.lit(""))
    # only two letters beyond ASCII have lower-case forms in it; without them lower() does the same to words, and faster
    low = F.when(text.rlike("[\u212a\u0130]"), lower_ascii(text)).otherwise(F.lower(text))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), low.alias("text"))

    # one scan of the texts: words by block, places of the phrases, and the blocks reduced to their template words
    literal = F.array(*map(F.lit, vocabulary))
    cut = rows.select("doc_id", "row", F.transform(F.split("text", r"\n[ \t\r]*\n"), words).alias("blocks"))
    cut = cut.select("doc_id", "row", "blocks", F.flatten("blocks").alias("w"))
    held = F.transform("blocks", lambda b: F.array_intersect(b, literal))
    each = cut.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), *[phrase_places(F.col("w"), p).alias(f"p{k}") for k, (p, _) in enumerate(PHRASES)], F.filter(held, lambda b: F.size(b) > 0).alias("held"))
    each = materialise(each, "license-words")  # from here on the row numbers are fixed
    every_block = each.select("row", F.posexplode("held").alias("block", "held"))
    blocks = every_block.filter(F.size("held") >= least)  # the length filter

    # the global order: in how many blocks of all documents each template word stands, rare first
    counts = every_block.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    order = known.select("word").distinct().join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    ordered = known.join(order, "word")
    shape = ordered.groupBy("label", "size", "need").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("t"))
    prefix = shape.select("label", "size", "need", "t", F.posexplode(F.slice("t", 1, F.col("size") - F.col("need") + 1)).alias("i", "first"))
    prefix = prefix.select("label", "size", "need", "t", "i", F.col("first.word").alias("word"))

    ranked = order.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("rank"))
    sorted_blocks = blocks.crossJoin(F.broadcast(ranked)).select("row", "block", F.array_sort(F.transform("held", lambda w: F.struct(F.element_at("rank", w).alias("n"), w.alias("word")))).alias("b"))
    places = sorted_blocks.select("row", "block", "b", F.posexplode(F.slice("b", 1, F.size("b") - least + 1)).alias("j", "first"))
    places = places.select("row", "block", "b", "j", F.col("first.word").alias("word"))
    met = places.join(F.broadcast(prefix), "word").filter(
        (F.size("b") >= F.col("need"))
        & (F.col("j") <= F.size("b") - F.col("need"))
        & (1 + F.least(F.col("size") - F.col("i") - 1, F.size("b") - F.col("j") - 1) >= F.col("need"))
    )
    shared = F.size(F.array_intersect("b", "t"))
    met = met.filter(shared >= F.col("need")).select("row", "label", (shared / F.col("size")).alias("share"))
    found = met.groupBy("row").agg(F.sort_array(F.collect_set("label")).alias("met"), F.max("share").alias("share"))

    every = F.concat(*[F.col(f"p{k}") for k in range(len(PHRASES))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]))
    base = each.select("doc_id", "row", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.sort_array(labels).alias("base"))
    return base.join(found, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat("base", F.coalesce("met", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same in DuckDB SQL, by comparing every block with every template."""
    given = ", ".join(f"('{label}', '{t}')" for label, t in TEMPLATES)
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    cut = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    tests = " UNION ALL ".join(
        f"SELECT doc_id, i, '{label}' AS label FROM w, unnest(range(len(w) - {len(p.split()) - 1})) AS r(i) WHERE " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split())) for p, label in PHRASES
    )
    return rf"""
WITH low AS (SELECT doc_id, {low} AS text FROM documents),
w AS (SELECT doc_id, {cut.format('text')} AS w FROM low),
places AS ({tests}),
base AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, array_to_string(list_sort(list_distinct(list(label))), ',') AS base, list_distinct(list(label)) AS l FROM places GROUP BY doc_id),
blocks AS (SELECT doc_id, list_distinct({cut.format('b')}) AS s FROM low, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) AS u(b)),
given(label, t) AS (VALUES {given}),
sets AS (SELECT label, list_distinct(string_split(t, ' ')) AS t FROM given),
met AS (SELECT doc_id, label, max(len(list_intersect(s, t)) / len(t)) AS share FROM blocks, sets WHERE len(list_intersect(s, t)) >= ceil({THRESHOLD} * len(t) - 1e-9) GROUP BY ALL),
found AS (SELECT doc_id, list(label) AS l, max(share) AS share FROM met GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word, coalesce(base, '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.l, []), coalesce(found.l, [])))), ','), '') AS labels,
  greatest(coalesce(share, 0.0), CASE WHEN coalesce(n, 0) > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""
