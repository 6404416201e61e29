"""License scan by a positional index of rare words, with DataFrame functions only.

A template is a licence phrase or the opening of a licence text with phrases that must not be missing. Every template word has postings
(template, position). A document's words that the templates use are found in one pass; how many documents hold each gives its
inverse document frequency. A document's rare licence words open alignments (template, start): all its licence words are joined
with the postings and meet in the alignment that their relative positions ask for. An alignment is accepted if words with
at least :data:`SHARE` of the template's rarity stand in their places and all words of its key phrases do. Words may be replaced;
one that is added or left out shifts what follows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.session import cut

#: Between words: ASCII except digits and letters.
BREAK = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Part of a template's rarity that has to stand in its place.
SHARE = 0.8
#: A word is rare if at most one in so many documents holds it; the rarest word of a template always counts as rare.
RARE = 10

# Phrases with the labels that every scan reports, at every place where their words stand one after the other.
BASE = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)

# Openings of public licence texts and usual notices, each with its key phrases.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("in compliance with the license", "apache org licenses license 2 0")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl", "it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", "licensed under the gnu lesser general public license version", ("gnu lesser general public license",)),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("gnu affero general public license version 3",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights", ("waived all copyright", "neighboring rights")),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    ("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    ("cc-by-nd", "licensed under cc by nd", ("cc by nd",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
)

# Words of templates that carry no weight outside key phrases.
PLAIN = ("a", "all", "and", "any", "are", "as", "at", "by", "for", "has", "in", "is", "it", "may", "not", "of", "or", "that", "the", "this", "to", "with", "you")


def index_of(base=BASE, templates=TEMPLATES) -> tuple[list[tuple], list[tuple]]:
    """Postings ``(word, template, position, is_key)`` and templates ``(template, label, is_base, n_words, n_keys)``.

    The words of a base phrase are all key. Every key phrase has to occur in its template."""
    postings, heads = [], []
    entries = [(label, text, (text,), True) for label, text in base] + [(label, text, keys, False) for label, text, keys in templates]
    for t, (label, text, keys, is_base) in enumerate(entries):
        words, key_places = text.split(), set()
        for phrase in keys:
            want = phrase.split()
            at = next(i for i in range(len(words)) if words[i : i + len(want)] == want)
            key_places.update(range(at, at + len(want)))
        kept = [(w, t, i, int(i in key_places)) for i, w in enumerate(words) if i in key_places or w not in PLAIN]
        postings += kept
        heads.append((t, label, is_base, len(kept), len(key_places)))
    return postings, heads


def licence_words(vocabulary, text="text") -> Column:
    """``n_words`` of a text and its ``hits``: words of the vocabulary with their places; only A-Z are lower-cased."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), BREAK, -1)

    def of(words: Column) -> Column:
        leading = (F.get(words, F.lit(0)) == "").cast("int")
        trailing = ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")

        def hit(w: Column, i: Column) -> Column:
            # A word with other letters that lower() maps to ASCII gets shorter by it.
            found = F.lower(w).isin(*vocabulary) & (F.octet_length(w) == F.octet_length(F.lower(w)))
            return F.when(found, F.struct(F.lower(w).alias("word"), (i - leading).alias("place")))

        return F.struct((F.size(words) - leading - trailing).cast("long").alias("n_words"), F.array_compact(F.transform(words, hit)).alias("hits"))

    return F.get(F.transform(F.array(parts), of), F.lit(0))


def weighed(postings: DataFrame, hits: DataFrame, n_docs: DataFrame) -> DataFrame:
    """Postings with ``idf`` and ``rare``. Words that no document holds are the rarest."""
    held = hits.select("row", "word").distinct().groupBy("word").agg(F.count("*").alias("df"))
    known = postings.join(held, "word", "left").crossJoin(F.broadcast(n_docs)).withColumn("df", F.coalesce("df", F.lit(0)))
    least = known.groupBy("template").agg(F.min("df").alias("least"))
    rare = (F.col("df") * RARE <= F.col("n_docs")) | (F.col("df") == F.col("least"))
    idf = F.log(1 + (F.col("n_docs") + 1) / (F.col("df") + 1))
    return known.join(least, "template").select("word", "template", "position", "is_key", idf.alias("idf"), rare.cast("int").alias("rare"))


def alignments(docs: DataFrame, base=BASE, templates=TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """``(rows, found)``: ``row, doc_id, n_words`` for every document and ``row, start, label, is_base, share`` for every accepted alignment."""
    spark = docs.sparkSession
    entries, heads = index_of(base, templates)
    words = licence_words(sorted({w for w, *_ in entries}))
    rows = cut(docs.select("doc_id", words.alias("x")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "x.n_words", "x.hits"))
    hits = rows.select("row", F.inline("hits"))
    postings = spark.createDataFrame(entries, "word string, template int, position int, is_key int")
    # As many rows as the templates have words, whatever the documents.
    index = cut(weighed(postings, hits, rows.agg(F.count("*").alias("n_docs"))))
    totals = index.groupBy("template").agg(F.sum("idf").alias("total"))
    named = spark.createDataFrame(heads, "template int, label string, is_base boolean, n_words long, n_keys long").join(totals, "template")
    start = (F.col("place") - F.col("position")).alias("start")
    met = hits.join(F.broadcast(index), "word").groupBy("row", "template", start).agg(
        F.sum("idf").alias("weight"), F.sum("is_key").alias("keys"), F.count("*").alias("words"), F.max("rare").alias("rare")
    )
    share = F.when(F.col("words") == F.col("n_words"), 1.0).otherwise(F.round(F.col("weight") / F.col("total"), 6))
    met = met.join(F.broadcast(named), "template").withColumn("share", share)
    accepted = (F.col("keys") == F.col("n_keys")) & (F.col("is_base") | ((F.col("rare") == 1) & (F.col("share") >= SHARE)))
    return rows.drop("hits"), met.where(accepted).select("row", "start", "label", "is_base", "share")


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row of ``docs (doc_id, text, ...)``.

    A null, empty or blank text has no words and no labels; the score is the largest share of an accepted alignment, 0 without one. Repeated
    rows are scanned each, other columns are ignored, an empty table gives an empty result. A document of any length or number of
    licences is a set of narrow rows, summed before they are shuffled.
    """
    rows, found = alignments(docs, base, templates)
    at = F.when(F.col("is_base"), F.col("start"))
    per_row = found.groupBy("row").agg(
        F.count(at).alias("n_base"), F.min(at).cast("long").alias("first_word"), F.max(at).cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("is_base"), F.col("label"))).alias("base_labels"), F.collect_set("label").alias("labels"), F.max("share").alias("score"),
    )

    def listed(name: str) -> Column:
        return F.coalesce(F.array_join(F.sort_array(name), ","), F.lit("")).alias(name)

    return rows.join(per_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", listed("base_labels"), listed("labels"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


def sql(base=BASE, templates=TEMPLATES) -> str:
    """The scan as DuckDB SQL over ``documents``."""
    postings, heads = index_of(base, templates)
    listed = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in row) + ")" for row in rows)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = "[^" + re.sub(r"\\x40\\x5B-", "", BREAK[1:-2]) + "]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{pattern}') AS ws FROM documents),
p AS (SELECT * FROM (VALUES {listed(postings)}) v(word, t, pos, is_key)),
n AS (SELECT * FROM (VALUES {listed(heads)}) v(t, label, is_base, n_words, n_keys)),
i AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM d),
h AS (SELECT * FROM i WHERE word IN (SELECT word FROM p)),
f AS (SELECT word, count(DISTINCT r) AS df FROM h GROUP BY word),
k AS (SELECT p.*, coalesce(df, 0) AS df, (SELECT count(*) FROM d) AS docs FROM p LEFT JOIN f USING (word)),
x AS (SELECT *, ln(1 + (docs + 1) / (df + 1)) AS idf, df * {RARE} <= docs OR df = min(df) OVER (PARTITION BY t) AS rare FROM k),
a AS (SELECT r, x.t, place - pos AS start, sum(idf) AS weight, sum(is_key) AS keys, count(*) AS words, bool_or(rare) AS rare FROM h JOIN x USING (word) GROUP BY ALL),
s AS (SELECT a.*, n.*, CASE WHEN words = n_words THEN 1.0 ELSE round(weight / (SELECT sum(idf) FROM x WHERE x.t = a.t), 6) END AS share FROM a JOIN n ON n.t = a.t),
g AS (SELECT r, count(*) FILTER (is_base) AS n_base, min(start) FILTER (is_base) AS first_word, max(start) FILTER (is_base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM s WHERE keys = n_keys AND (is_base OR (rare AND share >= {SHARE})) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN g USING (r)
"""
