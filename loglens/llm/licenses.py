"""License scans: exact phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line, or a window of consecutive words across line breaks: for a template of m words, repeats counted, every
ceil(m / THRESHOLD) words of the whole text. It meets a template if it holds at least THRESHOLD of the template's distinct
words. A text holds what its blocks hold, so texts are filtered before blocks are looked at:

- Template words are ordered by how often they stand in the whole corpus, rarest first.
- Prefix filter: of a template of n words, a = ceil(THRESHOLD * n) must be met, so one of its n - a + 1 rarest must be. The
  corpus' words are equi-joined with these prefixes alone.
- Length filter: a text needs a words.
- Positional filter: the words of the texts left are ranked, and from the place of the rarest word that a text shares with
  the template on, a ranks must be left in the text.

Of what is left, the texts that hold a words of the template are looked at line by line and window by window, which takes time
in proportion to the text. Texts are known by the SHA-256 of their content, so copies are filtered and verified once, and
nothing depends on how rows are dealt to tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm.common import LOWER, UPPER, ascii_lower, n_words, spaced, stored, table, words

THRESHOLD = 0.8
#: Templates are broadcast; this bounds their words.
MAX_TEMPLATE_WORDS = 100_000
#: Texts, and pairs of text and template, are broadcast up to here; more are shuffled.
MAX_BROADCAST = 100_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Usual license statements and their labels.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "In no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0"),
    ("cc0-1.0", "dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]


def template_words(templates: list[tuple[str, str]]) -> list[tuple[int, str, list[str]]]:
    """(number, label, distinct words); templates without a word are left out."""
    out = [(k, label, sorted(set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())))) for k, (label, text) in enumerate(templates)]
    if sum(len(w) for *_, w in out) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates hold more than {MAX_TEMPLATE_WORDS} words")
    return [x for x in out if x[2]]


def bodies_of(rows: DataFrame) -> DataFrame:
    """rows (key, text, ...) -> (..., key, body): the words of each text, put together once for all passes over them."""
    return rows.select(*[c for c in rows.columns if c != "text"], spaced(F.col("text")).alias("body"))


def _tokens(bodies: DataFrame) -> DataFrame:
    """(key, n, word) of bodies (key, body): every word of a text, n being how many there are. n stands in a projection of its
    own, or it would be counted anew for every word."""
    split = bodies.select("key", n_words(F.col("body")).alias("n"), words(F.col("body")).alias("words"))
    return split.select("key", "n", F.explode("words").alias("word"))


def _few(df: DataFrame) -> DataFrame:
    """A stored df for a join: broadcast if its rows are within the bound."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df.hint("shuffle_hash")


def candidates(rows: DataFrame, bodies: DataFrame, made: list, rank: dict[str, int], threshold: float) -> tuple[DataFrame, DataFrame]:
    """rows (key, text) and their bodies (key, body) -> the texts (key, text) that pass the prefix and length filters, one a
    key, and the pairs (key, template) that pass the positional filter too and whose text holds enough of the template's
    words to be looked at block by block. rank: template words in their global order."""
    spark = rows.sparkSession
    prefixes = []
    for k, _, ws in made:
        least = math.ceil(threshold * len(ws) - 1e-9)
        for tpos, w in enumerate(sorted(ws, key=rank.get)[: len(ws) - least + 1]):
            prefixes.append((w, k, tpos, rank[w], least))
    schema = "word string, template int, tpos int, rank int, least int"
    prefix = F.broadcast(spark.createDataFrame(prefixes, schema))
    met = _tokens(bodies).join(prefix, "word").where(F.col("n") >= F.col("least"))
    # the first word of the template that the text holds, by rank
    pairs = met.groupBy("key", "template", "least").agg(F.min("rank").alias("rank"))
    pairs = stored(pairs, "license-prefixes")
    keys = _few(stored(pairs.select("key").distinct(), "license-keys"))
    texts = stored(rows.join(keys, "key", "left_semi").dropDuplicates(["key"]), "license-texts")
    ranks = F.broadcast(spark.createDataFrame(list(rank.items()), "word string, r int"))
    held = _tokens(bodies_of(texts)).join(ranks, "word").groupBy("key").agg(F.sort_array(F.collect_set("r")).alias("held"))
    remaining = F.size("held") - F.array_position("held", F.col("rank")) + 1
    left = pairs.join(held, "key").where(remaining >= F.col("least"))
    whole = F.broadcast(spark.createDataFrame([(k, [rank[w] for w in ws]) for k, _, ws in made], "template int, tranks array<int>"))
    left = left.join(whole, "template").where(F.size(F.array_intersect("held", "tranks")) >= F.col("least")).select("key", "template")
    return texts, stored(left, "license-candidates")


def similar_blocks(rows: DataFrame, bodies: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """rows (key, text), the key standing for the text, and bodies_of() them, stored -> (key, template, label, containment)
    for every pair with a block that meets the threshold, a row each; containment is that of the best block. NULL texts and
    keys are left out."""
    spark, made = rows.sparkSession, template_words(templates)
    vocabulary = spark.createDataFrame([(w,) for w in sorted({w for *_, ws in made for w in ws})], "word string")
    counted = _tokens(bodies).join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    counts = {r.word: r.n for r in counted.collect()}  # at most a row per template word
    order = sorted({w for *_, ws in made for w in ws}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    texts, left = candidates(rows, bodies, made, rank, threshold)
    listed = [
        (k, label, ws, math.ceil(threshold * len(ws) - 1e-9), math.ceil(len(WORD.findall(templates[k][1])) / threshold - 1e-9))
        for k, label, ws in made
    ]
    whole = F.broadcast(spark.createDataFrame(listed, "template int, label string, twords array<string>, least int, reach int"))
    lines = F.transform(F.split("text", "\n"), lambda line: words(spaced(line)))
    pairs = texts.join(_few(left), "key").join(whole, "template")

    def most(lines: Column) -> Column:
        """The most distinct words of the template that a block of the text holds."""
        numbered = F.transform(F.flatten(lines), lambda w, i: F.struct(i.alias("i"), w.alias("w")))
        by_line = F.array_max(F.transform(lines, lambda own: F.size(F.array_intersect(own, F.col("twords")))))
        by_window = _bound(F.filter(numbered, lambda x: F.array_contains("twords", x["w"])), lambda places: F.array_max(F.transform(places, lambda x, k: _window(places, x, k))))
        return F.greatest(by_window, by_line)

    best = pairs.select("key", "template", "label", "least", F.size("twords").alias("n"), _bound(lines, most).alias("best"))
    return best.where("best >= least").select("key", "template", "label", (F.col("best") / F.col("n")).alias("containment"))


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), value being made once. Expressions that lambdas refer to are put in their place, and made for each element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _window(places: Column, x: Column, k: Column) -> Column:
    """Distinct words of the template in the window that begins with x, the k-th of the text's places of such words."""
    inside = F.filter(F.slice(places, k + 1, F.col("reach")), lambda y: y["i"] < x["i"] + F.col("reach"))
    return F.size(F.array_distinct(F.transform(inside, lambda y: y["w"])))


def phrase_places(body: Column) -> dict[str, Column]:
    """n_base, first_word, last_word and base_labels (sorted array) of what spaced() gives."""
    padded = F.concat(F.lit(" "), body, F.lit(" "))
    every = f"(?:{'|'.join(sorted(PHRASES))})"
    hit = F.rlike(padded, F.lit(f" {every} "))
    before = lambda lazy: F.regexp_extract(padded, f"(?s)^(.*{lazy}) {every}(?= )", 1)
    spaces = lambda c: (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")
    labels = F.filter(F.array(*[F.when(F.contains(padded, F.lit(f" {p} ")), F.lit(v)) for p, v in sorted(PHRASES.items(), key=lambda x: x[1])]), lambda x: x.isNotNull())
    return {
        "n_base": F.when(hit, F.regexp_count(padded, F.lit(f"(?<= ){every}(?= )"))).otherwise(0).cast("long"),
        "first_word": F.when(hit, spaces(before("?"))),
        "last_word": F.when(hit, spaces(before(""))),
        "base_labels": F.when(hit, labels).otherwise(F.array().cast("array<string>")),
    }


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    A row per row, repeats included. NULL and empty texts have no words, empty labels and score 0; score is the largest
    containment among the pairs that meet the threshold. The two label columns are distinct, sorted and comma-joined.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("key"), text.alias("text"))
    bodies = stored(bodies_of(own), "license-bodies")
    places = [c.alias(k) for k, c in phrase_places(F.col("body")).items()]
    base = bodies.select("doc_id", "key", n_words(F.col("body")).alias("n_words"), *places)
    near = similar_blocks(own.select("key", "text"), bodies.select("key", "body"), templates, threshold)
    more = stored(near.groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("score")), "license-labels")
    out = base.join(_few(more), "key", "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() of documents. NULL and empty texts, ties, repeated rows and rows of equal doc_id each give a row by their own
    text; an empty table gives none; other columns are not read."""
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def _sql() -> str:
    rx = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda x: f"regexp_extract_all(translate(coalesce({x}, ''), '{UPPER}', '{LOWER}'), '{rx}')"
    phrases = " UNION ALL ".join(f"SELECT rid, '{v}' AS label, s FROM p WHERE array_to_string(w[s + 1:s + {len(k.split())}], ' ') = '{k}'" for k, v in PHRASES.items())
    listed = ", ".join(f"({k}, '{label}', {ws!r}, {math.ceil(THRESHOLD * len(ws) - 1e-9)})" for k, label, ws in template_words(TEMPLATES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, {low('text')} AS w FROM documents),
p AS (SELECT rid, w, unnest(range(0, len(w))) AS s FROM d WHERE len(w) > 0),
h AS ({phrases}),
b AS (SELECT rid, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY rid),
t(k, label, tw, least) AS (VALUES {listed}),
l AS (SELECT rid, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents_with_id),
lw AS (SELECT rid, list_distinct({low('line')}) AS w FROM l),
m AS (SELECT rid, label, len(list_intersect(w, tw)) / len(tw) AS c FROM lw, t WHERE len(w) >= least AND len(list_intersect(w, tw)) >= least),
a AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM m UNION ALL SELECT rid, label FROM h) GROUP BY rid),
c AS (SELECT rid, max(c) AS score FROM m GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN b ON d.rid = b.rid LEFT JOIN a ON d.rid = a.rid LEFT JOIN c ON d.rid = c.rid
""".replace("documents_with_id", "d")


OP7_SQL = _sql()
