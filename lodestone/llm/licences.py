"""License scans by an exact set-similarity join, in DataFrame operations only.

A text block is any run of as many words as the longest template has, wherever lines end: wrapped notices are whole, and words far
apart make no match. A block matches a template if it holds at least the threshold's share of the template's different words. Template
words are ordered by how many texts of the whole corpus hold them, rarest first. A text with a matching block must hold one of the
first (words - needed + 1) words of the template in that order: those prefixes are joined with the texts' words. The length filter
asks for as many template words in the text as are needed; the positional filter asks that the words behind the joined one, in text
and template, still suffice. What is left is verified block by block, so exactly the matching texts are found.

Templates are a fixed list, so their words, prefixes and counts are the only things collected or broadcast. Beside the join, phrases
of consecutive words are counted and placed.

Defined results: a null text is the empty text, which has no words, blocks or labels; a block's words count once; rows that repeat
both id and text have equal results; null ids are kept; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents

#: Between words, once A-Z is lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Opening words of well-known licences and notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: str) -> list[str]:
    """A template's different words; templates are ASCII."""
    return list(dict.fromkeys("".join(c if c.isalnum() else " " for c in text.lower()).split()))


def spaced(text: Column) -> Column:
    """The words with two blanks around each, so a word's number is half the blanks before it."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), GAP, "  ")


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_places(docs: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word and base (array of labels) for places where a phrase's words stand in a row."""
    out = docs.withColumn("_spaced", spaced(F.col("text"))).withColumn("n_words", (_blanks(F.col("_spaced")) / 2 - 1).cast("long"))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        wide = " " + phrase.replace(" ", "  ") + " "
        there = F.contains(F.col("_spaced"), F.lit(wide))
        before = _blanks(F.substring_index("_spaced", wide, 1))
        behind = _blanks(F.substring_index("_spaced", wide, -1))
        counts.append(F.when(there, F.regexp_count("_spaced", F.lit(f"(?={wide})"))).otherwise(0))
        firsts.append(F.when(there, ((before + 1) / 2 - 1).cast("long")))
        lasts.append(F.when(there, F.col("n_words") - ((behind - 1) / 2).cast("long") - len(phrase.split(" "))))
        labels.append(F.when(there, F.lit(label)))
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    some = lambda many, pick: many[0] if len(many) == 1 else pick(*many)
    return out.select(*docs.columns, "n_words", total.cast("long").alias("n_base"), some(firsts, F.least).alias("first_word"), some(lasts, F.greatest).alias("last_word"), F.array_compact(F.array(*labels)).alias("base"))


def once(value: Column) -> Column:
    """The value as a generator's column: Spark works it out once a row. As a plain column it would put the whole expression in the place
    of every use of it in a filter, and so once per element if a lambda uses it. One to a select."""
    return F.explode(F.array(value))


def held_words(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Adds held, the template words of each text that has any, in the vocabulary's order."""
    held = F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split(F.lower("text"), GAP))
    return docs.select("doc_id", "text_key", "text", once(held).alias("held")).where(F.size("held") > 0)


def matching_blocks(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """(doc_id, text_key, block, label, containment): for each template that documents (doc_id, text_key, text) match, the first word
    of the best block, from 0."""
    spark = docs.sparkSession
    sets = [(label, words_of(t)) for label, t in templates]
    width = max(len("".join(c if c.isalnum() else " " for c in t).split()) for _, t in templates)
    vocabulary = sorted({w for _, ws in sets for w in ws})
    counted = held_words(docs, vocabulary).select(F.explode("held").alias("word")).groupBy("word").count()
    frequency = {r["word"]: r["count"] for r in counted.collect()}  # at most the templates' words
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    index, needs, prefixes = [], [], set()
    for t, (label, ws) in enumerate(sets):
        ws = sorted(ws, key=place.get)
        need = math.ceil(threshold * len(ws) - 1e-9)
        needs.append(need)
        prefixes |= set(ws[: len(ws) - need + 1])
        index += [(w, t, label, p, len(ws), need, ws) for p, w in enumerate(ws[: len(ws) - need + 1])]
    index = spark.createDataFrame(index, "word string, template int, label string, p int, n int, need int, words array<string>")
    prefixes = F.array(*map(F.lit, sorted(prefixes)))
    texts = held_words(docs, order).where((F.size("held") >= min(needs)) & F.arrays_overlap("held", prefixes))
    rare = F.filter(F.transform("held", lambda w, q: F.struct(q.alias("q"), w.alias("word"))), lambda x: F.array_contains(prefixes, x["word"]))
    joined = texts.withColumn("x", F.explode(rare)).select("doc_id", "text_key", "text", "held", "x.q", "x.word").join(F.broadcast(index), "word")
    length = F.size("held") >= F.col("need")
    position = F.least(F.col("n") - F.col("p"), F.size("held") - F.col("q")) >= F.col("need")
    # of several joined words of a pair the first in the order speaks for it; the words before it aren't shared, so its bound holds
    first = F.element_at(F.array_intersect("words", "held"), 1) == F.col("word")
    pairs = joined.where(length & first & position & (F.size(F.array_intersect("held", "words")) >= F.col("need")))
    # a best block starts with a word of the template
    own = F.filter(F.split(F.lower("text"), GAP), lambda w: w != "")
    hits = F.filter(F.transform(own, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: F.array_contains("words", x["word"]))

    def block(h, k):
        inside = F.filter(F.slice("hits", k + 1, F.lit(width)), lambda x: x["at"] < h["at"] + width)
        return F.struct(F.size(F.array_distinct(F.transform(inside, lambda x: x["word"]))).alias("shared"), (-h["at"]).alias("back"))

    best = pairs.withColumn("hits", once(hits)).withColumn("best", once(F.array_max(F.transform("hits", block)))).where("best.shared >= need")
    return best.select("doc_id", "text_key", (-F.col("best.back")).alias("block"), "label", (F.col("best.shared") / F.col("n")).alias("containment"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base, found, score) of documents (doc_id, text)."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    scratch = Scratch(docs.sparkSession, "licences")
    found = matching_blocks(keyed, templates, threshold).groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    found = scratch.table(found, "found").withColumnRenamed("doc_id", "d").withColumnRenamed("text_key", "k")
    light = phrase_places(keyed, phrases).drop("text")
    both = light.join(found, light.doc_id.eqNullSafe(found.d) & (light.text_key == found.k), "left")
    none = F.array().cast("array<string>")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base", F.coalesce("found", none).alias("found"), score.alias("score"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir, "doc_id", "text"))
    listed = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", listed(F.col("base")).alias("base_labels"), listed(F.concat("base", "found")).alias("labels"), "score")


def _oracle(phrases: dict[str, str] = PHRASES, templates=TEMPLATES, threshold: float = 0.9) -> str:
    """The scan in DuckDB: every place and every line against every template."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = "list_filter(regexp_split_to_array({}, '" + GAP + "'), lambda x: x <> '')"
    places, labels = [], []
    for phrase, label in phrases.items():
        parts = phrase.split(" ")
        at = " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(parts))
        places.append(f"list_filter(range(1, len(ws) + 1), lambda i: {at})")
        labels.append(f"CASE WHEN len({places[-1]}) > 0 THEN ['{label}'] ELSE [] END")
    rows = ", ".join(f"('{label}', {words_of(t)!r})" for label, t in templates)
    return f"""WITH w AS (SELECT doc_id, {lower.format("coalesce(text, '')")} AS t FROM documents),
b AS (SELECT doc_id, {words.format('t')} AS ws FROM w),
p AS (SELECT doc_id, len(ws) AS n, list_concat(list_concat({places[0]}, {places[1]}), {places[2]}) AS spots, list_concat(list_concat({labels[0]}, {labels[1]}), {labels[2]}) AS base FROM b),
t(label, ws) AS (VALUES {rows}),
l AS (SELECT doc_id, {words.format('line')} AS own FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)),
f AS (SELECT doc_id, list(label) AS found, max(c) AS c FROM (SELECT doc_id, label, CAST(len(list_intersect(ws, own)) AS DOUBLE) / len(ws) AS c FROM l, t) WHERE c >= {threshold} - 1e-9 GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(spots) AS BIGINT) AS n_base, list_min(spots) - 1 AS first_word, list_max(spots) - 1 AS last_word, array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels, CASE WHEN len(spots) > 0 THEN 1.0 ELSE coalesce(c, 0.0) END AS score FROM p LEFT JOIN f USING (doc_id)"""


ORACLE = _oracle()
