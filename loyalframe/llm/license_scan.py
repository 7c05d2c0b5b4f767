"""License scan by diagonal voting, in DataFrame expressions only.

Templates are license phrases, notices and grants as word sequences. The
hash of every ``k`` words of a text is joined to the templates' hashes; a hit
at word ``d`` of the text and word ``t`` of a template votes for the diagonal
``d - t``, that is for the template starting there. Votes are summed per
(text, template, diagonal) and weak diagonals dropped. A phrase must have
every vote on one diagonal. For a notice, diagonals at most ``gap`` apart are
merged, as an inserted or missing word shifts the rest of the notice to a
neighbouring diagonal. A hit counts only if its words, not just their hash,
are the template's, and spans are verified on these hits: the share of the
template's words that they cover is the span's score.

Texts are known by a 128-bit hash: copies vote once, and only hits are
shuffled, never texts or their other words. The templates are a parameter; Spark broadcasts their
hashes while they are below its threshold and shuffles both sides beyond. Of a
text only the ``k`` words that all occur in templates are hashed: others match none.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loyalframe.llm.common import materialize, text_of, unkept

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# all but [\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]: a regular expression tests ranges that hold faster than ranges that don't
WORD = r"[a-z0-9A-Z\x{80}-\x{10FFFF}]+"
# a larger vocabulary of templates is no longer a list in the plan; all grams are joined then
LISTED_WORDS = 10_000
# fixed values: phrases, found at every place where their words stand consecutively
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# fixed values: notices and grants of well-known licenses, found also when slightly changed
NOTICES = (
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
              "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
              "option) any later version."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
              "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
              "option) any later version."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
              "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at "
                 "http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                  "binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
)


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased; ``lower`` does just that to ASCII texts, and much faster."""
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def vocabulary_of(texts) -> list | None:
    """The distinct words of template texts; None if too many to be listed."""
    lowered = (t.translate(str.maketrans(UPPER, LOWER)) for t in texts)
    words = {w for t in lowered for w in re.findall(r"[a-z0-9\x80-\U0010FFFF]+", t)}
    return sorted(words) if len(words) <= LISTED_WORDS else None


def grams_of(words: str, k: int, vocabulary: list | None = None) -> Column:
    """``at, hash, said`` of the ``k`` words from each word on; the last ``k - 1`` words start none.

    Given a vocabulary, only grams of its words alone are made.
    """
    def gram(i: Column) -> list[Column]:
        return [F.get(words, i + j) for j in range(k)]

    def wanted(i: Column) -> Column:
        if vocabulary is None:
            return gram(i)[-1].isNotNull()
        return reduce(and_, [w.isin(vocabulary) for w in gram(i)])

    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0))), wanted)
    return F.transform(starts, lambda i: F.struct(
        i.alias("at"), F.xxhash64(*gram(i)).alias("hash"), F.concat_ws(" ", *gram(i)).alias("said")))


def template_table(spark: SparkSession, phrases, notices, k: int) -> DataFrame:
    """``template, label, exact, tw`` (words); a template of fewer than ``k`` words is an error."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(exact).alias("exact"), F.lit(text).alias("text"))
            for i, (exact, label, text) in enumerate([*[(True, *p) for p in phrases], *[(False, *n) for n in notices]])]
    rows = F.array(*rows) if rows else F.array().cast("array<struct<template:int,label:string,exact:boolean,text:string>>")
    df = spark.range(1).select(F.inline(rows)).select("template", "label", "exact", words_of(F.col("text")).alias("tw"))
    short = F.raise_error(F.concat(F.lit("template shorter than the gram: "), F.array_join("tw", " ")))
    # written, so that the planner knows its size before it broadcasts
    return materialize(df.withColumn("tw", F.when(F.size("tw") < k, short.cast("array<string>")).otherwise(F.col("tw"))), "templates")


def spans_of_texts(texts: DataFrame, templates: DataFrame, vocabulary: list | None, k: int, min_votes: int, gap: int,
                   coverage: float) -> DataFrame:
    """``k1, k2, spans``: the verified spans of each text that has any.

    ``texts``: k1, k2 (the text's hash) and words; a text may occur many
    times. A text's list is bounded by its own length.
    """
    hits = texts.select("k1", "k2", F.inline(grams_of("words", k, vocabulary)).alias("d", "hash", "said"))
    index = templates.select("template", F.inline(grams_of("tw", k)).alias("t", "hash", "meant"))
    hits = hits.join(index, "hash").where(F.col("said").startswith(F.col("meant")) & F.col("meant").startswith(F.col("said")))
    votes = hits.groupBy("k1", "k2", "template", (F.col("d") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("ts"))
    sizes = templates.select("template", "label", "exact", F.size("tw").alias("size"))
    full = F.col("size") - k + 1
    strong = votes.join(sizes, "template").where(F.size("ts") >= F.when(F.col("exact"), full).otherwise(F.least(F.lit(min_votes), full)))
    along = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(along) > gap), F.lit(True))
    merged = strong.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(along))
    covered = F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + (k - 1)))))
    merged = merged.select("*", covered.alias("covered")).groupBy("k1", "k2", "template", "span", "label", "exact", "size").agg(
        F.min(F.col("diagonal") + F.array_min("ts")).alias("start"), F.max(F.col("diagonal") + F.array_max("ts") + k).alias("end"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("covered")))) / F.col("size")).alias("score"))
    sure = merged.where(F.col("exact") | ((F.col("score") >= coverage) & (F.col("end") - F.col("start") <= 2 * F.col("size"))))
    # of notices that overlap, directly or through others, the best fitting stay: versions of one notice differ in a word
    ahead = Window.partitionBy("k1", "k2", "exact").orderBy("start", "end", "label").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("k1", "k2", "exact").orderBy("start", "end", "label").rowsBetween(Window.unboundedPreceding, 0)
    sure = sure.withColumn("apart", F.coalesce(F.max("end").over(ahead) <= F.col("start"), F.lit(True)).cast("int"))
    sure = sure.withColumn("island", F.sum("apart").over(upto))
    best = F.max("score").over(Window.partitionBy("k1", "k2", "exact", "island"))
    sure = sure.withColumn("best", best).where(F.col("score") == F.col("best"))
    return sure.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label", "exact", "score"))).alias("spans"))


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES, k: int = 3, min_votes: int = 3, gap: int = 8,
                  coverage: float = 0.75, keep: tuple = ()) -> DataFrame:
    """``doc_id, n_words, spans`` per row of ``docs``.

    ``spans``: array of (start, end, label, exact, score) in order of start,
    in words from 0, the end exclusive. A phrase's span is exact and scores
    1; a notice's score is the share of its words within equal runs of
    ``k`` words, ``coverage`` at least, in a span of at most twice its words.
    Of notices that overlap, directly or through others, only those of the
    best score stay; phrases may overlap them and each other.

    A null text is the empty text and has no words; texts of any length are
    scanned whole; repeated rows have equal results. An empty table gives an
    empty result, no templates no spans. Extra columns are ignored unless
    named in ``keep``.
    """
    templates = template_table(docs.sparkSession, phrases, notices, k)
    text = text_of()
    keys = F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")
    vocabulary = vocabulary_of(t for _, t in [*phrases, *notices])
    found = materialize(spans_of_texts(docs.select(*keys, words_of(text).alias("words")), templates, vocabulary, k, min_votes, gap, coverage), "spans")
    df = docs.select("doc_id", *keys, F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
                     *[F.col(c).alias(f"_keep_{c}") for c in keep])
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))
    return df.join(found, ["k1", "k2"], "left").select("doc_id", "n_words", spans.alias("spans"), *unkept(keep))


def license_report(docs: DataFrame, **params) -> DataFrame:
    """Counts and labels of the phrases, labels and best score of all spans, one row per document row."""
    df = scan_licenses(docs, **params).withColumn("_base", F.filter("spans", lambda s: s["exact"]))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.col(c)["label"])), ",")
    return df.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.col("_base")["start"]).cast("long").alias("first_word"),
        F.array_max(F.col("_base")["start"]).cast("long").alias("last_word"),
        labels("_base").alias("base_labels"), labels("spans").alias("labels"),
        F.coalesce(F.array_max(F.col("spans")["score"]), F.lit(0.0)).alias("score"))
