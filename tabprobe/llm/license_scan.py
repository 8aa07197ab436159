"""License scan by diagonal voting, with DataFrame operations only.

Every rolling word k-gram of every text is joined by its hash to the places of the templates that
hold the same k-gram; the words themselves are compared in the join's condition, so a hash collision
gives no vote. A vote falls on a diagonal (place in the text less place in the template): a text that
holds a template unchanged votes on one diagonal, and a word added or left out moves the rest to a
neighbouring one. Votes are summed by diagonal on the map side, neighbouring diagonals are merged,
and the merged span is verified: how many of the template's words it covers, against the longer of
template and span, and whether all its numbers (versions) are among them.

Only votes are shuffled, never texts: each text is split once, and a marker row per document carries
its word count past the join. All grouping keys hold the document, so no template or phrase is hot.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.llm.text import LOWER, UPPER, key128, whole

#: What stands between words: ASCII but letters and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GRAM = 3
#: Diagonals at most so far apart are merged.
DRIFT = 3
LEAST_SCORE = 0.8
#: Grams (some 100 bytes each) that may be sent to every executor; beyond, Spark joins by shuffling.
BROADCAST_GRAMS = 100_000


@dataclass(frozen=True)
class Template:
    """A text to look for. A ``phrase`` counts only where its words stand consecutively; another
    template also where some words were added, left out or changed."""

    label: str
    text: str
    phrase: bool = False


PHRASES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)

# Opening sentences of public license notices.
NOTICES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
                    " following conditions are met"),
    Template("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    Template("gpl-notice", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by"
                           " the Free Software Foundation"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
                    " documentation files"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)


def template_words(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.translate(str.maketrans(UPPER, LOWER))) if w]


def gram_rows(templates: Sequence[Template]) -> list[tuple]:
    """(tpl, label, phrase, length, k, numbers, tpos, w0, w1, w2): a row for each k-gram of each template.

    k is ``GRAM``, or 2 for templates of two words, whose w2 is null."""
    rows = []
    for i, t in enumerate(templates):
        words = template_words(t.text)
        if len(words) < 2:
            raise ValueError(f"a template needs two words at least: {t.text!r}")
        k = min(GRAM, len(words))
        numbers = [] if t.phrase else [j for j, w in enumerate(words) if w.isdigit()]
        rows += [(i, t.label, t.phrase, len(words), k, numbers, j, *words[j:j + k], *[None] * (GRAM - k)) for j in range(len(words) - k + 1)]
    return rows


def words_of(text: Column) -> Column:
    """The words, A-Z lower-cased. ASCII texts are lowered whole, which is much faster."""
    lower = lambda w: F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    cut = lambda t: F.array_remove(F.split(t, GAP), "")
    return F.when(F.octet_length(text) == F.char_length(text), cut(F.lower(text))).otherwise(F.transform(cut(text), lower))


def _votes(docs: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """Rows (id, k1, k2, n_words, template columns, diag, at, copies): template places that vote for a
    diagonal; and a row without template for each document, where ``copies`` counts equal rows."""
    spark, rows = docs.sparkSession, gram_rows(templates)
    sizes = sorted({r[4] for r in rows})
    grams = spark.createDataFrame(rows, "tpl int, label string, phrase boolean, length int, k int, numbers array<int>, tpos int, "
                                        "t0 string, t1 string, t2 string")
    grams = grams.withColumn("h", F.when(F.col("k") == 2, F.xxhash64("t0", "t1")).otherwise(F.xxhash64("t0", "t1", "t2"))).withColumnRenamed("k", "tk")
    w = F.col("words")
    none = F.lit(None).cast("struct<w0:string,w1:string,w2:string>")
    runs = F.transform(F.arrays_zip(w.alias("a"), F.slice(w, 2, F.size(w)).alias("b"), F.slice(w, 3, F.size(w)).alias("c")),
                       lambda x: F.struct(x["a"].alias("w0"), x["b"].alias("w1"), x["c"].alias("w2")))
    hashes = {2: F.xxhash64("w0", "w1"), 3: F.xxhash64("w0", "w1", "w2")}
    placed = (docs.withColumn("n_words", F.size("words").cast("long"))
              .select("id", "k1", "k2", "n_words", F.posexplode(F.concat(F.array(none), runs)).alias("place", "x"))
              .select("id", "k1", "k2", "n_words", "place", "x.*")
              .withColumn("g", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), hashes[k].alias("h")) for k in sizes])))
              .select("id", "k1", "k2", "n_words", "place", "w0", "w1", "w2", F.col("g.k").alias("gk"), F.col("g.h").alias("gh"))
              .where((F.col("place") > 0) | (F.col("gk") == sizes[0])))
    if len(rows) <= BROADCAST_GRAMS:
        grams = F.broadcast(grams)
    same = ((F.col("gk") == F.col("tk")) & (F.col("gh") == F.col("h")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1"))
            & (F.col("t2").isNull() | (F.col("w2") == F.col("t2"))))
    # place 0 is the document's marker: no words, hence no vote; word p stands at place p + 1.
    met = placed.join(grams, same, "left").where((F.col("place") == 0) | F.col("tpl").isNotNull())
    return (met.groupBy("id", "k1", "k2", "n_words", "tpl", "label", "phrase", "length", "tk", "numbers",
                        (F.col("place") - 1 - F.col("tpos")).cast("long").alias("diag"))
            .agg(F.collect_set("tpos").alias("at"), F.count("*").alias("copies")))


def _spans(votes: DataFrame, drift: int, least_score: float) -> DataFrame:
    """Neighbouring diagonals merged and verified: one row per span, and the documents' marker rows."""
    w = Window.partitionBy("id", "k1", "k2", "tpl").orderBy("diag")
    reach = F.when(F.col("phrase"), -1).otherwise(F.least(F.lit(drift), F.expr("(length - 1) div 2")))
    new = F.coalesce(F.col("diag") - F.lag("diag").over(w) > reach, F.lit(True)).cast("int")
    merged = (votes.withColumn("new", new).withColumn("grp", F.sum("new").over(w))
              .groupBy("id", "k1", "k2", "n_words", "tpl", "label", "phrase", "length", "tk", "numbers", "grp")
              .agg(F.collect_list(F.struct("diag", "at")).alias("diags"), F.max("copies").alias("copies")))
    places = lambda f: F.flatten(F.transform("diags", lambda d: F.transform(d["at"], lambda t: f(d["diag"], t))))
    covered = F.array_distinct(F.flatten(places(lambda _, t: F.sequence(t, t + F.col("tk") - 1))))
    out = (merged.withColumn("covered", covered)
           .withColumn("first_word", F.array_min(places(lambda d, t: d + t)))
           .withColumn("last_word", F.array_max(places(lambda d, t: d + t + F.col("tk") - 1)))
           .withColumn("score", F.size("covered") / F.greatest(F.col("length").cast("long"), F.col("last_word") - F.col("first_word") + 1)))
    full = F.size("covered") == F.col("length")
    held = F.size(F.array_except("numbers", "covered")) == 0
    # Of a phrase there are only places that hold it whole; a part of one is nothing.
    return (out.withColumn("found", F.when(F.col("phrase"), full).otherwise(held & (F.col("score") >= least_score)))
            .withColumn("score", F.when(F.col("phrase"), full.cast("double")).otherwise(F.col("score"))))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[Template] = PHRASES,
                  notices: Sequence[Template] = NOTICES, drift: int = DRIFT, least_score: float = LEAST_SCORE) -> DataFrame:
    """License phrases and notices in every whole text.

    Returns per input row: id_col, ``n_words``, ``n_base`` (places of phrases), ``first_word`` and
    ``last_word`` (their smallest and largest start, from 0; null without any), ``base_labels`` (of
    phrases) and ``labels`` (of notices too), both distinct, sorted and comma-joined ('' without any), ``score`` (1
    with a phrase, else the best share of a notice that a span covers, 0 without one vote), and
    ``spans`` (array of label, first_word, last_word, score of what was found, in order).

    Null text is empty and has no words. Rows that repeat id and text each get their row; null ids are
    kept. An empty table gives an empty table.
    """
    text = whole(F.col(text_col))
    base = docs.select(F.col(id_col).alias("id"), *key128(text), words_of(text).alias("words"))
    spans = _spans(_votes(base, [*phrases, *notices]), drift, least_score)
    phrase, found = F.col("phrase"), F.col("found")
    span = F.struct("first_word", "last_word", "label", "score")
    listed = lambda keep: F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("label")))), ",")
    out = spans.groupBy("id", "k1", "k2", "n_words").agg(
        F.max(F.when(F.col("tpl").isNull(), F.col("copies"))).alias("copies"),
        F.count_if(phrase & found).alias("n_base"),
        F.min(F.when(phrase & found, F.col("first_word"))).alias("first_word"),
        F.max(F.when(phrase & found, F.col("first_word"))).alias("last_word"),
        listed(phrase & found).alias("base_labels"), listed(found).alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(found, span))).alias("spans"))
    return (out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
            .select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"))
