"""License scan: fixed phrases, and an exact set-similarity join of text blocks against notice templates.

The join is native DataFrame code. A block is a run of words, whatever lines it stands on: any run as long as SPAN times
the template (or the whole of a shorter text). Tokens are ordered by how many documents hold them, rarest first. A
block that holds at least ``threshold`` of a template's tokens holds one of its few rarest ones (prefix filter), has
enough tokens (length filter) and, from its first shared token on, enough tokens left (positional filter); only what
passes all three is compared in full.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases (words in a row) and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Labels and notices whose words, in any order, mark a block. One-line notices, then the customary full texts.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        " files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy,"
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
        " Software is furnished to do so, subject to the following conditions",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
        " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
        " disclaimer in the documentation and/or other materials provided with the distribution",
    ),
    (
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
        " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"
        " with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: Share of a template's distinct tokens that a block must hold, and words of a block for each word of the template.
THRESHOLD, SPAN = 0.9, 1.5


def _spaced(text: Column) -> Column:
    """A-Z lower-cased, every run of separators as one space.

    lower() differs from lower-casing A-Z alone only outside ASCII, but for the Kelvin sign, which it makes a k.
    """
    text = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("å")))
    return F.regexp_replace(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _template_words(text: str) -> list[str]:
    """The words of a template, in order, with repetitions."""
    return "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in text).split()


def template_rows(templates, threshold: float = THRESHOLD, span: float = SPAN) -> list[tuple[str, list[str], int, int]]:
    """Label, distinct tokens, how many a block must hold, and the words of a block, of each template."""
    out = []
    for label, text in templates:
        words = _template_words(text)
        tokens = list(dict.fromkeys(words))
        out.append((label, tokens, math.ceil(threshold * len(tokens) - 1e-9), math.ceil(span * len(words))))
    return out


def _phrase_columns(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """n_base, first_word, last_word and base (labels) from ``wide``: the words with two spaces around each."""
    wide = F.col("wide")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        words = phrase.split()
        mark = " " + "  ".join(words) + " "
        here = wide.contains(mark)
        # two spaces a word boundary: places that share no word share no character of their marks
        counts.append(F.when(here, (F.length("wide") - F.length(F.replace(wide, F.lit(mark), F.lit("")))) / len(mark)).otherwise(0))
        before = F.substring_index(wide, mark, 1)
        after = F.substring_index(wide, mark, -1)
        words_in = lambda c: F.floor((F.length(c) - F.length(F.replace(c, F.lit("  "), F.lit(" ")))))
        firsts.append(F.when(here, words_in(before) + F.when(F.length(before) > 0, 1).otherwise(0)))
        rest = words_in(after) + F.when(F.length(after) > 0, 1).otherwise(0)
        lasts.append(F.when(here, F.col("n_words") - rest - len(words)))
        labels.append(F.when(here, F.lit(label)))
    total = sum(counts[1:], counts[0])
    least = (F.least(*firsts) if len(firsts) > 1 else firsts[0]).cast("bigint")
    most = (F.greatest(*lasts) if len(lasts) > 1 else lasts[0]).cast("bigint")
    return docs.withColumns(
        {
            "n_base": F.round(total).cast("bigint"),
            "first_word": least,
            "last_word": most,
            "base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
        }
    )


def token_frequency(docs: DataFrame, words: list[str], text_col: str = "text") -> list[str]:
    """The given words (a fixed, small list) ordered by the number of documents that hold them, rarest first, then by name."""
    held = F.array_intersect(F.split(_spaced(docs[text_col]), " "), F.array(*map(F.lit, words)))
    rows = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("df")).collect()
    df = {r["word"]: r["df"] for r in rows}
    return sorted(words, key=lambda w: (df.get(w, 0), w))


def block_matches(
    docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, span: float = SPAN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Where a block holds at least ``threshold`` of a template's tokens: doc_id, text_hash, label, containment, stretch.

    Texts are cut into cells as long as the longest block; a stretch is two cells that follow each other, so every
    block lies in the stretch that its first word's cell opens. containment is the largest of the stretch's blocks.
    """
    spark = docs.sparkSession
    known = template_rows(templates, threshold, span)
    order = token_frequency(docs, sorted({w for _, tokens, _, _ in known for w in tokens}), text_col)
    rank = {w: k for k, w in enumerate(order)}
    prefixes = []
    for label, tokens, need, size in known:
        tokens = sorted(tokens, key=rank.__getitem__)
        prefix = tokens[: len(tokens) - need + 1]
        prefixes += [(w, k + 1, label, need, size, prefix, tokens) for k, w in enumerate(prefix)]
    schema = "token string, template_at int, label string, need int, size int, prefix array<string>, tokens array<string>"
    prefix = spark.createDataFrame(prefixes, schema)
    openers = sorted({p[0] for p in prefixes}, key=rank.__getitem__)
    cell = max(size for _, _, _, size in known)

    spaced = F.concat(F.lit(" "), F.trim(_spaced(docs[text_col])), F.lit(" "))
    promising = docs.select(
        docs[id_col].cast("bigint").alias("doc_id"), F.xxhash64(docs[text_col].cast("string")).alias("text_hash"), spaced.alias("spaced")
    ).where(F.col("spaced").rlike(" (" + "|".join(map(re.escape, openers)) + ") "))
    words = promising.select("doc_id", "text_hash", F.split(F.trim("spaced"), " ").alias("words"))
    opening = F.array(*map(F.lit, openers))
    places = F.transform("words", lambda w, i: F.when(F.array_contains(opening, w), i))
    cells = F.transform(F.array_compact(places), lambda i: F.floor(i / cell).cast("int"))
    cells = F.array_distinct(F.flatten(F.transform(cells, lambda c: F.array(F.greatest(c - 1, F.lit(0)), c))))
    stretches = words.select("doc_id", "text_hash", F.explode(F.transform(cells, lambda c: F.struct(c.alias("stretch"), F.slice("words", c * cell + 1, 2 * cell).alias("words")))).alias("s"))
    stretches = stretches.select("doc_id", "text_hash", "s.stretch", "s.words")

    opened = stretches.select("*", F.explode(F.array_intersect("words", opening)).alias("token")).join(F.broadcast(prefix), "token")
    candidates = (
        opened.where(F.element_at(F.array_intersect("prefix", "words"), 1) == F.col("token"))  # once for each template: by its rarest token here
        .where(F.size("words") >= F.col("need"))
        .where(F.size(F.array_intersect(F.expr("slice(tokens, template_at, size(tokens))"), "words")) >= F.col("need"))
    )
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(cell), F.size("words") - F.col("size") + 1)))
    held = F.array_max(F.transform(starts, lambda p: F.size(F.array_intersect("tokens", F.slice("words", p, F.col("size"))))))
    return (
        candidates.withColumn("held", held)
        .where(F.col("held") >= F.col("need"))
        .select("doc_id", "text_hash", "label", (F.col("held") / F.size("tokens")).alias("containment"), "stretch")
    )


def scan(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD, span: float = SPAN,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document row: n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 with a base place, else the largest containment among matched blocks (runs of words), else 0. A null text
    counts as empty: no words, no places, empty labels, score 0. Null ids stay null, repeated rows each get a row
    (with equal results), other columns are not read, and an empty table gives an empty result.
    """
    found = (
        block_matches(docs, templates, threshold, span, id_col, text_col)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    )
    spaced = F.trim(_spaced(docs[text_col]))
    base = (
        docs.select(
            docs[id_col].cast("bigint").alias("doc_id"),
            F.xxhash64(docs[text_col].cast("string")).alias("text_hash"),
            spaced.alias("spaced"),
        )
        .withColumn("gaps", F.length("spaced") - F.length(F.replace("spaced", F.lit(" "), F.lit(""))))
        .withColumn("n_words", F.when(F.col("spaced") == "", 0).otherwise(F.col("gaps") + 1).cast("bigint"))
        .withColumn("wide", F.concat(F.lit(" "), F.replace("spaced", F.lit(" "), F.lit("  ")), F.lit(" ")))
    )
    base = _phrase_columns(base, phrases).select("doc_id", "text_hash", "n_words", "n_base", "first_word", "last_word", "base")
    same = base["doc_id"].eqNullSafe(found["doc_id"]) & (base["text_hash"] == found["text_hash"])
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base", F.coalesce(found["more"], none)))
    return base.join(found, same, "left").select(
        base["doc_id"],
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.round("best", 6), F.lit(0.0))).alias("score"),
    )
