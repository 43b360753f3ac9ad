"""Licence statements in texts: Dice coefficient over word bigrams against licence templates.

A text's passages are its lines, its sentences, its paragraphs and the whole.
A passage and a template are compared as sets of bigrams of normalised words:
lower case, every run of characters other than letters and digits a space. The
coefficient reaches ``threshold`` only if the passage's set is at least
t / (2 - t) and at most (2 - t) / t times as large as the template's, so other
templates are not compared. It also asks for a share of the template's bigrams
so large that one of a few anchor words must be among them; texts without an
anchor word are passed over before anything is split.

A passage counts for its best template; ties go to the first by name. Null and
empty texts, and passages of one word, match nothing. Repeated rows count once
under their id and text. Very long texts are read whole. An empty table gives
an empty table; other columns do not matter.

Everything is built-in functions. The templates are a constant of this module,
some hundreds of bigrams, or the caller's table, whose join Spark plans by size.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.shared import tidy, written

THRESHOLD = 0.75

# Notices and opening passages of well-known licences, by licence.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "all-rights-reserved": ("All rights reserved.",),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an '
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "bsd": (
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY-SA.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc0": ("Released under CC0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License.",
        "Released under the GPL.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
}


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def bigrams(words: Column) -> Column:
    """The distinct pairs of neighbouring words."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def passages(text: Column) -> Column:
    """Normalised lines, sentences, paragraphs and the whole, each once."""
    sentences = F.split(F.regexp_replace(text, "([.!?])\\s+", "$1\n"), "\n")
    parts = F.concat(F.split(text, "\n"), sentences, F.split(text, "\n\\s*\n"), F.array(text))
    return F.array_distinct(F.transform(parts, normalised))


#: Words at least so long are rare enough to look for alone; shorter ones are looked for in pairs.
ANCHOR_LENGTH = 7


def anchors(templates: Mapping[str, tuple[str, ...]], threshold: float) -> list[str]:
    """Patterns of which every lower-case passage that reaches the threshold matches one.

    Such a passage has at least t / (2 - t) of a template's bigrams. Words, then pairs of words, are chosen until so few
    of each template's bigrams are without one that those alone would not do; what stands in many templates goes first.
    """
    open_sets = []
    for texts in templates.values():
        for text in texts:
            words = re.findall(r"[^\W_]+", text.lower())
            pairs = set(zip(words, words[1:]))
            open_sets.append((pairs, threshold / (2 - threshold) * len(pairs)))
    chosen: set[tuple[str, ...]] = set()
    while True:
        left = []
        for pairs, least in open_sets:
            free = {p for p in pairs if p not in chosen and not {(w,) for w in p} & chosen}
            if len(free) >= least:
                left.append(free)
        if not left:
            return sorted("[^\\p{L}\\p{N}]+".join(map(re.escape, x)) for x in chosen)
        words = {(w,) for free in left for p in free for w in p if len(w) >= ANCHOR_LENGTH}
        open_now = words or {p for free in left for p in free}
        chosen.add(max(sorted(open_now), key=lambda x: (sum(any(set(x) <= set(p) for p in free) for free in left), sum(map(len, x)))))


@tidy
def find_licenses(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: Mapping[str, tuple[str, ...]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document and licence found: ``doc_id``, ``license``, ``dice`` of the best passage, that normalised ``passage``, ``n_passages``."""
    spark = df.sparkSession
    rows = [(f"{name}/{k}", name, t) for name, texts in sorted(templates.items()) for k, t in enumerate(texts)]
    own = spark.createDataFrame(rows, "template string, license string, text string")
    own = own.withColumn("pairs", bigrams(F.split(normalised(F.col("text")), " ")))
    own = own.select("template", "license", F.size("pairs").alias("m"), F.explode("pairs").alias("pair"))

    has_anchor = F.lower("text").rlike("|".join(anchors(templates, threshold)))
    texts = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(has_anchor)
    units = texts.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.explode(passages(F.col("text"))).alias("passage"))
    sized = units.withColumn("pairs", bigrams(F.split("passage", " "))).withColumn("n", F.size("pairs")).where("n > 0")
    shared = (
        sized.select("doc_id", "row", F.xxhash64("passage").alias("unit"), "n", F.explode("pairs").alias("pair"))
        .join(own, "pair")
        .where((F.col("n") * (2 - threshold) >= F.col("m") * threshold) & (F.col("n") * threshold <= F.col("m") * (2 - threshold)))
        .groupBy("doc_id", "row", "unit", "n", "template", "license", "m").agg(F.count_distinct("pair").alias("both"))
        .withColumn("dice", 2 * F.col("both") / (F.col("n") + F.col("m")))
        .where(F.col("dice") >= threshold)
    )
    first = Window.partitionBy("doc_id", "row", "unit").orderBy(F.desc("dice"), "template")
    best = written(shared.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place"))
    # The passages' words are looked up again for the few that matched, instead of travelling with every bigram.
    named = units.withColumn("unit", F.xxhash64("passage")).join(best.select("row", "unit", "license", "dice").distinct(), ["row", "unit"])
    return named.groupBy("doc_id", "row", "license").agg(
        F.max("dice").alias("dice"),
        F.min(F.struct(-F.col("dice"), "passage"))["passage"].alias("passage"),
        F.count_distinct("passage").alias("n_passages"),
    ).drop("row")


def oracle_sql(templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB's SQL, from all passages and templates."""
    rows = ", ".join(
        "({}, {}, {})".format(*("'" + x.replace("'", "''") + "'" for x in (f"{name}/{k}", name, t)))
        for name, texts in sorted(templates.items()) for k, t in enumerate(texts)
    )
    norm = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))".format
    pairs = (
        "list_distinct(list_transform(range(1, len(string_split({x}, ' '))), lambda i: "
        "string_split({x}, ' ')[i] || ' ' || string_split({x}, ' ')[i + 1]))"
    )
    return f"""
WITH templates(template, license, words) AS (SELECT t, l, {norm('x')} FROM (VALUES {rows}) v(t, l, x)),
own AS (SELECT template, license, {pairs.format(x='words')} AS pairs FROM templates),
texts AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
parts AS (
    SELECT doc_id, text, unnest(string_split(text, chr(10))) AS part FROM texts
    UNION ALL SELECT doc_id, text, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))) FROM texts
    UNION ALL SELECT doc_id, text, unnest(string_split_regex(text, '\\n\\s*\\n')) FROM texts
    UNION ALL SELECT doc_id, text, text FROM texts),
units AS (SELECT DISTINCT doc_id, text, {norm('part')} AS passage FROM parts),
sized AS (SELECT doc_id, text, passage, {pairs.format(x='passage')} AS pairs FROM units),
scored AS (
    SELECT doc_id, text, passage, template, license,
        2.0::DOUBLE * len(list_intersect(s.pairs, o.pairs)) / (len(s.pairs) + len(o.pairs)) AS dice
    FROM sized s JOIN own o ON len(s.pairs) > 0
        AND len(s.pairs) * (2 - {threshold}) >= len(o.pairs) * {threshold} AND len(s.pairs) * {threshold} <= len(o.pairs) * (2 - {threshold})),
best AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id, text, passage ORDER BY dice DESC, template) AS place FROM scored WHERE dice >= {threshold})
SELECT doc_id, license, max(dice) AS dice, arg_min(passage, (-dice, passage)) AS passage, count(DISTINCT passage) AS n_passages
FROM best WHERE place = 1 GROUP BY doc_id, text, license"""
