"""Licence scan: lines, paragraphs and whole texts compared with licence templates by Dice's coefficient over word bigrams.

The coefficient of bigram sets of sizes a and b is at most 2 min(a, b) / (a + b), so a template is compared only where its
size is between similarity / (2 - similarity) times that of the text's and its inverse.

Notices that share their lines with other words are found in windows: what is left of a text without the units that match
is compared in runs of as many words as a template, from each of the template's bigrams on, and at the end. Only texts with as many of a
template's bigrams as a similar window needs are looked through. All in DataFrame functions, within the row: no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIMILARITY = 0.8

# Notices by which texts name their licence, and short licence texts.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def n_words(text: str) -> int:
    return len(re.sub(r"[\W_]+", " ", text.lower()).split())


def _templates(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    return [(name, bigrams(text)) for name, texts in templates.items() for text in texts if bigrams(text)]


def _lines(text: Column) -> Column:
    normal = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")
    return F.transform(F.split(normal, "\n"), lambda x: F.trim(x))


def _paragraphs(lines: Column) -> Column:
    return F.split(F.array_join(lines, "\n"), "\n\n+")


def _flat(paragraph: Column) -> Column:
    return F.trim(F.regexp_replace(paragraph, "\n+", " "))


def units(text: Column) -> Column:
    """Normalised lines, paragraphs of several lines and whole text, in words with single spaces, each once; a null text has none."""
    lines = _lines(text)
    several = F.transform(F.filter(_paragraphs(lines), lambda p: F.contains(p, F.lit("\n"))), _flat)
    whole = F.array(F.array_join(F.filter(lines, lambda x: x != ""), " "))
    return F.array_distinct(F.concat(lines, several, whole))


def _rest(text: Column, matched: Column) -> Column:
    """The words of a text without the matched units; a bar, which is no word, stands for each."""
    bar = F.lit("|")
    left = F.transform(_paragraphs(_lines(text)), lambda p: F.when(F.array_contains(matched, _flat(p)), bar).otherwise(p))
    lines = F.flatten(F.transform(left, lambda p: F.split(p, "\n")))
    lines = F.transform(lines, lambda x: F.when(F.array_contains(matched, x), bar).otherwise(x))
    whole = F.array_join(F.filter(_lines(text), lambda x: x != ""), " ")
    joined = F.array_join(F.filter(lines, lambda x: x != ""), " ")
    return F.split(F.when(F.array_contains(matched, whole), bar).otherwise(joined), " ")


def _once(column: Column) -> Column:
    """The column, evaluated once: no filter is pushed below what depends on the partition."""
    return F.when(F.spark_partition_id() >= 0, column)


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, licence, dice (the highest), n_matches for each row of ``docs`` and each licence with a template that similar to a unit.

    Units are a text's lines, paragraphs and itself, and in what is left of it windows of as many words as the template
    that don't overlap; equal ones count once. A null text and units of fewer than two words
    match nothing. Null and repeated ids are returned for each row; other columns aren't read.
    """
    known = _templates(TEMPLATES if templates is None else templates)
    few, many = similarity / (2 - similarity), (2 - similarity) / similarity
    least = min((len(b) for _, b in known), default=1) * few
    gaps = lambda u: F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit("")))
    fitting = F.filter(units(F.col("text")), lambda u: gaps(u) >= least)  # a unit has no more bigrams than spaces
    sizes = [n_words(t) for texts in (TEMPLATES if templates is None else templates).values() for t in texts if bigrams(t)]
    table = F.array(
        *(
            F.struct(F.lit(name).alias("licence"), F.lit(len(b)).alias("n"), F.lit(m).alias("words"), F.array(*map(F.lit, b)).alias("bigrams"))
            for (name, b), m in zip(known, sizes, strict=True)
        )
    )
    every = F.array(*map(F.lit, dict.fromkeys(x for _, b in known for x in b)))
    rows = docs.select("doc_id", "text", fitting.alias("units"), table.alias("templates"), every.alias("every"))
    pairs = "array_distinct(zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (a, b) -> a || ' ' || b))"
    own = f"transform(units, u -> struct(u AS unit, transform(array(split(u, ' ')), w -> {pairs})[0] AS o))"
    rows = rows.withColumn("own", _once(F.expr(own))).withColumn("most", F.expr("array_max(transform(own, p -> size(p.o)))"))
    compared = (
        f"transform(filter(templates, t -> t.n >= size(p.o) * {few!r}D AND t.n <= size(p.o) * {many!r}D), "
        "t -> struct(t.licence AS licence, 2D * size(array_intersect(p.o, t.bigrams)) / (size(p.o) + t.n) AS dice, p.unit AS unit))"
    )
    found = f"filter(flatten(transform(own, p -> {compared})), m -> m.dice >= {similarity!r}D)"
    # the whole text has the most bigrams, all that a window can have
    hits = "array_intersect(element_at(filter(own, p -> size(p.o) = most), 1).o, every)"
    rows = rows.where("size(own) > 0").select("doc_id", "text", "templates", _once(F.expr(found)).alias("found"), _once(F.expr(hits)).alias("hits"))
    near = f"filter(templates, t -> size(array_intersect(hits, t.bigrams)) >= t.n * {few!r}D)"
    rows = rows.select("doc_id", "text", "found", _once(F.expr(near)).alias("near")).where("size(found) > 0 OR size(near) > 0")
    rows = rows.withColumn("w", _once(F.when(F.size("near") > 0, _rest(F.col("text"), F.col("found.unit")))))
    last = "greatest(size(w) - t.words + 1, 1)"
    starts = f"filter(sequence(1, {last}), i -> i = {last} OR array_contains(t.bigrams, get(w, i - 1) || ' ' || get(w, i)))"
    at = f"transform({starts}, i -> transform(array(slice(w, i, t.words)), w -> struct(i AS i, array_join(w, ' ') AS unit, {pairs} AS o))[0])"
    windows = (
        f"filter(transform({at}, p -> struct(t.licence AS licence, 2D * size(array_intersect(p.o, t.bigrams)) / (size(p.o) + t.n) AS dice, "
        f"p.unit AS unit, p.i AS i)), m -> m.dice >= {similarity!r}D)"
    )
    # of windows that overlap the first counts, with the highest dice of those that overlap it
    apart = (
        "aggregate(ms, cast(array() AS array<struct<licence: string, dice: double, unit: string, i: int>>), "
        "(a, m) -> if(size(a) = 0 OR element_at(a, -1).i + t.words <= m.i, concat(a, array(m)), "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('licence', m.licence, 'dice', greatest(element_at(a, -1).dice, m.dice), "
        "'unit', if(m.dice > element_at(a, -1).dice, m.unit, element_at(a, -1).unit), 'i', element_at(a, -1).i)))))"
    )
    per_template = f"transform(near, t -> transform(array({windows}), ms -> {apart})[0])"
    once = f"flatten(transform({per_template}, x -> array_distinct(transform(x, m -> struct(m.licence AS licence, m.dice AS dice, m.unit AS unit)))))"
    rows = rows.select("doc_id", _once(F.expr(f"concat(found, {once})")).alias("found")).where("size(found) > 0")
    of_licence = "filter(found, m -> m.licence = l)"
    licences = (
        f"transform(array_distinct(found.licence), l -> struct(l AS licence, array_max(transform({of_licence}, m -> m.dice)) AS dice, "
        f"size({of_licence}) AS n_matches))"
    )
    return rows.select("doc_id", F.expr(f"inline({licences})"))


def oracle_sql(templates: dict[str, list[str]] | None = None, similarity: float = SIMILARITY) -> str:
    """The same without size bounds, for texts whose notices have lines or paragraphs of their own: it has no windows."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = _templates(TEMPLATES if templates is None else templates)
    values = ", ".join(f"({k}, {quoted(name)}, [{', '.join(map(quoted, b))}])" for k, (name, b) in enumerate(known))
    return f"""
WITH templates(template, licence, bigrams) AS (VALUES {values}),
normal AS (
  SELECT row_number() OVER () AS row, doc_id,
    [trim(x) FOR x IN string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), chr(10))] AS lines
  FROM documents
), pieces AS (
  SELECT row, doc_id, unnest(lines) AS unit FROM normal
  UNION ALL
  SELECT row, doc_id, trim(regexp_replace(p, '\\n+', ' ', 'g'))
  FROM (SELECT row, doc_id, unnest(regexp_split_to_array(array_to_string(lines, chr(10)), '\\n\\n+')) AS p FROM normal)
  UNION ALL
  SELECT row, doc_id, array_to_string([x FOR x IN lines IF x <> ''], ' ') FROM normal
), units AS (
  SELECT row, doc_id, unit, string_split(unit, ' ') AS w FROM (SELECT DISTINCT row, doc_id, unit FROM pieces)
), sets AS (
  SELECT row, doc_id, unit, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS own
  FROM units WHERE len(w) > 1
), found AS (
  SELECT row, doc_id, licence, 2.0::DOUBLE * len(list_intersect(own, bigrams)) / (len(own) + len(bigrams)) AS dice FROM sets, templates
)
SELECT doc_id, licence, max(dice) AS dice, CAST(count(*) AS INTEGER) AS n_matches
FROM found WHERE dice >= {similarity!r} GROUP BY row, doc_id, licence"""
