"""Licence scan: passages compared with templates by Dice's coefficient over word bigrams.

The similarity of a passage and a template is 2 |common| / (|passage| + |template|) over the sets
of their normalised words' bigrams. Passages are all runs of neighbouring words of up to
(2 - t) / t times the template's length, so notices inside longer lines, or wrapped over several,
are found; besides these, a document's lines, paragraphs and whole text, of any length.

A similarity of at least t leaves out no more than a share of the template's bigrams. For each
template the driver picks words that stand in more of its bigrams than that; a text without any
of them can't reach the template. Of the others, the bigrams in common are counted for the whole
text, and only where these suffice are passages compared. The best run begins and ends with a
bigram of the template. A run's different bigrams are those that last stood before its start.
All comparisons with t are in whole numbers.

The templates are a literal of under 1 MB whatever the corpus. Each row is scanned where it is:
nothing is shuffled or joined. Everything is built-in expressions.

Defined results: a null or empty text has no findings and still has its row in the query. A text
of one word has no bigram and nothing can be found. Repeated rows give equal findings. With ties
the template with the lesser name is taken. An empty table gives no rows. Long licences are found
by their opening words only; a text that holds just later parts of them isn't found. Licences
with nearly the same wording (the GPL's and the AGPL's header) are both listed; the best tells.
"""

from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F

from sitehazard.llm.licence_texts import TEXTS

#: Notices by which works state their licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the License); you may "
    "not use this file except in compliance with the License. You may obtain a copy of the "
    "License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be "
    "found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International "
    "License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
    "International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it "
    "under the terms of the GNU General Public License as published by the Free Software "
    "Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of "
    "this software and associated documentation files, to deal in the Software without "
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all rights reserved": "Copyright. All rights reserved.",
    **TEXTS,
}
LEAST = 0.8
#: Words that many texts hold. They are picked last, which changes no result.
COMMON = frozenset(
    "a above all and any as at be but by can code commercial conditions copy copies distribute for "
    "form found free from general granted in including is it law license licensed limited mit modify "
    "must no not of on or other person public purpose provided released rights sell software source "
    "terms that the this to under use used version with work works without you 0 1 2 3 4".split()
)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def bigrams(words: str) -> str:
    """SQL: the bigrams of an array of words, in order."""
    return (
        f"CASE WHEN size({words}) >= 2 THEN transform(sequence(0, size({words}) - 2), "
        f"i -> concat_ws(' ', {words}[i], {words}[i + 1])) ELSE CAST(array() AS array<string>) END"
    )


def telling(grams: list[tuple[str, str]], least: Fraction) -> list[str]:
    """Words of which any text with a passage that similar to these bigrams holds one."""
    common = -(-len(grams) * least // (2 - least))  # at least so many, rounded up
    left, picked = set(grams), []
    while len(grams) - len(left) <= len(grams) - common:
        of = Counter(w for g in left for w in set(g))
        picked.append(min(of, key=lambda w: (w in COMMON, -of[w], w)))
        left = {g for g in left if picked[-1] not in g}
    return picked


def _literal(templates: dict[str, str], least: Fraction) -> tuple[str, str]:
    """SQL: the templates as an array of structs, and all of their telling words."""

    def array(values) -> str:
        return "array(" + ", ".join(f"'{v}'" for v in values) + ")"

    structs, all_telling = [], set()
    for name, body in sorted(templates.items()):
        if not body.isascii():
            raise ValueError(f"template {name} has other than ASCII characters")
        own = re.findall("[a-z0-9]+", body.lower())
        grams = list(dict.fromkeys(zip(own, own[1:], strict=False)))
        if not grams:
            continue
        picked = telling(grams, least)
        all_telling.update(picked)
        longest = int((len(own) - 1) * (2 - least) / least)
        quoted = name.replace("\\", "\\\\").replace("'", "\\'")
        structs.append(
            f"named_struct('licence', '{quoted}', 'of', {len(grams)}, 'longest', {longest}, "
            f"'grams', {array(' '.join(g) for g in grams)}, 'telling', {array(picked)})"
        )
    return f"array({', '.join(structs)})", array(sorted(all_telling))


def with_findings(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, text: str = "text", least: float = LEAST
) -> DataFrame:
    """The rows with ``_found``: (similarity, licence) of each template that the text reaches."""
    share = Fraction(str(least))
    p, q = share.numerator, share.denominator
    known, any_telling = _literal(templates, share)
    body = F.coalesce(F.col(text), F.lit(""))
    # Each step is a column used more than once, so that none is put into the next and repeated.
    df = docs.withColumn("_w", words(body))
    df = df.withColumn("_near", F.expr(f"array_intersect(_w, {any_telling})"))
    df = df.withColumn("_g", F.expr(f"CASE WHEN size(_near) > 0 THEN {bigrams('_w')} END"))
    enough = "{c} * " + str(2 * q - p) + " >= " + str(p) + " * t.of"
    df = df.withColumn(
        "_t",
        F.expr(
            f"CASE WHEN size(_near) > 0 THEN filter({known}, t -> arrays_overlap(_near, t.telling) "
            f"AND {enough.format(c='size(array_intersect(_g, t.grams))')}) END"
        ),
    )
    reached = "size(_t) > 0"
    # Where each bigram stood last before, or -1.
    sorted_grams = "array_sort(transform(_g, (x, i) -> struct(x AS x, i AS i)))"
    df = df.withColumn("_o", F.expr(f"CASE WHEN {reached} THEN {sorted_grams} END"))
    before = (
        "transform(array_sort(transform(_o, (o, k) -> struct(o.i AS i, CASE WHEN k > 0 AND "
        "_o[greatest(k - 1, 0)].x = o.x THEN _o[greatest(k - 1, 0)].i ELSE -1 END AS b))), z -> z.b)"
    )
    df = df.withColumn("_before", F.expr(f"CASE WHEN {reached} THEN {before} END"))
    units = F.array_distinct(
        F.concat(F.split(body, "\\n"), F.split(body, "\\n[ \\t\\r]*\\n"), F.array(body))
    )
    df = df.withColumn("_u", F.when(F.expr(reached), F.transform(units, words)))
    sets = f"transform(filter(_u, w -> arrays_overlap(w, {any_telling})), w -> array_distinct({bigrams('w')}))"
    df = df.withColumn("_u", F.expr(f"CASE WHEN {reached} THEN {sets} END"))

    def similarity(c: str, n: str) -> str:
        return f"CASE WHEN 2 * {q} * {c} >= {p} * ({n} + t.of) THEN 2D * {c} / ({n} + t.of) ELSE 0D END"

    # For each start in h, a pass over the run's ends. New are bigrams that last stood before it.
    step = (
        "element_at(transform(array(named_struct('n', a.n + CASE WHEN _before[e] < s THEN 1 ELSE 0 END, "
        "'c', a.c + CASE WHEN _before[e] < s AND h[e] THEN 1 ELSE 0 END)), "
        f"y -> named_struct('n', y.n, 'c', y.c, 'best', greatest(a.best, {similarity('y.c', 'y.n')}))), 1)"
    )
    run = (
        "aggregate(sequence(s, least(s + t.longest, size(_g)) - 1), "
        f"named_struct('n', 0, 'c', 0, 'best', 0D), (a, e) -> {step}, a -> a.best)"
    )
    runs = (
        "transform(array(transform(_g, x -> array_contains(t.grams, x))), h -> array_max(transform("
        f"filter(sequence(0, size(_g) - 1), s -> h[s]), s -> {run})))[0]"
    )
    unit = (
        "array_max(transform(_u, u -> element_at(transform(array(size(array_intersect(u, t.grams))), "
        f"c -> {similarity('c', 'size(u)')}), 1)))"
    )
    best = f"named_struct('similarity', greatest({runs}, {unit}), 'licence', t.licence)"
    found = f"filter(transform(_t, t -> {best}), f -> f.similarity > 0)"
    found = F.expr(f"CASE WHEN {reached} THEN {found} END")
    return df.withColumn("_found", found).drop("_w", "_near", "_g", "_t", "_o", "_before", "_u")


def scan(docs: DataFrame, keep: list[str], text: str = "text", least: float = LEAST) -> DataFrame:
    """``keep``, ``licences`` (sorted names), ``best`` and ``similarity``; best is null without any."""
    found = with_findings(docs, text=text, least=least)
    first = "array_min(transform(_found, f -> struct(-f.similarity AS s, f.licence AS licence)))"
    return found.withColumn("_first", F.expr(first)).select(
        *keep,
        F.expr(
            "coalesce(array_sort(transform(_found, f -> f.licence)), CAST(array() AS array<string>))"
        ).alias("licences"),
        F.col("_first.licence").alias("best"),
        (-F.col("_first.s")).alias("similarity"),
    )
