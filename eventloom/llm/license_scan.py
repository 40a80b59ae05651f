r"""Licence scan: Dice coefficient over word bigrams between licence templates and parts of documents.

DataFrame operations only. Words are runs of [a-z0-9] in the lower-cased text; a unit and a template match when
2|A & B| / (|A| + |B|) over their *sets* of bigrams is at least the threshold. Units of a document are

* its whole text, its lines and its paragraphs;
* word windows: wherever an anchor word of a template stands, the window as long as that template, laid so that the word stands where the template has it.
  Line ends don't matter to a window, so it finds a notice in a longer line, or one that is wrapped amid other text. Headings (a bare name, `License: MIT`) are compared
  with texts, lines and paragraphs only, as a name amid a sentence is no notice.

A full licence text is found by its paragraphs. Two exact prunings come before any set is compared:

* size: Dice >= t needs |B| t/(2-t) <= |A| <= |B| (2-t)/t, so templates are listed by every unit size they admit and
  meet the units in an equi-join on the size (the list's length is bounded by the templates' sizes); windows are tested against the same bounds;
* anchors: a match holds at least t/(2-t) of the template's bigrams, so it holds one of any set of words that touches more
  than the rest of them. Texts and units without a selective anchor (long words first) are left out; windows are laid by telling anchors, which few templates
  have (usual licence words last), so that a word that is repeated very often costs few windows. Texts of over LONG_TEXT bytes are cut into stretches of STRETCH words,
  dealt out evenly, before windows are laid: no task gets all windows of a long text.

Licences of like wording match the same unit: of these only the best stay (ties all).

Defined results: null and empty texts, and units or templates of fewer than two words, have no bigram and never match; of several matching units
of a document the highest Dice counts, ties by unit kind, then by position (of a window: the number of the word at its anchor), then by the template's size. Rows that repeat a document add nothing. Null ids
are kept as one document. Extra columns aren't read. Long texts are scanned whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import stored, table, whole

#: Names of licences as notices tell them.
NAMES = {
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "the GNU AGPLv3"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache 2.0 License"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the New BSD License"],
    "BSL-1.0": ["the Boost Software License, Version 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal"],
    "EPL-2.0": ["the Eclipse Public License 2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU GPLv2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU GPLv3"],
    "ISC": ["the ISC License"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3"],
    "MIT": ["the MIT License"],
    "MPL-2.0": ["the Mozilla Public License, v. 2.0", "the Mozilla Public License 2.0"],
    "Zlib": ["the zlib License"],
}
#: The usual wordings around a name.
WORDINGS = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "Available under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This software is licensed under {}.", "Permission is granted under the terms of {}.")
#: Public licence texts and notices by SPDX name.
TEXTS = {
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSL-1.0": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so'],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
}
LICENCES = sorted({*NAMES, *TEXTS})
TEMPLATES = {name: [w.format(n) for n in NAMES.get(name, ()) for w in WORDINGS] + [f"SPDX-License-Identifier: {name}"] + TEXTS.get(name, []) for name in LICENCES}


#: Words of any English text: anchors only where a template has too few others.
COMMON = {"a", "all", "and", "any", "anyone", "as", "be", "by", "can", "file", "for", "from", "in", "is", "it", "not", "of", "on", "or", "project", "that", "the", "this", "to", "under", "use", "with", "work", "you"}

#: Words that many licences share: anchors of windows only where nothing more telling is left.
USUAL = {"available", "conditions", "copyright", "distributed", "following", "general", "granted", "gnu", "license", "licensed", "permission", "public", "released", "software", "terms", "version"}
#: Bytes beyond which a text is cut before windows are laid, and words of a stretch.
LONG_TEXT, STRETCH = 1 << 14, 1 << 10


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def anchor_words(grams: list[str], threshold: float, telling: bool = False, known: set[str] | frozenset[str] = frozenset()) -> set[str]:
    """Words until fewer bigrams are untouched than any match must hold: known ones first, then the longest, numbers and COMMON words last.

    If telling, USUAL words come after the others, and of these those first that touch most."""
    need, left, anchors = math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9), [g.split() for g in grams], set()
    while len(left) >= need:
        touched = Counter(w for g in left for w in set(g))
        word = min(touched, key=lambda w: (w in COMMON, w.isdigit(), *((w in USUAL, -touched[w]) if telling else (w not in known,)), -len(w), w))
        anchors.add(word)
        left = [g for g in left if word not in g]
    return anchors


def all_anchors(templates: dict[str, list[str]], threshold: float, telling: bool = False) -> list[str]:
    """Anchors of all templates. Unless telling, short templates choose first and the others take what is chosen already: a text is searched for each of them."""
    chosen: set[str] = set()
    for grams in sorted((g for texts in templates.values() for t in texts if (g := template_bigrams(t))), key=len):
        chosen |= anchor_words(grams, threshold, telling, chosen)
    return sorted(chosen)


def headings(license: str) -> list[str]:
    """How a line of its own names a licence; left out where numbers, COMMON words or new ones of under four letters would have to tell it (a bare `CC BY 4.0`)."""
    bare = {re.sub("^(the|a) ", "", n) for n in NAMES.get(license, ())}
    short = bare | {re.sub("^GNU ", "", n) for n in bare} | {license}
    full = bare | set(NAMES.get(license, ()))
    told = full | {f"{n} ({license})" for n in full} | {f"License: {n}" for n in short} | {f"License :: OSI Approved :: {n}" for n in bare}
    selective = set(all_anchors(TEMPLATES, 0.8))
    return sorted(t for t in told if all(w in selective or len(w) > 3 and w not in COMMON and not w.isdigit() for w in anchor_words(template_bigrams(t), 0.8)))


HEADINGS = {name: headings(name) for name in LICENCES}


def words(unit: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(unit), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """words must be a plain column: an expression would be evaluated again for every word."""
    return F.array_distinct(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.element_at(words, i + 2))))


def once(value: Column) -> Column:
    """The value, computed once a row: as the one element of an exploded array it isn't put into the filters and lambdas that read it."""
    return F.explode(F.array(value))


def _units(bodies: Column, kind: int) -> Column:
    return F.transform(bodies, lambda body, i: F.struct(F.lit(kind).alias("unit"), i.cast("int").alias("position"), body.alias("body")))


def both(*parts: dict[str, list[str]]) -> dict[str, list[str]]:
    return {name: [t for p in parts for t in p.get(name, [])] for name in sorted(set().union(*parts))}


def _stretches(rows: DataFrame, reach: int) -> DataFrame:
    """(id, words, first, begin, end): words of a text from number `first` on; the stretch answers for anchors from begin up to end, with `reach` words on both sides.

    Short texts are one stretch; long ones are cut and dealt out."""
    long = F.octet_length("text") > LONG_TEXT
    short = rows.where(~long).select("id", once(words(F.col("text"))).alias("words"))
    short = short.select("id", "words", F.lit(0).alias("first"), F.lit(0).alias("begin"), F.size("words").alias("end"))
    cut = rows.where(long).select("id", once(words(F.col("text"))).alias("words"))
    cut = cut.select("id", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(STRETCH))).alias("begin"))
    first = F.greatest(F.col("begin") - reach, F.lit(0))
    cut = cut.select("id", F.slice("words", first + 1, F.lit(STRETCH + 2 * reach)).alias("words"), first.alias("first"), "begin", (F.col("begin") + STRETCH).alias("end"))
    return short.unionByName(cut.repartition(F.xxhash64("id", "begin")))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, threshold: float = 0.8, lines_only: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per document and licence found: (id_col, license, dice, unit, position, template_bigrams, unit_bigrams). lines_only: headings (of the built-in templates: HEADINGS)."""
    spark, lines_only, templates = docs.sparkSession, lines_only or ({} if templates else HEADINGS), templates or TEMPLATES
    stems = all_anchors(both(templates, lines_only), threshold)
    stems = [a for a in stems if not any(b != a and b in a for b in stems)]  # a text with an anchor has one of these
    has_stem = lambda c: F.greatest(F.lit(False), F.lit(False), *(F.contains(c, F.lit(x)) for x in stems))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    known = lambda of: [(name, template_words(t), grams) for name, texts in of.items() for t in texts if (grams := template_bigrams(t))]
    sizes = [(n, name, g) for name, _, g in known(both(templates, lines_only)) for n in range(math.ceil(len(g) * low - 1e-9), math.floor(len(g) * high + 1e-9) + 1)]
    by_size = spark.createDataFrame(sizes, "n_unit int, license string, grams array<string>")
    anchors = all_anchors(templates, threshold, telling=True)
    places = [(w, i, len(words), name, g) for name, words, g in known(templates) for own in [anchor_words(g, threshold, telling=True)] for i, w in enumerate(words) if w in own]
    by_anchor = spark.createDataFrame(places, "anchor string, place int, n_words int, license string, grams array<string>")
    longest = max((len(words) for _, words, _ in known(templates)), default=0)

    rows = docs.select(F.col(id_col).alias("id"), F.lower(whole(text_col)).alias("text")).where(has_stem(F.col("text")))
    rows = stored(rows, "license-texts")
    lines, paragraphs = F.split("text", "\n"), F.split("text", "\n[ \t]*\n")
    parts = F.flatten(F.array(_units(F.array("text"), 0), _units(lines, 1), _units(paragraphs, 2)))
    units = rows.select("id", F.explode(F.filter(parts, lambda u: has_stem(u["body"]))).alias("u")).select("id", "u.unit", "u.position", once(words(F.col("u.body"))).alias("words"))
    units = units.select("id", "unit", "position", once(bigrams(F.col("words"))).alias("own"))
    whole_units = units.withColumn("n_unit", F.size("own")).join(F.broadcast(by_size), "n_unit").select("id", "license", "unit", "position", "own", "grams")

    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(anchors) & (x["at"] + F.col("first") >= F.col("begin")) & (x["at"] + F.col("first") < F.col("end")))
    near = _stretches(rows, longest).select("id", "words", "first", F.explode(hits).alias("hit"))  # words around each anchor, enough for every template
    start = F.greatest(F.col("hit.at") - longest, F.lit(0))
    near = near.select("id", (F.col("first") + F.col("hit.at")).alias("position"), F.col("hit.word").alias("anchor"), (F.col("hit.at") - start).alias("inside"), F.slice("words", start + 1, F.lit(2 * longest + 1)).alias("stretch"))
    begin = F.col("inside") - F.col("place")
    piece = F.slice("stretch", F.greatest(begin, F.lit(0)) + 1, F.greatest(F.least(F.col("n_words"), begin + F.col("n_words")), F.lit(0)))
    windows = near.join(F.broadcast(by_anchor), "anchor").select("id", "license", "position", "grams", once(piece).alias("words"))
    windows = windows.select("id", "license", F.lit(3).alias("unit"), F.col("position").cast("int").alias("position"), once(bigrams(F.col("words"))).alias("own"), "grams")
    windows = windows.where((F.size("own") >= F.size("grams") * low - 1e-9) & (F.size("own") <= F.size("grams") * high + 1e-9))

    every = whole_units.unionByName(windows)
    dice = 2.0 * F.size(F.array_intersect("own", "grams")) / (F.size("own") + F.size("grams"))
    found = every.select("id", "license", "unit", "position", F.round(dice, 6).alias("dice"), F.size("grams").alias("template_bigrams"), F.size("own").alias("unit_bigrams")).where(F.col("dice") >= threshold).distinct()
    found = stored(found, "license-found")
    top = found.groupBy("id", "unit", "position").agg(F.max("dice").alias("top"))
    same = F.col("f.id").eqNullSafe(F.col("t.id")) & (F.col("f.unit") == F.col("t.unit")) & (F.col("f.position") == F.col("t.position")) & (F.col("f.dice") == F.col("t.top"))
    good = found.alias("f").join(top.alias("t"), same, "left_semi")
    best = good.groupBy("id", "license").agg(F.min(F.struct((-F.col("dice")).alias("least"), "unit", "position", "template_bigrams", "unit_bigrams")).alias("best"))
    kinds = F.element_at(F.array(*map(F.lit, ("text", "line", "paragraph", "window"))), F.col("best.unit") + 1)
    return best.select(F.col("id").alias(id_col), "license", (-F.col("best.least")).alias("dice"), kinds.alias("unit"), "best.position", "best.template_bigrams", "best.unit_bigrams")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _values() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [(name, t, amid) for of, amid in ((TEMPLATES, True), (HEADINGS, False)) for name, texts in of.items() for t in texts]
    return ", ".join(f"({quoted(name)}, {quoted(t)}, {sorted(anchor_words(template_bigrams(t), 0.8, telling=True)) if amid else []}::VARCHAR[])" for name, t, amid in rows)


OP4_SQL = f"""
WITH t AS (SELECT license, anchors, regexp_extract_all(lower(body), '[a-z0-9]+') AS w FROM (VALUES {_values()}) v(license, body, anchors)),
tg AS (SELECT license, anchors, w, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM t),
a AS (SELECT unnest({all_anchors(both(TEMPLATES, HEADINGS), 0.8)}) AS anchor),
aw AS (SELECT unnest({all_anchors(TEMPLATES, 0.8, telling=True)}) AS anchor),
d AS (SELECT doc_id, lower(coalesce(text, '')) AS body FROM documents WHERE regexp_matches(lower(coalesce(text, '')), '(' || (SELECT string_agg(anchor, '|') FROM a) || ')')),
u AS (
  SELECT doc_id, 0 AS kind, 0 AS position, body FROM d
  UNION ALL SELECT doc_id, 1, generate_subscripts(l, 1) - 1, unnest(l) FROM (SELECT doc_id, string_split(body, chr(10)) AS l FROM d)
  UNION ALL SELECT doc_id, 2, generate_subscripts(l, 1) - 1, unnest(l) FROM (SELECT doc_id, regexp_split_to_array(body, '\\n[ \\t]*\\n') AS l FROM d)
),
uw AS (SELECT doc_id, kind, position, regexp_extract_all(body, '[a-z0-9]+') AS w FROM u WHERE regexp_matches(body, '(' || (SELECT string_agg(anchor, '|') FROM a) || ')')),
ug AS (SELECT doc_id, kind, position, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own FROM uw),
tp AS (SELECT * FROM (SELECT license, anchors, len(w) AS n, grams, unnest(w) AS anchor, generate_subscripts(w, 1) AS place FROM tg) WHERE list_contains(anchors, anchor)),
dw AS (SELECT doc_id, regexp_extract_all(body, '[a-z0-9]+') AS w FROM d),
h AS (SELECT doc_id, w, at1 FROM (SELECT doc_id, w, unnest(w) AS anchor, generate_subscripts(w, 1) AS at1 FROM dw) JOIN aw USING (anchor)),
hw AS (SELECT h.doc_id, license, at1 - 1 AS position, grams, h.w[greatest(at1 - place + 1, 1):at1 - place + n] AS x FROM h JOIN tp ON tp.anchor = h.w[at1]),
e AS (SELECT doc_id, license, kind, position, own, grams FROM ug JOIN tg ON len(own) > 0
      UNION ALL SELECT doc_id, license, 3, position, list_distinct(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])), grams FROM hw),
s AS (SELECT DISTINCT doc_id, license, kind, position, round(2.0::DOUBLE * len(list_intersect(own, grams)) / (len(own) + len(grams)), 6) AS dice, len(grams) AS template_bigrams, len(own) AS unit_bigrams FROM e WHERE len(own) BETWEEN 0.6 * len(grams) AND 1.6 * len(grams)),
g AS (SELECT *, max(dice) OVER (PARTITION BY doc_id, kind, position) AS top FROM s WHERE dice >= 0.8),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, kind, position, template_bigrams, unit_bigrams) AS k FROM g WHERE dice = top)
SELECT doc_id, license, dice, ['text', 'line', 'paragraph', 'window'][kind + 1] AS unit, position::INTEGER AS position, template_bigrams::INTEGER AS template_bigrams, unit_bigrams::INTEGER AS unit_bigrams FROM r WHERE k = 1
"""
