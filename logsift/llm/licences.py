"""Licence scan: text units against licence templates by Dice coefficient over word bigrams.

Units are the lines of a text, its paragraphs (parted by blank lines) that span
several lines, its comments (runs of several lines that begin with a comment mark,
with or without code right above or below) and the paragraphs of comments (parted
by lines that hold only marks).  A unit is lower-cased, every ASCII character but letters
and digits parts words, and its distinct word bigrams make a set.  With A the
unit's set and B a template's, Dice is 2|A and B| / (|A| + |B|); a unit matches
a template at ``THRESHOLD`` or more, and the best template (then the smallest
name) is reported.

Pruning loses nothing.  Size bounds: Dice t needs |A| between |B| t/(2-t) and
|B| (2-t)/t, so a unit of another size never meets the template.  Probes: a
match shares at least |B| t/(2-t) bigrams with B, so it holds one of any
|B| - ceil(|B| t/(2-t)) + 1 of them; the longest serve as probes, as ordinary
text rarely holds them.  A text, and then a unit, that holds no probe's longer
word is dropped before any bigram is made, a unit that holds no probe right
after; the others meet the templates of the probes they hold, each once.

Templates are notices, whole short licences (also a list of clauses without its
disclaimer), file headers whole and by paragraph, and the bodies of Apache-2.0,
GPL, LGPL, AGPL, MPL and CC0 whole and by paragraph, so a licence is found on one
line, in a comment above code, and in paragraphs.  Comment marks part words.  Other
runs of lines or paragraphs inside a longer unit are not units: a licence that runs
into other prose without a blank line is found only while Dice with the whole unit
allows.

Everything is DataFrame functions; the template table is the fixed list below,
a few hundred rows at most, and the only thing that is broadcast.

Defined cases: null and empty texts have no units; units of fewer than two
words have no bigrams and match nothing; rows that repeat report their matches
each; null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licence_texts import BODIES, HEADERS, WHOLE

THRESHOLD = 0.8
LEAST_PARAGRAPH = 12      # bigrams of a body's paragraph that is a template of its own; shorter ones are headings and list marks

COMMENT = r"^[ \t]*[#*/;%-]"                                     # a line of a comment
COMMENT_WORDS = COMMENT + r".*[0-9A-Za-z\x80-\x{10ffff}]"        # that has words
_APART = "\x01"

# Public licence notices and paragraphs, one unit each; whole texts and the paragraphs of bodies follow below.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                   "implied. See the License for the specific language governing permissions and limitations under the "
                   "License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
            "of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
            "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
            "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
            "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
            "DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Licensed under the ISC License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met:"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
            "following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                         "General Public License as published by the Free Software Foundation; either version 2 of the "
                         "License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                         "General Public License as published by the Free Software Foundation, either version 3 of the "
                         "License, or (at your option) any later version."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
            "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
            "for more details."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights "
                "to this software to the public domain worldwide."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
             "held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
]

# in lower case: every ASCII character but letters and digits parts words
_PARTING = r"[\x00-/:-`{-\x7f]+"


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    words = re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", text.lower()).split()
    return list(dict.fromkeys(" ".join(p) for p in zip(words, words[1:])))


def _further_templates() -> list[tuple[str, str]]:
    """Whole texts, headers and bodies, and the paragraphs of the last two; what licences of a family share has the family's name."""
    texts = WHOLE + HEADERS + [(name, line) for name, text in HEADERS for line in text.split("\n")] + list(BODIES.items())
    texts += [(name, part) for name, body in BODIES.items() for part in body.split("\n\n") if len(bigrams_of(part)) >= LEAST_PARAGRAPH]
    names: dict[tuple, dict] = {}
    for name, text in texts:
        names.setdefault(tuple(sorted(bigrams_of(text))), {}).setdefault(name, text)
    for _, text in TEMPLATES:
        names.pop(tuple(sorted(bigrams_of(text))), None)
    out = []
    for held in names.values():
        families = {name.split("-")[0] for name in held}
        out.append((next(iter(held)) if len(held) == 1 else families.pop() if len(families) == 1 else "GPL", next(iter(held.values()))))
    return out


TEMPLATES += _further_templates()


def template_rows(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple]:
    """(template number, licence, bigrams, least size, most size, probes) of every template."""
    out = []
    for i, (licence, text) in enumerate(templates):
        grams = bigrams_of(text)
        m = len(grams)
        shared = math.ceil(m * threshold / (2 - threshold) - 1e-9)
        probes = sorted(grams, key=lambda g: (-max(map(len, g.split(" "))), -len(g), g))[:m - shared + 1]
        out.append((i, licence, grams, shared, math.floor(m * (2 - threshold) / threshold + 1e-9), probes))
    return out


def split_words(text: Column) -> Column:
    """Words in lower case; the first and the last may be empty."""
    return F.split(F.lower(text), _PARTING, -1)


def bigram_list(words: Column) -> Column:
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1),
                                    lambda a, b: F.concat(a, F.lit(" "), b)))


def units(docs: DataFrame, text: str, clues: list[str]) -> DataFrame:
    """row_id, doc_id, kind (line, paragraph, comment or comment paragraph), unit (number from 0) and ``words`` of every
    unit that holds a clue."""
    def holds(words):
        return F.exists(words, lambda w: w.isin(clues))

    base = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col(text).cast("string").alias("text")).where(holds(split_words(F.col("text"))))
    line = F.transform(F.split("text", "\n", -1), lambda u, i: F.struct(F.lit("line").alias("kind"), i.alias("unit"), u.alias("u")))
    block = F.filter(F.transform(F.split("text", "\n[ \t\r]*\n", -1),
                                 lambda u, i: F.struct(F.lit("paragraph").alias("kind"), i.alias("unit"), u.alias("u"))),
                     lambda s: F.contains(s["u"], F.lit("\n")))

    def runs(kind, pattern):
        """Runs of lines that match, of two lines or more."""
        marked = F.transform(F.split("text", "\n", -1), lambda u: F.when(u.rlike(pattern), u).otherwise(F.lit(_APART)))
        return F.filter(F.transform(F.split(F.array_join(marked, "\n"), _APART, -1),
                                    lambda u, i: F.struct(F.lit(kind).alias("kind"), i.alias("unit"), u.alias("u"))),
                        lambda s: F.contains(F.btrim(s["u"], F.lit("\n")), F.lit("\n")))

    every = F.concat(line, block, runs("comment", COMMENT), runs("comment paragraph", COMMENT_WORDS))
    parts = base.select("row_id", "doc_id", F.explode(every).alias("s"))
    words = F.filter(split_words(F.col("s.u")), lambda w: w != "")
    return parts.select("row_id", "doc_id", "s.kind", "s.unit", words.alias("words")).where(holds(F.col("words")))


def licence_matches(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """doc_id, kind, unit, licence, template, dice of every unit's best template."""
    spark = docs.sparkSession
    rows = template_rows(templates, threshold)
    known = spark.createDataFrame([r[:5] for r in rows], "template int, licence string, b array<string>, least int, most int")
    holders: dict[str, list[str]] = {}
    for r in rows:
        for p in r[5]:
            holders.setdefault(p, []).append(str(r[0]))
    probes = sorted(holders)
    met_by = F.str_to_map(F.lit(";".join(f"{p}:{','.join(holders[p])}" for p in probes)), F.lit(";"), F.lit(":"))     # folded into a constant
    least = min(r[3] for r in rows)
    clues = sorted({max(p.split(" "), key=len) for p in probes})
    grams = (units(docs, text, clues).where(F.size("words") > least)
             .select("row_id", "doc_id", "kind", "unit", bigram_list(F.col("words")).alias("grams"))
             .where(F.exists("grams", lambda g: g.isin(probes)))
             .withColumn("a", F.array_distinct("grams")))
    held = F.transform(F.filter("a", lambda g: g.isin(probes)), lambda g: F.split(F.element_at(met_by, g), ","))
    hits = grams.select("row_id", "doc_id", "kind", "unit", "a", F.explode(F.array_distinct(F.flatten(held)).cast("array<int>")).alias("template"))
    met = hits.join(F.broadcast(known), "template").where("size(a) between least and most")
    scored = met.withColumn("dice", 2.0 * F.size(F.array_intersect("a", "b")) / (F.size("a") + F.size("b")))
    best = scored.where(F.col("dice") >= threshold).groupBy("row_id", "doc_id", "kind", "unit").agg(
        F.min(F.struct((-F.col("dice")).alias("d"), "licence", "template")).alias("best"))
    return best.select("doc_id", "kind", F.col("unit").cast("int").alias("unit"), F.col("best.licence").alias("licence"),
                       F.col("best.template").alias("template"), (-F.col("best.d")).alias("dice"))


def oracle_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same result by comparing every unit with every template."""
    values = ", ".join("({}, '{}', [{}])".format(i, name, ", ".join(f"'{g}'" for g in bigrams_of(t)))
                       for i, (name, t) in enumerate(templates))
    return f"""
WITH t(template, licence, b) AS (VALUES {values}),
lines AS (SELECT doc_id, 'line' AS kind, string_split(text, chr(10)) AS us FROM documents WHERE text IS NOT NULL
          UNION ALL
          SELECT doc_id, 'paragraph', regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') FROM documents WHERE text IS NOT NULL
          UNION ALL
          SELECT doc_id, kind, string_split(array_to_string(list_transform(string_split(text, chr(10)),
              lambda l: CASE WHEN regexp_matches(l, mark) THEN l ELSE chr(1) END), chr(10)), chr(1))
          FROM documents, (VALUES ('comment', '{COMMENT}'), ('comment paragraph', '{COMMENT_WORDS}')) m(kind, mark)
          WHERE text IS NOT NULL),
u AS (SELECT doc_id, kind, unnest(us) AS u, unnest(range(len(us))) AS unit FROM lines),
w AS (SELECT doc_id, kind, unit, list_filter(regexp_split_to_array(lower(u), '[^0-9a-z\\x80-\\x{{10ffff}}]+'), lambda x: x <> '') AS w
      FROM u WHERE kind = 'line' OR contains(CASE kind WHEN 'paragraph' THEN u ELSE trim(u, chr(10)) END, chr(10))),
g AS (SELECT doc_id, kind, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a
      FROM w WHERE len(w) > 1),
d AS (SELECT doc_id, kind, unit, licence, template, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice
      FROM g, t),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, unit ORDER BY dice DESC, licence, template) AS r
      FROM d WHERE dice >= {threshold})
SELECT doc_id, kind, CAST(unit AS INTEGER) AS unit, licence, template, CAST(dice AS DOUBLE) AS dice FROM r WHERE r = 1"""
