"""Licence scan: normalised passages against licence templates by the Dice coefficient over word bigrams.

A text's units are its lines, its paragraphs (parted by empty lines) and the text as a whole. A unit of
n distinct bigrams can reach a Dice coefficient of t with a template of m only if m * t / (2 - t) <= n <= m * (2 - t) / t;
units outside all templates' bounds are dropped by their number of words alone, and a unit meets only the templates
whose bounds it fits. Everything is a Spark SQL function, in one pass and one aggregation.

Defined results: null and empty texts, and units of fewer than two words, match nothing; repeated rows give a row each;
ids may be null; a unit counts for its best template, ties go to the smaller name; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

THRESHOLD = 0.8
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} General Public License for more details."
#: The licences' published texts and usual notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", _FREE.format("Affero")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", _BSD2 + _BSD_END),
    ("BSD-3-Clause", _BSD2 + _BSD3 + _BSD_END),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", _ISC),
    ("LGPL-3.0", _FREE.format("Lesser")),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", _UNLICENSE),
)


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _anchors(known: list[tuple[str, list[str]]], slack: float) -> list[str]:
    """Words of which every unit that reaches the threshold with some template holds one (as a substring).

    Such a unit shares m / slack of a template's m bigrams at least, so it holds one of any m - m / slack + 1 of
    them; words are chosen, those in most bigrams first, until so many of each template's bigrams hold one."""
    chosen: set[str] = set()
    for _, grams in sorted(known, key=lambda k: len(k[1])):
        open_grams = [g.split() for g in grams if not chosen & {g, *g.split()}]
        need = len(grams) - math.ceil(len(grams) / slack) + 1 - (len(grams) - len(open_grams))
        while need > 0:
            counts = Counter(w for g in open_grams for w in set(g))
            word = max(counts, key=lambda w: (len(w) > 4, counts[w], len(w), w))
            if len(word) > 4:
                chosen.add(word)
                need -= counts[word]
                open_grams = [g for g in open_grams if word not in g]
            else:  # short words stand in too many texts, so the bigram itself
                gram = max(open_grams, key=lambda g: (len("".join(g)), g))
                chosen.add(" ".join(gram))
                need -= 1
                open_grams.remove(gram)
    return sorted(chosen)


def _bigrams(unit: Column) -> Column:
    words = F.filter(F.split(unit, "[^a-z0-9]+"), lambda w: w != "")
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs and licence found in it: doc_id, license, dice (of its best unit), units (that reach the threshold)."""
    known = [(name, sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})) for name, text in templates if len(w := _words(text)) > 1]
    slack = (2 - threshold) / threshold
    sizes = [len(b) for _, b in known]
    least = min(sizes) / slack
    most = max(sizes) * slack
    text = F.coalesce(F.col("text"), F.lit(""))
    words = _anchors(known, slack)
    phrases = "|".join(w.replace(" ", "[^a-z0-9]+") for w in words if " " in w)
    anchored = lambda u: reduce(or_, [F.contains(u, F.lit(w)) for w in words if " " not in w], u.rlike(phrases) if phrases else F.lit(False))
    # n bigrams take n + 1 words of a letter at least, and the spaces between
    fits = lambda u: (F.length(u) >= 2 * least + 1) & anchored(u)
    some = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.lower(text).alias("_text")).where(anchored(F.col("_text")))
    units = F.array_distinct(F.concat(F.split("_text", "\n", -1), F.split("_text", r"\n[ \t]*\n", -1), F.array("_text")))
    grams = some.select("_row", "doc_id", F.explode(F.filter(units, fits)).alias("_unit")).select("_row", "doc_id", _bigrams(F.col("_unit")).alias("_grams")).where(F.size("_grams").between(least, most))
    size = F.size("_grams")
    dice = lambda b: F.when(size.between(len(b) / slack, len(b) * slack), 2.0 * F.size(F.array_intersect("_grams", F.array(*map(F.lit, b)))) / (size + len(b)))
    best = F.array_min(F.filter(F.array(*[F.struct((-dice(b)).alias("less"), F.lit(n).alias("license")) for n, b in known]), lambda s: s["less"] <= -threshold))
    scored = grams.select("_row", "doc_id", best.alias("s")).where("s is not null").select("_row", "doc_id", "s.license", (-F.col("s.less")).alias("dice"))
    return scored.groupBy("_row", "license").agg(F.first("doc_id").alias("doc_id"), F.round(F.max("dice"), 6).alias("dice"), F.count(F.lit(1)).alias("units")).drop("_row")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in TEMPLATES)
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t(license, w) AS (SELECT l, regexp_extract_all(lower(x), '[a-z0-9]+') FROM (VALUES {quoted}) v(l, x)), tg AS (SELECT license, {grams} AS grams FROM t),
d AS (SELECT row_number() OVER () AS n, doc_id, lower(text) AS text FROM documents WHERE text IS NOT NULL),
u AS (SELECT n, doc_id, unnest(list_distinct(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\n[ \t]*\n'), [text]))) AS unit FROM d),
g AS (SELECT n, doc_id, unit, {grams} AS grams FROM (SELECT n, doc_id, unit, regexp_extract_all(unit, '[a-z0-9]+') AS w FROM u) WHERE len(w) > 1),
s AS (SELECT n, doc_id, unit, license, 2.0 * len(list_intersect(g.grams, tg.grams)) / (len(g.grams) + len(tg.grams)) AS dice FROM g, tg WHERE len(g.grams) BETWEEN len(tg.grams) / 1.5 AND len(tg.grams) * 1.5),
b AS (SELECT *, row_number() OVER (PARTITION BY n, unit ORDER BY dice DESC, license) AS place FROM s WHERE dice >= {THRESHOLD})
SELECT license, doc_id, round(max(dice), 6) AS dice, count(*) AS units FROM b WHERE place = 1 GROUP BY n, doc_id, license
"""


SQL = _sql()
