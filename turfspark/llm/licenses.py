"""License scans: Dice coefficient over word bigrams, in DataFrame operations only.

Texts and templates are normalised: lower case, every run of other characters than a-z and 0-9 a space, so that
comment leaders and rules vanish. A text is cut into segments at line ends and after ``.!?;:`` before white space;
its units are all runs of consecutive segments: a sentence within a line, a line, a paragraph, a notice wrapped in
comment signs or wedged between lines of code, the whole text. The Dice coefficient of two sets of word bigrams is
twice the shared number over the sum of the sizes; it reaches ``threshold`` t only if the unit's size lies between
t / (2 - t) and (2 - t) / t times the template's, which prunes units by the number of their words. Of these bounds:

* texts go that can't match: a like unit has at least t / (2 - t) of a template's bigrams, so it holds one of any
  set of more than the rest; such a set is chosen for each template so that few words cover it, and a text without
  any of these words is out;
* a template stays a text's candidate only if the whole text has that many of its bigrams, by a join with the
  templates' bigrams (broadcast while they number at most ``MAX_BROADCAST``, else Spark chooses) on a 64-bit hash,
  with the bigram compared as well;
* units begin and end with segments that hold some bigram of the candidate, since others only add to their size.

``TEMPLATES`` has published notices, short full texts and one-line forms. Long full texts, as those of an SPDX
list, are read from a folder by ``read_templates``.

Edge cases: null, empty and word-less texts match nothing; a unit or template of one word has no bigram and
matches nothing; rows equal in id and text, and equal units of a document, count once; rows without an id are
documents of their own where their texts differ, and so are rows that share an id but not a text; a document may
match several templates, each a row with its best unit; an empty table gives no rows. Other columns, whatever their
names, are ignored. Ids must be numbers, or texts of numbers.
"""

import re
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import materialise

THRESHOLD, MAX_BROADCAST = 0.8, 100_000

# Published licence notices.
TEMPLATES = [
    ("Apache-2.0", "short", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", "short", "Licensed under the MIT License."),
    ("MIT", "released", "This project is released under the MIT License."),
    ("MIT", "text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("MIT", "disclaimer", """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", "short", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "short", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "style", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("ISC", "text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("GPL-2.0-or-later", "notice", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("GPL-3.0-or-later", "notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("GPL-3.0-only", "short", "Licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1-or-later", "notice", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("AGPL-3.0-or-later", "notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("MPL-2.0", "notice", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("EPL-2.0", "notice", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""),
    ("Unlicense", "text", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("BSL-1.0", "short", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]

_MIT, _MIT_AS_IS = (next(t for x, p, t in TEMPLATES if (x, p) == ("MIT", q)) for q in ("text", "disclaimer"))
_BSD_2 = next(t for x, p, t in TEMPLATES if (x, p) == ("BSD-2-Clause", "text"))
_BSD_3 = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = next(t for x, p, t in TEMPLATES if (x, p) == ("ISC", "text"))
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
TEMPLATES += [
    ("MIT", "full", f"{_MIT} {_MIT_AS_IS}"),
    ("BSD-2-Clause", "full", f"{_BSD_2} {_BSD_AS_IS}"),
    ("BSD-3-Clause", "text", _BSD_2 + _BSD_3),
    ("BSD-3-Clause", "full", f"{_BSD_2}{_BSD_3} {_BSD_AS_IS}"),
    ("BSD", "disclaimer", _BSD_AS_IS),
    ("ISC", "disclaimer", _ISC_AS_IS),
    ("ISC", "full", f"{_ISC} {_ISC_AS_IS}"),
    ("Zlib", "full", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", "full", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
]

# Names by which one-line notices call a licence: its usual name and its SPDX identifier.
_NAMES = [
    ("Apache-2.0", "the Apache License 2.0"), ("Apache-2.0", "Apache-2.0"), ("MIT", "the MIT License"), ("MIT", "MIT"), ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "the BSD 3-Clause License"), ("BSD-3-Clause", "BSD-3-Clause"), ("ISC", "the ISC License"), ("ISC", "ISC"),
    ("GPL-2.0-or-later", "GPL-2.0-or-later"), ("GPL-3.0-or-later", "GPL-3.0-or-later"), ("GPL-3.0-only", "the GNU General Public License, version 3"),
    ("GPL-3.0-only", "GPL-3.0-only"), ("LGPL-2.1-or-later", "LGPL-2.1-or-later"), ("AGPL-3.0-or-later", "AGPL-3.0-or-later"), ("MPL-2.0", "the Mozilla Public License 2.0"),
    ("MPL-2.0", "MPL-2.0"), ("EPL-2.0", "the Eclipse Public License 2.0"), ("EPL-2.0", "EPL-2.0"), ("Unlicense", "the Unlicense"), ("BSL-1.0", "the Boost Software License, Version 1.0"),
    ("BSL-1.0", "BSL-1.0"), ("CC0-1.0", "CC0 1.0"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
]
_FORMS = ["Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "SPDX-License-Identifier: {}"]
# "This work is licensed under" alone would make any other short name 0.8 alike, so there the name has three words.
TEMPLATES += [
    (x, f"line {form.split(' {')[0].lower()} {name}", form.format(name))
    for x, name in _NAMES for form in _FORMS if form[:4] != "This" or len(re.findall("[a-z0-9]+", name.lower())) > 2
]


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it's used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bigrams(words: Column) -> Column:
    """Distinct bigrams of an array of words."""
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))
    return let(words, lambda w: F.when(F.size(w) > 1, F.array_distinct(pairs(w))).otherwise(F.array().cast("array<string>")))


def anchors(templates: list[tuple[str, str, str]], threshold: float) -> list[str]:
    """Words of which every text with a unit like some template has one."""
    chosen: set[str] = set()
    for _, _, template in templates:
        words = re.sub("[^a-z0-9]+", " ", template.lower()).strip().split(" ")
        pairs = set(zip(words, words[1:], strict=False))
        wanted = len(pairs) - ceil(threshold / (2 - threshold) * len(pairs) - 1e-9) + 1
        covered = {p for p in pairs if chosen & {*p}}
        while pairs and len(covered) < wanted:
            word = max({w for p in pairs - covered for w in p}, key=lambda w: (min(len(w), 7), sum(w in p for p in pairs - covered), w))
            chosen.add(word)
            covered |= {p for p in pairs if word in p}
    return sorted(chosen)


def read_templates(spark: SparkSession, folder: str) -> list[tuple[str, str, str]]:
    """Full texts of licences from a folder of ``<SPDX identifier>.txt``: a parameter's size, not the data's."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1), F.lit("full"), "value")
    return sorted(map(tuple, files.collect()))


def template_table(spark: SparkSession, templates: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(number, license, part, grams, size); templates without a bigram are left out."""
    rows = [(i, *t) for i, t in enumerate(TEMPLATES if templates is None else templates)]
    rows = spark.createDataFrame(rows, "number int, license string, part string, template string")
    grams = bigrams(F.split(normalised(F.col("template")), " "))
    return rows.select("number", "license", "part", grams.alias("grams")).withColumn("size", F.size("grams")).filter("size > 0")


def segments(text: Column) -> Column:
    """The words of each segment, in order; segments without a word are left out."""
    cut = F.regexp_replace(F.translate(F.lower(text), "|", " "), r"[.!?;:]\s|\n", " | ")
    parts = F.split(F.regexp_replace(cut, "[^a-z0-9|]+", " "), r"\|")
    return F.filter(F.transform(parts, lambda p: F.split(F.trim(p), " ")), lambda w: w[0] != "")


def beginnings(parts: Column) -> Column:
    """Numbers of words before each segment, and of all words."""
    owner = F.flatten(F.transform(parts, lambda w, i: F.array_repeat(i, F.size(w))))
    new = lambda of: F.filter(F.sequence(F.lit(0), F.size(of) - 1), lambda k: (k == 0) | (F.get(of, k) != F.get(of, F.greatest(k - 1, F.lit(0)))))
    return let(owner, lambda of: F.when(F.size(of) > 0, F.concat(new(of), F.array(F.size(of)))))


def best_unit(parts: Column, begins: Column, grams: Column, size: Column, threshold: float) -> Column:
    """(dice, unit_bigrams) of the unit most like a template; ``begins`` are the numbers of words before the segments,
    and of all words."""
    n, at = F.size(parts), lambda i: F.get(begins, i)
    least, most = threshold / (2 - threshold) * size - 1e-9, (2 - threshold) / threshold * size + 1e-9
    # the template's bigrams in each segment, with that across its end: their sum is no less than what a unit shares
    ahead = lambda i: F.concat(F.get(parts, i), F.coalesce(F.slice(F.get(parts, i + 1), 1, 1), F.array().cast("array<string>")))
    hits = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.size(F.array_intersect(bigrams(ahead(i)), grams)))

    def runs(h: Column) -> Column:
        def ends(i: Column) -> Column:
            fits = lambda j: (at(j + 1) - at(i) - 1).between(least, most)
            shares = lambda j: F.aggregate(F.sequence(i, j), F.lit(0), lambda x, s: x + F.get(h, s)) >= least
            touched = lambda j: (F.get(h, j) > 0) | (F.get(h, F.greatest(j - 1, F.lit(0))) > 0)
            some = F.sequence(i, F.least(n - 1, i + F.ceil(most).cast("int")))  # a segment has a word at least
            return F.transform(F.filter(some, lambda j: fits(j) & touched(j) & shares(j)), lambda j: F.struct(i.alias("a"), j.alias("b")))

        return F.flatten(F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(h, i) > 0), ends))

    unit = lambda r: bigrams(F.flatten(F.transform(F.sequence(r["a"], r["b"]), lambda s: F.get(parts, s))))
    value = lambda u: F.struct(F.round(2 * F.size(F.array_intersect(u, grams)) / (F.size(u) + size), 6).alias("dice"), F.size(u).alias("unit_bigrams"))
    return F.array_max(F.transform(let(hits, runs), lambda r: let(unit(r), value)))


def scan(
    docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, license, part, dice, unit_bigrams): for every document and template that one of its units is
    like, the best such unit's coefficient and size."""
    spark, given = docs.sparkSession, TEMPLATES if templates is None else templates
    known, words = template_table(spark, given), anchors(given, threshold)
    if not words:
        return spark.createDataFrame([], f"`{id_col}` long, license string, part string, dice double, unit_bigrams int")
    text = F.col(f"`{text_col}`").cast("string")
    # short words are parts of many others, so they are looked for as words
    long, short = [w for w in words if len(w) > 3], [w for w in words if len(w) < 4]
    tests = [lambda t, w=w: F.contains(t, F.lit(w)) for w in long] + ([lambda t: t.rlike(f"(?<![a-z0-9])(?:{'|'.join(short)})(?![a-z0-9])")] if short else [])
    possible = let(F.lower(text), lambda t: reduce(lambda a, b: a | b, [f(t) for f in tests]))
    rows = docs.filter(possible).select(F.col(id_col).cast("long").alias("id"), text.alias("text")).distinct()
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "licences")  # the few texts that may match, under fixed row numbers
    grams = rows.select("row", F.explode_outer(bigrams(F.split(normalised(F.col("text")), " "))).alias("gram")).withColumn("hash", F.xxhash64("gram"))
    each = known.select("number", "size", F.explode("grams").alias("known_gram")).withColumn("known_hash", F.xxhash64("known_gram"))
    few = sum(len(t.split()) for _, _, t in given) <= MAX_BROADCAST  # a bound on the bigrams
    hits = grams.join(F.broadcast(each) if few else each, (F.col("hash") == F.col("known_hash")) & (F.col("gram") == F.col("known_gram")))
    enough = F.col("shared") >= threshold / (2 - threshold) * F.col("size") - 1e-9
    found = hits.groupBy("row", "number", "size").agg(F.count("*").alias("shared")).filter(enough).select("row", "number")
    cut = rows.join(found, "row").withColumn("segments", segments(F.col("text"))).drop("text")
    cut = cut.select("row", "id", "number", "segments", beginnings(F.col("segments")).alias("begins"))
    pairs = cut.join(F.broadcast(known) if few else known, "number")
    best = pairs.select("row", "id", "license", "part", best_unit(F.col("segments"), F.col("begins"), F.col("grams"), F.col("size"), threshold).alias("b"))
    best = best.filter(F.col("b.dice") >= threshold).groupBy("row", "id", "license", "part").agg(F.max("b").alias("b"))
    return best.select(F.col("id").alias(id_col), "license", "part", "b.dice", "b.unit_bigrams")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ORACLE_SQL = f"""
WITH template AS (
  SELECT license, part, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM (SELECT license, part, string_split(trim(regexp_replace(lower(template), '[^a-z0-9]+', ' ', 'g')), ' ') AS w
    FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)}, {_quoted(c)})" for a, b, c in TEMPLATES)}) t(license, part, template))),
doc AS (SELECT row_number() OVER () AS r, doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(
    translate(lower(text), '|', ' '), '[.!?;:]\\s|\\n', ' | ', 'g'), '[^a-z0-9|]+', ' ', 'g'), '|'), lambda p: string_split(trim(p), ' ')), lambda w: w[1] <> '') AS s
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE regexp_matches(lower(text), '[a-z0-9][^a-z0-9]+[a-z0-9]'))),
word AS (SELECT r, doc_id, flatten(s) AS w, list_transform(range(0, len(s) + 1), lambda i: list_sum([0] || list_transform(s[1:i], lambda x: len(x)))::BIGINT) AS b FROM doc),
gram AS (SELECT DISTINCT r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM word),
each_gram AS (SELECT license, part, len(g) AS m, unnest(g) AS x FROM template),
cand AS (SELECT r, license, part FROM gram JOIN each_gram USING (x) GROUP BY r, license, part, m HAVING count(*) >= {THRESHOLD / (2 - THRESHOLD)} * m - 1e-9),
run AS (
  SELECT r, doc_id, license, part, g, w, begins.a, ends.z
  FROM cand JOIN word USING (r) JOIN template USING (license, part), unnest(b[:len(b) - 1]) AS begins(a), unnest(b[2:]) AS ends(z)
  WHERE ends.z - begins.a - 1 BETWEEN {THRESHOLD / (2 - THRESHOLD)} * len(g) - 1e-9 AND {(2 - THRESHOLD) / THRESHOLD} * len(g) + 1e-9),
unit AS (SELECT r, doc_id, license, part, g, list_distinct(list_transform(range(a + 1, z), lambda i: w[i] || ' ' || w[i + 1])) AS u FROM run),
pair AS (SELECT r, doc_id, license, part, round(2.0 * len(list_intersect(u, g)) / (len(u) + len(g)), 6) AS dice, len(u) AS n FROM unit)
SELECT doc_id, license, part, max(dice)::DOUBLE AS dice, arg_max(n, dice * 1e6 + n / 1e6)::INTEGER AS unit_bigrams
FROM pair WHERE dice >= {THRESHOLD} GROUP BY r, doc_id, license, part
"""
