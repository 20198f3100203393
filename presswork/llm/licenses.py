"""Licence scans: texts compared to licence templates by Dice coefficient over word bigrams.

Units are the lines of a text, its paragraphs of several lines, and the whole text. A unit and a template with u and t distinct
bigrams have a coefficient of at most 2 * min(u, t) / (u + t), so a template is compared only with
units whose size lies between t * d / (2 - d) and t * (2 - d) / d for the threshold d; units outside
all bounds are dropped before their bigrams are made (a unit has at most one bigram fewer than words). A match shares at least
t * d / (2 - d) bigrams, so for each template there are words of which a match has one at least: texts, then units, without
any such word are dropped before they are cut into words.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
#: Notices and whole texts of public licences (fixed values); whole texts stand without their copyright line.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", _GRANT, f"{_GRANT} {_WARRANTY} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "ISC": [f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}"],
    "0BSD": [f"{_ISC}. {_ISC_WARRANTY}"],
    "BSD-3-Clause": ["Released under the 3-Clause BSD License.", _BSD[: _BSD.index(" 1. ")], _BSD + _BSD_NAMES + _BSD_WARRANTY],
    "BSD-2-Clause": ["Released under the 2-Clause BSD License.", _BSD + _BSD_WARRANTY],
    "LGPL-3.0": ["This library " + _GNU.format("Lesser", 3), "This program " + _GNU.format("Lesser", 3)],
    "LGPL-2.1": ["This library " + _GNU.format("Lesser", 2.1)],
    "AGPL-3.0": ["This program " + _GNU.format("Affero", 3)],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_WARRANTY} IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
}


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a template, normalised as the texts are."""
    kept = "".join(c if c in LOWER + "0123456789" else " " for c in text.translate(str.maketrans(UPPER, LOWER)))
    words = kept.split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def telling_words(sets: list[list[str]], threshold: float) -> list[str]:
    """Words of which each unit that matches any of the templates (bigrams) has at least one: for each template,
    the bigrams without these words are too few for a match. Words of five letters and more first, as they are rarer elsewhere;
    no words if the threshold lets any unit through."""
    chosen: set[str] = set()
    low = threshold / (2 - threshold)
    for bigrams in sorted(sets, key=len):
        rest = [b.split(" ") for b in bigrams if not chosen.intersection(b.split(" "))]
        while len(rest) >= low * len(bigrams) - 1e-9:
            if not rest:
                return []
            count = Counter(w for b in rest for w in b)
            word = max(count, key=lambda w: (len(w) >= 5, count[w], len(w), w))
            chosen.add(word)
            rest = [b for b in rest if word not in b]
    return sorted(chosen)


def has_word(text: Column, words: list[str]) -> Column:
    """Whether ``text`` has one of ``words`` among its ``words_of``."""
    return text.rlike("(?i)(?<![a-z0-9])(?:" + "|".join(words) + ")(?![a-z0-9])") if words else F.lit(True)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, unit, place, license, shared, size, dice): each unit's best template from the threshold on.

    unit is line, paragraph or text; place counts from 0. dice is 2 * shared / (unit's + template's
    bigrams). Ties go to the smaller licence name, then to the larger ``shared``. Null and empty texts
    have no rows; repeated rows give repeated rows; a unit equal to a finer one (a text of one line) is
    not named twice. No shuffle."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sets = [(name, b) for name, texts in TEMPLATES.items() for b in map(bigrams_of, texts)]
    least = min(len(b) for _, b in sets) * low
    telling = telling_words([b for _, b in sets], threshold)
    some = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where(has_word(F.col("text"), telling))
    named = lambda kind, parts: F.transform(parts, lambda t, i: F.struct(F.lit(kind).alias("unit"), i.cast("long").alias("place"), t.alias("t")))
    lines, paragraphs = F.split("text", "\n", -1), F.split("text", "\n[ \t\r]*\n", -1)
    several = F.filter(named("paragraph", paragraphs), lambda p: F.contains(p["t"], F.lit("\n")))
    whole = F.when(F.size(paragraphs) > 1, named("text", F.array("text"))).otherwise(F.filter(several, lambda _: F.lit(False)))
    units = some.select("doc_id", F.explode(F.concat(named("line", lines), several, whole)).alias("u")).where(has_word(F.col("u.t"), telling))
    units = units.select("doc_id", "u.unit", "u.place", words_of(F.col("u.t")).alias("w")).where(F.size("w") - 1 >= least)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat(F.get("w", i), F.lit(" "), F.get("w", i + 1))))
    units = units.withColumn("g", grams).withColumn("size", F.size("g").cast("long")).drop("w")
    quoted = lambda x: "'" + x.replace("'", "\\'") + "'"
    templates = F.expr("array(" + ", ".join(f"named_struct('license', {quoted(name)}, 'n', {len(b)}L, 'b', array({', '.join(map(quoted, b))}))" for name, b in sets) + ")")
    size = F.col("size")
    near = F.filter(templates, lambda t: size.between(t["n"] * low, t["n"] * high))
    shared = F.transform(near, lambda t: F.struct(t["license"].alias("license"), t["n"].alias("n"), F.size(F.array_intersect("g", t["b"])).cast("long").alias("shared")))
    enough = F.filter(shared, lambda t: 2 * t["shared"] >= threshold * (size + t["n"]))
    ranked = F.array_sort(F.transform(enough, lambda t: F.struct((-2 * t["shared"] / (size + t["n"])).alias("d"), t["license"].alias("license"), (-t["shared"]).alias("shared"))))
    # outer: else Spark repeats the whole expression in a filter below
    found = units.withColumn("best", F.explode_outer(F.slice(ranked, 1, 1))).where("best is not null")
    return found.select("doc_id", "unit", "place", "best.license", (-F.col("best.shared")).alias("shared"), "size", (-F.col("best.d")).alias("dice"))


def duckdb_sql(table: str = "documents", threshold: float = THRESHOLD) -> str:
    """The same scan for DuckDB."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(n)}, [{', '.join(map(quoted, b))}])" for n, texts in TEMPLATES.items() for b in map(bigrams_of, texts))
    return f"""
WITH t(license, b) AS (VALUES {rows}),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM {table}),
p AS (SELECT doc_id, text, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS ps, string_split(text, chr(10)) AS ls FROM d),
u AS (
  SELECT doc_id, 'line' AS unit, unnest(range(len(ls))) AS place, unnest(ls) AS t FROM p
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', unnest(range(len(ps))), unnest(ps) AS t FROM p) WHERE contains(t, chr(10))
  UNION ALL SELECT doc_id, 'text', 0, text FROM p WHERE len(ps) > 1
),
w AS (SELECT doc_id, unit, place, list_filter(string_split(regexp_replace(translate(t, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM u),
g AS (SELECT doc_id, unit, place, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 2),
s AS (SELECT doc_id, unit, place, license, len(list_intersect(g, b)) AS shared, len(g) AS size, len(b) AS n FROM g, t WHERE len(g) BETWEEN len(b) * {low!r} AND len(b) * {high!r}),
h AS (SELECT *, 2 * shared / (size + n)::DOUBLE AS dice FROM s WHERE 2 * shared >= {threshold!r}::DOUBLE * (size + n))
SELECT doc_id, unit, place, license, shared, size, dice FROM h
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, place ORDER BY dice DESC, license, shared DESC) = 1
"""
