"""Licence scans: Dice similarity of word bigrams with licence templates.

A document's segments are its lines, its paragraphs (between blank lines), runs
of consecutive paragraphs of at most one and a half times the words that a
template could match, and the whole text.  Runs are only made in documents that
hold two thirds of some template's bigrams, without which none can match.  A segment is normalised to lower-case words of letters and
digits, and its set of word bigrams A is compared to each template's set B by
``2 |A & B| / (|A| + |B|)``.  A template can reach the threshold s only if
``|B| s / (2 - s) <= |A| <= |B| (2 - s) / s``, so most segments are done after
their sizes are known, and others meet only templates of about their size.
(A segment has at least as many bigrams as distinct words, less one, so long
ones are set aside before any bigram is made.)

Everything happens within a row, by built-in functions: no shuffle, and the
templates, a fixed list, are literals of the plan.

Defined results: a null or empty text, or one that no template comes near, has
no licence and similarity 0.  A template of less than two words, which has no
bigram, is never found.  Of templates with equal similarity the first by
name wins.  Repeated rows get equal results.  An empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted
    provided that the following conditions are met: 1. Redistributions of source code must retain the above
    copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form
    must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
    promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
    WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
    PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
    INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
    GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
    LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
    OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

# Texts of licences and of the usual notices, as published.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": f"{_BSD_2} {_BSD_END}",
    "BSD-2-Clause-conditions": _BSD_2,
    "BSD-3-Clause": f"{_BSD_2} {_BSD_3} {_BSD_END}",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
        General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
        SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT-notice": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def _runs(paragraphs: Column, sets: dict[str, list[str]], threshold: float, lowest: float, highest: float) -> Column:
    """Words of the runs of two paragraphs or more whose sizes may match, if the text has enough of a template."""
    most, least = math.ceil(1.5 * highest), math.ceil(lowest) + 1
    every = F.array(*map(F.lit, sorted({g for grams in sets.values() for g in grams})))
    none = F.array().cast("array<array<string>>")

    def let(value: Column, body) -> Column:  # computes the value once
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def of(words: Column, ends: Column) -> Column:
        def run(i: Column) -> Column:
            begin = F.get(ends, i)
            later = F.filter(F.slice(ends, i + 3, F.lit(most)), lambda e: (e - begin >= least) & (e - begin <= most))
            return F.transform(later, lambda e: F.slice(words, begin + 1, e - begin))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(ends) - 2), run))

    def ends(parts: Column) -> Column:
        return F.aggregate(parts, F.array(F.lit(0)), lambda a, w: F.array_append(a, F.element_at(a, -1) + F.size(w)))

    def held(words: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
        return F.array_intersect(grams, every)

    def enough(words: Column) -> Column:
        return F.when(F.size(words) > 1, let(held(words), lambda h: _any_template(h, sets, threshold))).otherwise(False)

    def runs(parts: Column) -> Column:
        return F.when(F.size(parts) > 1, let(F.flatten(parts), lambda words: F.when(enough(words), let(ends(parts), lambda e: of(words, e))).otherwise(none))).otherwise(none)

    words = F.transform(paragraphs, lambda p: F.filter(F.split(p, "[ \n]"), lambda w: w != ""))
    return let(F.filter(words, lambda w: F.size(w) > 0), runs)


def _any_template(held: Column, sets: dict[str, list[str]], threshold: float) -> Column:
    """Whether |B| s / (2 - s) bigrams of a template are there, as 2 |A & B| >= s (|A| + |B|) needs."""
    found = F.lit(False)
    for grams in sets.values():
        found = found | (F.size(F.array_intersect(held, F.array(*map(F.lit, grams)))) >= len(grams) * threshold / (2 - threshold) - 1e-9)
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the likeliest ``license``, its ``dice``, and all ``licenses`` found (names, sorted)."""
    sets = {name: grams for name in sorted(templates) if (grams := bigrams(templates[name]))}
    if not sets:
        none = F.lit(None).cast("string")
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), none.alias("license"), F.lit(0.0).alias("dice"), F.lit("").alias("licenses"))
    lowest = min(map(len, sets.values())) * threshold / (2 - threshold)
    highest = max(map(len, sets.values())) * (2 - threshold) / threshold
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    table = "array(" + ", ".join(f"named_struct('name', {quoted(name)}, 'grams', array({', '.join(map(quoted, grams))}))" for name, grams in sets.items()) + ")"

    text = F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    lines = F.split("text", "\n")
    segments = F.when(F.instr("text", "\n") == 0, F.array("text")).otherwise(F.array_distinct(F.concat(lines, F.split("text", r"\n ?(?:\n ?)+"), F.array("text"))))
    df = df.withColumn("runs", F.when(F.col("text").rlike(r"\n ?\n"), _runs(F.split("text", r"\n ?(?:\n ?)+"), sets, threshold, lowest, highest)).otherwise(F.expr("array()").cast("array<array<string>>")))
    words = F.transform(segments, lambda s: F.filter(F.split(s, "[ \n]"), lambda w: w != ""))
    df = df.select("doc_id", F.concat(F.filter(words, lambda w: F.size(w) - 1 >= max(1, lowest)), "runs").alias("segments"))
    df = df.withColumn("segments", F.expr(f"filter(segments, w -> size(array_distinct(w)) - 1 <= {highest})"))
    grams = "transform(segments, w -> array_distinct(transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1]))))"
    df = df.withColumn("segments", F.expr(grams))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    compared = f"""flatten(transform(segments, a -> transform(
        filter({table}, t -> size(a) >= size(t.grams) * {low}D AND size(a) <= size(t.grams) * {high}D),
        t -> named_struct('dice', 2D * size(array_intersect(a, t.grams)) / (size(a) + size(t.grams)), 'name', t.name))))"""
    df = df.withColumn("found", F.expr(f"filter({compared}, x -> x.dice >= {threshold}D)"))
    # highest similarity first, then by name
    best = F.expr("array_sort(found, (a, b) -> CASE WHEN a.dice > b.dice THEN -1 WHEN a.dice < b.dice THEN 1 WHEN a.name < b.name THEN -1 WHEN a.name > b.name THEN 1 ELSE 0 END)")
    df = df.withColumn("best", F.get(best, F.lit(0)))
    names = F.array_join(F.sort_array(F.array_distinct(F.transform("found", lambda x: x["name"]))), ",")
    return df.select("doc_id", F.col("best.name").alias("license"), F.coalesce("best.dice", F.lit(0.0)).alias("dice"), names.alias("licenses"))
