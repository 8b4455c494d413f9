"""Licence scans: texts, their lines and windows of their words against licence templates, with DataFrame functions only.

A unit is the whole text, one line of it, or a window of the text's words. It is lower-cased; runs of anything but a-z and 0-9
become one space. Its set is its distinct word bigrams. For a template of t bigrams and a unit of u, the
Dice coefficient 2 * common / (t + u) can reach ``threshold`` only if u lies between
t * threshold / (2 - threshold) and t * (2 - threshold) / threshold; other pairs are never compared,
and units that no template's bounds admit get no bigrams at all. A unit has at most one bigram less than words, and at least one
less than distinct words, so most units are pruned before their bigrams are made.

Windows find notices that are wrapped over lines or stand inside a paragraph. Each template has anchors: of its words, by
length, so many that no unit that matches can lack them all. A window has as many words as the template and starts
so that an anchor in it lies where the template has it; words between lines count on, whatever marks a comment. So only texts that
hold an anchor have windows, and only a few each.

Defined results: a null or empty text, or one of fewer than two words, has no bigrams and matches
nothing (null licence, Dice 0, 0 units). Ties between templates go to the first identifier by
alphabet. Rows are independent, so repeated rows give repeated results and hot sources don't matter. A very long text is read whole, as
one row until its units are made. Other columns, also with names of result columns, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices and texts of public licences, by SPDX identifier; a licence may have several.
BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. " + BSD_DISCLAIMER,
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission. " + BSD_DISCLAIMER,
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. "
        "If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0-or-later",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("proprietary", "All rights reserved."),
]
THRESHOLD = 0.8
#: Words that any prose has, and so are no good to look for.
COMMON = frozenset("a all an and any are as at be by for from if in is it no not of on or that the this to under which with you".split())


def template_words(text: str) -> list[str]:
    """Words of a template, as a unit's are made."""
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template."""
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def anchors(text: str, threshold: float) -> list[tuple[str, int, int]]:
    """(word, its place in the template, words of the template) of a template's anchors: its longest words, common ones last, so many that
    fewer bigrams are without any than a match has in common."""
    words, grams = template_words(text), template_bigrams(text)
    lo, hi = size_bounds(len(grams), threshold)
    need = min(math.ceil(threshold * (len(grams) + u) / 2 - 1e-9) for u in range(lo, hi + 1))
    chosen: set[str] = set()
    for w in sorted(set(words), key=lambda w: (w in COMMON, -len(w), w)):
        if sum(not chosen.intersection(g.split()) for g in grams) < need:
            break
        chosen.add(w)
    return [(w, k, len(words)) for k, w in enumerate(words) if w in chosen]


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Least and greatest number of bigrams with which a unit can match a template of n."""
    fits = [u for u in range(1, int(n * (2 - threshold) / threshold) + 2) if 2 * min(n, u) >= threshold * (n + u)]
    return fits[0], fits[-1]


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """For each document: doc_id, license (of the best unit), dice, n_units (that match any template),
    licenses (all identifiers found, sorted)."""
    known = sorted((name, template_bigrams(text)) for name, text in templates or TEMPLATES)
    known = [(name, grams, *size_bounds(len(grams), threshold)) for name, grams in known if grams]
    least, most = min(x[2] for x in known), max(x[3] for x in known)

    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    # A text of one line is one unit. Only ASCII letters change case, as in the templates.
    units = F.when(F.size(lines) > 1, F.concat(lines, F.array(text))).otherwise(lines)

    def words(unit: Column) -> Column:
        plain = F.regexp_replace(F.translate(unit, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " ")
        return F.filter(F.split(plain, " "), lambda w: w != "")

    def best(grams: Column) -> Column:
        """Highest (dice, first name) over the templates whose bounds admit the set."""
        scored = [
            F.when(
                F.size(grams).between(lo, hi),
                F.struct(
                    (F.lit(2.0) * F.size(F.array_intersect(grams, F.array(*map(F.lit, ref)))) / (F.size(grams) + len(ref))).alias("dice"),
                    F.lit(-k).alias("rank"),
                    F.lit(name).alias("name"),
                ),
            )
            for k, (name, ref, lo, hi) in enumerate(known)
        ]
        return F.greatest(*scored)

    starts: dict[str, set[tuple[int, int]]] = {}
    for _, notice in templates or TEMPLATES:
        for w, place, n in anchors(notice, threshold) if template_bigrams(notice) else ():
            starts.setdefault(w, set()).add((place, n))
    marks = F.array(*map(F.lit, sorted(starts)))
    places = F.create_map(*(x for w in sorted(starts) for x in (F.lit(w), F.array(*(F.struct(F.lit(p).alias("place"), F.lit(n).alias("n")) for p, n in sorted(starts[w]))))))

    def windows(all_words: Column) -> Column:
        """The windows of a text's words, each once."""
        at = F.filter(F.transform(all_words, lambda w, i: F.when(F.array_contains(marks, w), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
        spans = F.flatten(F.transform(at, lambda x: F.transform(places[x["w"]], lambda p: F.struct(F.greatest(x["i"] - p["place"], F.lit(0)).alias("start"), p["n"].alias("n")))))
        cut = F.transform(F.array_distinct(spans), lambda x: F.slice(all_words, x["start"] + 1, x["n"]))
        return F.when(F.arrays_overlap(all_words, marks), cut).otherwise(F.array().cast("array<array<string>>"))

    # One row a unit, so that each unit's bigrams are made once; whoever has too few or too many words is gone before.
    rows = docs.select("doc_id", units.alias("units"), words(text).alias("all"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("doc_id", "row", F.explode(F.concat(F.transform("units", words), windows(F.col("all")))).alias("w"))
    rows = rows.withColumn("n", F.size("w"))
    pairs = F.when(
        F.col("n") > least,
        F.array_distinct(F.zip_with(F.slice("w", 1, F.col("n") - 1), F.slice("w", 2, F.col("n") - 1), lambda a, b: F.concat(a, F.lit(" "), b))),
    )
    rows = rows.withColumn("grams", F.when((F.col("n") - 1 <= most) | (F.size(F.array_distinct("w")) - 1 <= most), pairs))
    rows = rows.withColumn("best", F.when(F.size("grams").between(least, most), best(F.col("grams"))))
    hit = F.when(F.col("best.dice") >= threshold, F.col("best"))
    found = rows.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max(hit).alias("top"),
        F.count(hit).alias("n_units"),
        F.array_sort(F.collect_set(hit["name"])).alias("licenses"),
    )
    return found.select(
        "doc_id",
        F.col("top.name").alias("license"),
        F.round(F.coalesce("top.dice", F.lit(0.0)), 6).alias("dice"),
        F.col("n_units"),
        F.array_join("licenses", ",").alias("licenses"),
    )
