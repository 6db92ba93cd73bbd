"""Licence scans: runs of text segments compared with licence templates by the Dice coefficient over word bigrams.

Segments are the lines of a text, cut after sentence ends; those without words don't
count. A run of adjacent segments is compared whatever lines and paragraphs it spans, so
a notice on a line of its own or beside other words, a licence of several paragraphs
within a longer text, and a text that is a licence are all found. Runs and templates are
normalised to lower-case words of a-z and 0-9; a bigram that repeats counts as often as
it occurs in both. Each start gives its best run, if it reaches the threshold.

A coefficient of t needs sizes within a factor of t / (2 - t), so a run meets only the
templates within that bound, and shares at least that part of its own and of the
template's bigrams. So a text that lacks certain words of every template (its anchors)
goes first, then runs with too few known bigrams, by counts alone. All of it is one
expression a row, with no join; the templates are a literal of fixed size.

Defined results: null and empty texts and runs of fewer than two words match nothing;
equal coefficients go to the shorter run, then to the first licence by name; a table
without rows gives none; rows that repeat id and text give their runs once, and an id
with several texts gives those of each; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence notices, by SPDX name.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]


# Words too common to be anchors.
COMMON = ["a", "and", "as", "at", "be", "by", "for", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with", "you"]


def template_bigrams(text: str) -> list[str]:
    """A template's bigrams, the second of equal ones marked 2 and so on."""
    words = re.findall(r"[a-z0-9]+", text.lower())
    seen: Counter[str] = Counter()
    out = []
    for a, b in zip(words, words[1:], strict=False):
        seen[f"{a} {b}"] += 1
        out.append(f"{a} {b} {seen[f'{a} {b}']}")
    return out


def _templates(templates: list[tuple[str, str]]) -> Column:
    rows = sorted((name, template_bigrams(text)) for name, text in templates)
    text = json.dumps([{"license": n, "n": float(len(g)), "grams": g} for n, g in rows])
    return F.from_json(F.lit(text), "array<struct<license: string, n: double, grams: array<string>>>")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: a generated column isn't copied into the expressions that read it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _flat(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def anchors(templates: list[tuple[str, str]], bound: float) -> list[str]:
    """Words of which every match holds at least one: of each template as many as it takes for the bigrams without them to be too few. Long words, which are rare, come first."""
    out: set[str] = set()
    for _, text in templates:
        grams = [set(g.split(" ")[:2]) for g in template_bigrams(text)]
        spare = len(grams) - math.ceil(bound * len(grams) - 1e-9)
        while grams and spare >= 0:
            touched = Counter(w for g in grams for w in g)
            best = min(touched, key=lambda w: (w not in out, w in COMMON, -min(len(w), 7), -touched[w], w))  # noqa: B023
            out.add(best)
            left = [g for g in grams if best not in g]
            spare -= len(grams) - len(left)
            grams = left
    return sorted(out)


def _matches(found: DataFrame, threshold: float, templates: list[tuple[str, str]]) -> DataFrame:
    """The runs (doc_id, run, words) that reach the threshold, with licence and dice."""
    sizes = [len(template_bigrams(t)) for _, t in templates]
    bound = threshold / (2 - threshold)
    # The number of bigrams is that of the spaces between words.
    found = _once(found, "n", (F.octet_length("words") - F.octet_length(F.replace("words", F.lit(" "), F.lit("")))).cast("double"))
    near = [F.col("n").between(s * bound - 1e-9, s / bound + 1e-9) for s in sorted(set(sizes))]
    fits = near[0]
    for x in near[1:]:
        fits = fits | x
    found = found.filter((F.col("n") > 0) & fits)
    found = _once(found, "w", F.split("words", " "))
    # A shared bigram begins with a word of a template, and a match shares at least `bound` of the unit's bigrams.
    vocabulary = sorted({g.split(" ")[0] for _, t in templates for g in template_bigrams(t)})
    found = found.filter(F.size(F.filter("w", lambda x: x.isin(vocabulary))) >= bound * F.col("n") - 1e-9)
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    found = _once(found, "pairs", F.array_sort(pairs))
    # Equal bigrams stand together and are numbered from 1.
    found = _once(found, "grams", F.transform("pairs", lambda x, i: F.concat(x, F.lit(" "), (i + 2 - F.array_position("pairs", x)).cast("string"))))
    inside = F.filter(_templates(templates), lambda t: (F.least(t["n"], F.col("n")) >= bound * F.greatest(t["n"], F.col("n")) - 1e-9))
    scored = F.transform(inside, lambda t: F.struct(F.round(-2.0 * F.size(F.array_intersect(F.col("grams"), t["grams"])) / (t["n"] + F.col("n")), 6).alias("less"), t["license"].alias("license")))
    best = _once(found, "best", F.array_min(scored)).withColumn("dice", -F.col("best.less"))
    return best.filter(F.col("dice") >= threshold).select("doc_id", "run", F.col("best.license").alias("license"), "dice")


def license_runs(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per segment at which a run begins that reaches the threshold: doc_id, segment (from 0), segments (of its best run), license, dice."""
    sizes = [len(template_bigrams(t)) for _, t in templates]
    bound = threshold / (2 - threshold)
    most = int(max(sizes) / bound + 1e-9) + 1
    known = sorted({g.rsplit(" ", 1)[0] for _, t in templates for g in template_bigrams(t)})
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    found = _once(found, "t", F.lower("x")).drop("x")
    words = anchors(templates, bound)
    short = "|".join(w for w in words if len(w) < 4)
    # Short ones are within many other words.
    found = found.filter(reduce(Column.__or__, [*(F.contains("t", F.lit(w)) for w in words if len(w) >= 4), F.col("t").rlike(f"(?<![a-z0-9])({short})(?![a-z0-9])") if short else F.lit(False)]))
    found = _once(found, "segments", F.filter(F.transform(F.split("t", r"\n|(?<=[.!?;:])\s+"), _flat), lambda x: x != "")).drop("t")
    found = _once(found, "cells", F.transform("segments", lambda x: F.split(x, " ")))

    # Known bigrams that end in a segment, with the last word of the segment before.
    def hits(w: Column, i: Column) -> Column:
        full = F.when(i > 0, F.concat(F.slice(F.get("cells", i - 1), -1, 1), w)).otherwise(w)
        pairs = F.zip_with(full, F.slice(full, 2, F.greatest(F.size(full), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.struct(F.size(w).alias("n"), F.size(F.filter(pairs, lambda x: x.isin(known))).alias("hit"))

    found = _once(found.filter(F.size("cells") > 0), "counts", F.transform("cells", hits)).drop("cells")
    found = found.filter(F.exists("counts", lambda c: (c["hit"] > 0) & (c["hit"] >= bound * (c["n"] - 1) - 1e-9)))
    zero = F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit(0).alias("hit"), F.array().cast("array<struct<k:int,n:int,hit:int>>").alias("runs"))

    # Runs of a start as (segments, words, hits).
    def grow(a: Column, c: Column) -> Column:
        k, n, hit = a["k"] + 1, a["n"] + c["n"], a["hit"] + c["hit"]
        fits = (n - 1 <= most) & (hit >= bound * (n - 1) - 1e-9)
        runs = F.when(fits, F.concat(a["runs"], F.array(F.struct(k.alias("k"), n.alias("n"), hit.alias("hit"))))).otherwise(a["runs"])
        return F.struct(k.alias("k"), n.alias("n"), hit.alias("hit"), runs.alias("runs"))

    # By counts alone, so that only runs that may match are copied; a run has no more segments than the longest match has words.
    runs_at = lambda c, i: F.struct(i.alias("start"), F.aggregate(F.slice("counts", i + 1, most + 1), zero, grow)["runs"].alias("runs"))
    found = _once(found, "starts", F.filter(F.transform("counts", runs_at), lambda s: F.size(s["runs"]) > 0)).drop("counts")
    # The text's hash goes with the start, as an id can repeat.
    found = found.filter(F.size("starts") > 0).withColumn("text", F.xxhash64("segments"))
    words = lambda s, r: F.struct(s["start"].alias("start"), r["k"].alias("k"), F.array_join(F.slice("segments", s["start"] + 1, r["k"]), " ").alias("words"))
    found = found.select("doc_id", "text", F.explode(F.flatten(F.transform("starts", lambda s: F.transform(s["runs"], lambda r: words(s, r))))).alias("x"))
    runs = found.select("doc_id", F.struct("text", F.col("x.start").alias("start"), F.col("x.k").alias("k")).alias("run"), F.col("x.words").alias("words"))
    matched = _matches(runs, threshold, templates)
    best = matched.groupBy("doc_id", "run.text", "run.start").agg(F.min(F.struct((-F.col("dice")).alias("less"), F.col("run.k").alias("k"), "license")).alias("b"))
    return best.select("doc_id", F.col("start").cast("long").alias("segment"), F.col("b.k").cast("long").alias("segments"), F.col("b.license").alias("license"), (-F.col("b.less")).alias("dice"))


def oracle(threshold: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """The same over the table documents in DuckDB's SQL."""
    rows = ", ".join(f"({no}, '{name}', {len(g)}, {g})" for no, (name, g) in enumerate((n, template_bigrams(t)) for n, t in templates))
    bound = threshold / (2 - threshold)
    most = int(max(len(template_bigrams(t)) for _, t in templates) / bound + 1e-9) + 1
    return f"""
    WITH t(tno, license, tn, tgrams) AS (VALUES {rows}),
    tc AS (SELECT license, tn, tno, regexp_replace(x, ' [0-9]+$', '') AS g, count(*) AS tk FROM (SELECT license, tn, tno, unnest(tgrams) AS x FROM t) GROUP BY ALL),
    known AS (SELECT DISTINCT g FROM tc),
    d AS (SELECT row_number() OVER () AS r, doc_id, low FROM (SELECT DISTINCT doc_id, lower(coalesce(text, '')) AS low FROM documents)),
    s AS (SELECT r, list_filter(list_transform(string_split(regexp_replace(low, '([.!?;:])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS seg FROM d),
    e AS (SELECT r, unnest(range(len(seg))) AS i, unnest(list_transform(seg, lambda x: len(string_split(x, ' ')))) AS n FROM s),
    p AS (SELECT r, i, sum(n) OVER (PARTITION BY r ORDER BY i) - n + 1 AS a, sum(n) OVER (PARTITION BY r ORDER BY i) AS z FROM e),
    w AS (SELECT r, string_split(array_to_string(seg, ' '), ' ') AS w FROM s WHERE len(seg) > 0),
    b AS (SELECT r, unnest(range(1, len(w))) AS pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w),
    k AS (SELECT r, pos, g, sum(CASE WHEN known.g IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY pos) AS hits FROM b LEFT JOIN known USING (g)),
    c AS (SELECT x.r, x.i, y.i - x.i + 1 AS k, x.a, y.z FROM p x JOIN p y ON y.r = x.r AND y.i >= x.i AND y.z - x.a BETWEEN 1 AND {most}),
    f AS (SELECT c.r, c.i, c.k, c.a, c.z, c.z - c.a AS n FROM c JOIN k AS k2 ON k2.r = c.r AND k2.pos = c.z - 1 LEFT JOIN k AS k1 ON k1.r = c.r AND k1.pos = c.a - 1
          WHERE k2.hits - coalesce(k1.hits, 0) >= {bound} * (c.z - c.a) - 1e-9),
    m AS (SELECT f.r, f.i, f.k, f.n, k.g, count(*) AS c FROM f JOIN k ON k.r = f.r AND k.pos BETWEEN f.a AND f.z - 1 GROUP BY ALL),
    x AS (SELECT r, i, k, license, tno, round(2.0 * sum(least(c, tk)) / (any_value(n) + any_value(tn)), 6) AS dice
          FROM m JOIN tc USING (g) WHERE least(tn, n) >= {bound} * greatest(tn, n) - 1e-9 GROUP BY r, i, k, license, tno)
    SELECT doc_id, i AS segment, k AS segments, license, dice FROM x JOIN d USING (r) WHERE dice >= {threshold}
    QUALIFY row_number() OVER (PARTITION BY r, i ORDER BY dice DESC, k, license) = 1
    """
