"""Licence scans: TF-IDF cosine of licence statements to templates, then inheritance from the nearest ancestor directory.

Headers are the lines of a whole text that speak of licensing (MARKS); a licence file is compared as a whole as well.
Each becomes a sparse vector of term counts times inverse document frequencies, and its cosine with each template's
vector is taken. Document frequencies are counted over all statements of the corpus, for the templates' terms; any other
term has the frequency 0. So the counts that come back are as many as the templates have terms, and the rest of the work
stays within a row: DataFrame expressions only, no exploded terms, no shuffle.

A file with a statement of its own keeps that licence. Others take the licence of the nearest directory above them that
holds a licence file: distinct directories are joined, through their ancestors, to the directories that have one.

Null or empty text: no statement. Very long texts: whole. Null path: no inheritance. Ties: the highest score, then the least licence name, then
the first line; of several licence files in a directory the best scored, then the least name. Repeated rows: alike. Empty
table: no rows. Extra columns are carried along, except those named like the results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import join_small, materialise, renamed

#: Short statements by SPDX identifier.
SHORT: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Headers of several lines and full texts by SPDX identifier, as their licences give them.
LONG: dict[str, str] = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
#: The title paragraphs of full texts by SPDX identifier. Full texts of one family share most words; their
#: title, a header of its own, tells them and their versions apart.
TITLES: dict[str, str] = {
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache-2.0": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "CC0-1.0": "Creative Commons Legal Code CC0 1.0 Universal",
    "GFDL-1.2": "GNU Free Documentation License Version 1.2, November 2002",
    "GFDL-1.3": "GNU Free Documentation License Version 1.3, 3 November 2008",
    "GPL-1.0": "GNU GENERAL PUBLIC LICENSE Version 1, February 1989",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.0": "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "MPL-1.1": "MOZILLA PUBLIC LICENSE Version 1.1",
    "MPL-2.0": "Mozilla Public License Version 2.0",
}
#: Template name to text; further forms of a licence have its name, LONG_MARK and what they are.
LONG_MARK = " ("
TEMPLATES: dict[str, str] = SHORT | {f"{k}{LONG_MARK}text)": v for k, v in LONG.items()} | {f"{k}{LONG_MARK}title)": v for k, v in TITLES.items()}
MARKS = r"(?i)licen[cs]|copyright|redistribut|public domain|unencumbered|legal code"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
THRESHOLD = 0.6
LICENSE_NAME = r"(?i)^(licen[cs]e|copying|unlicense)"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def statements(files: DataFrame, marks: str = MARKS) -> DataFrame:
    """files without text, with name, dir, is_license_file and statements: array of (line, terms): each line that speaks of
    licensing, each run of lines without a blank one that does (lines -2, -3, ...), and of a licence file the whole text (-1)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.transform(F.split(text, r"\r?\n"), lambda x, i: F.struct(i.alias("line"), x.alias("x")))
    found = F.transform(F.filter(lines, lambda s: s["x"].rlike(marks)), lambda s: F.struct(s["line"].alias("line"), terms(s["x"]).alias("terms")))
    parts = F.transform(F.split(text, r"\r?\n[ \t]*\r?\n"), lambda x, i: F.struct((-2 - i).alias("line"), x.alias("x")))  # headers of several lines
    headers = F.transform(F.filter(parts, lambda s: s["x"].contains("\n") & s["x"].rlike(marks)), lambda s: F.struct(s["line"].alias("line"), terms(s["x"]).alias("terms")))
    found = F.concat(found, headers)
    none = F.array().cast("array<struct<line:int,terms:array<string>>>")
    name = F.element_at(F.split("path", "/"), -1)
    whole = F.array(F.struct(F.lit(-1).alias("line"), terms(text).alias("terms")))
    is_file = F.coalesce(F.col("name").rlike(LICENSE_NAME), F.lit(False))
    out = files.withColumn("name", name).withColumn("dir", F.when(F.instr("path", "/") > 0, F.expr("substring(path, 1, length(path) - length(name) - 1)")).otherwise(F.when(F.col("path").isNotNull(), F.lit("."))))
    out = out.withColumn("is_license_file", is_file).withColumn("statements", F.when(text.rlike(marks), F.when(F.col("is_license_file"), F.concat(whole, found)).otherwise(found)).otherwise(none))
    return out.drop("text")


def term_weights(scanned: DataFrame, templates: Mapping[str, str]) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of the templates' terms over all statements, and that of any other term."""
    vocabulary = sorted({t for text in templates.values() for t in re.findall(TERM, text.lower())})
    each = scanned.select(F.explode("statements").alias("s"))
    held = F.array(*[F.lit(t) for t in vocabulary])
    counts = each.select(F.explode(F.array_intersect(F.array_distinct("s.terms"), held)).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    n = each.count()
    seen = {r["t"]: r["df"] for r in counts.collect()}  # as many rows as the templates have terms
    idf = lambda df: math.log((1 + n) / (1 + df)) + 1
    return {t: idf(seen.get(t, 0)) for t in vocabulary}, idf(0)


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def best_template(statement_terms: Column, templates: Mapping[str, str], weights: dict[str, float], other: float) -> Column:
    """struct(score, license): the template of highest cosine."""
    idf = F.create_map(*[F.lit(x) for t, w in sorted(weights.items()) for x in (t, w)])
    vectors = []
    for name, text in sorted(templates.items()):
        v = {t: c * weights[t] for t, c in Counter(re.findall(TERM, text.lower())).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append((name, F.create_map(*[F.lit(x) for t, w in sorted(v.items()) for x in (t, w / norm)])))
    def vector(sorted_terms: Column) -> Column:
        """The weighed terms of the vocabulary and the norm over all terms, from runs of equal terms."""
        n = F.size(sorted_terms)
        starts = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(sorted_terms, i) != F.get(sorted_terms, i - 1)))).otherwise(F.array().cast("array<int>"))

        def weighed(first: Column) -> Column:
            term = lambda i: F.get(sorted_terms, i)
            return F.transform(first, lambda i, r: F.struct(term(i).alias("t"), ((F.coalesce(F.get(first, r + 1), n) - i) * F.coalesce(F.try_element_at(idf, term(i)), F.lit(other))).alias("w")))

        known = lambda v: F.filter(v, lambda e: F.try_element_at(idf, e["t"]).isNotNull())
        norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, e: a + e["w"] * e["w"]))
        return _let(_let(starts, weighed), lambda v: F.struct(known(v).alias("v"), norm(v).alias("norm")))

    with_norm = _let(F.sort_array(statement_terms), vector)

    def cosine(c: Column, vector: Column) -> Column:
        dot = F.aggregate(c["v"], F.lit(0.0), lambda a, e: a + e["w"] * F.coalesce(F.try_element_at(vector, e["t"]), F.lit(0.0)))
        return F.round(F.coalesce(F.try_divide(dot, c["norm"]), F.lit(0.0)), 9)

    def scores(c: Column) -> Column:
        each = [F.struct(cosine(c, m).alias("score"), F.lit(name).alias("license")) for name, m in vectors]
        return F.reduce(F.array(*each), F.struct(F.lit(-1.0).alias("score"), F.lit("").alias("license")), lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a))

    return F.get(F.transform(F.array(with_norm), scores), F.lit(0))


def own_licenses(scanned: DataFrame, templates: Mapping[str, str], threshold: float) -> DataFrame:
    """scanned without statements, with own_license and own_score (null without a statement that is near a template)."""
    weights, other = term_weights(scanned, templates)
    scored = F.transform("statements", lambda s: best_template(s["terms"], templates, weights, other))
    best = F.reduce(scored, F.struct(F.lit(-1.0).alias("score"), F.lit("").alias("license")), lambda a, b: F.when((b["score"] > a["score"]) | ((b["score"] == a["score"]) & (b["license"] < a["license"])), b).otherwise(a))
    out = scanned.withColumn("best", F.when(F.size("statements") > 0, best)).drop("statements")
    near = F.col("best.score") >= threshold
    return out.withColumn("own_license", F.when(near, F.substring_index("best.license", LONG_MARK, 1))).withColumn("own_score", F.when(near, F.round("best.score", 6))).drop("best")


def inherited_licenses(files: DataFrame) -> DataFrame:
    """dir, inherited, inherited_from: for each distinct directory the licence of the nearest one at or above it."""
    holders = files.where("is_license_file AND own_license IS NOT NULL AND dir IS NOT NULL").groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("l"))).alias("b")).select(F.col("dir").alias("above"), F.col("b.l").alias("inherited"))
    parts = F.split("dir", "/")
    dirs = files.where("dir IS NOT NULL").select("dir").distinct()
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))).alias("a")).select("dir", "a.*")
    found = join_small(above, materialise(holders, "license-dirs"), ["above"], F.col("dir"), "inner")
    nearest = found.groupBy("dir").agg(F.max(F.struct("depth", "above", "inherited")).alias("m"))
    return nearest.select("dir", F.col("m.inherited").alias("inherited"), F.col("m.above").alias("inherited_from"))


RESULTS = ("own_license", "own_score", "license", "how", "inherited_from")


def scan(files: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files (path, text, others) without text, with own_license, own_score, license, how (own, inherited, none), inherited_from."""
    kept = [c for c in files.columns if c != "text" and c not in RESULTS]
    apart, back = renamed(kept)
    scanned = materialise(statements(files.select(*apart, "path", "text")), "statements")
    own = materialise(own_licenses(scanned, templates, threshold), "licenses")
    out = join_small(own, materialise(inherited_licenses(own), "inherited"), ["dir"], F.col("path"), "left")
    has = F.col("own_license").isNotNull()
    how = F.when(has, F.lit("own")).when(F.col("inherited").isNotNull(), F.lit("inherited")).otherwise(F.lit("none"))
    return out.select(*back, "own_license", "own_score", F.coalesce("own_license", "inherited").alias("license"), how.alias("how"), F.when(~has, F.col("inherited_from")).alias("inherited_from"))


#: The least share of a licence file's terms that stand in the templates; its length doesn't matter.
FILE_TERMS = 0.5


def documents_as_files(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, path, text: a tree of source / 1024 ids / 64 ids; a text that speaks of licensing, mostly in the templates'
    own terms, is its LICENSE."""
    text = F.coalesce("text", F.lit(""))
    known = F.array(*[F.lit(t) for t in sorted({t for x in templates.values() for t in re.findall(TERM, x.lower())})])
    found = terms(text)
    mostly = F.size(F.filter(found, lambda t: F.array_contains(known, t))) >= F.size(found) * FILE_TERMS
    name = F.when(text.rlike(MARKS) & mostly, F.lit("LICENSE")).otherwise(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    part = lambda n: F.floor(F.col("doc_id") / n).cast("bigint").cast("string")
    return docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.concat(F.lit("a"), part(1024)), F.concat(F.lit("b"), part(64)), name).alias("path"), "text")
