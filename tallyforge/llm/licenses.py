"""Licence scans, in DataFrame functions only.

Passages of a text (its lines, its paragraphs and the whole of a licence file) are compared to licence templates, short
notices and full texts, by the cosine of sparse TF-IDF vectors; document frequencies of all terms come from all texts.
A recognized licence file names its directory's licence; every file without a notice of its own takes the licence of
its nearest ancestor directory, found by joins of paths.

A passage can only reach the least cosine with a template if it holds one of that template's heaviest terms: those
without which the rest of the template is too short.  That gate loses nothing and leaves few passages, each text of
which is scored once, by joins of its terms.  Weights are integers (thousandths of the idf), so that scores agree in any
engine.  Only the templates' terms, whose number is fixed, reach the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this program."
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES."
#: Notices as they stand in headers, and the opening or full texts of licence files.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _GNU.format(name="GNU General Public License", v="3")],
    "LGPL-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", _GNU.format(name="GNU Lesser General Public License", v="2.1")],
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", _GNU.format(name="GNU Affero General Public License", v="3")],
    "MPL-2.0": [
        "This file is subject to the terms of the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS,
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}
TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
LICENCE_FILE = r"(^|/)(LICENSE|LICENCE|COPYING)[^/]*$"
PARAGRAPH = r"\n[ \t\r]*\n"
#: Least cosine, in thousandths.
LEAST = 700


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def vocabulary(templates: dict[str, list[str]] | None = None) -> list[tuple[str, str, str, int]]:
    """(template, license, term, count) of each template's terms."""
    out = []
    for name, texts in (templates or TEMPLATES).items():
        for k, text in enumerate(texts):
            found = re.findall(TERM, text.lower())
            out += [(f"{name}/{k}", name, t, found.count(t)) for t in dict.fromkeys(found)]
    return out


def frequencies(files: DataFrame) -> DataFrame:
    """t, df: the number of texts that hold each term; and of all texts, under the empty term."""
    each = F.concat(F.array(F.lit("")), F.array_distinct(terms(F.coalesce("text", F.lit("")))))
    return files.select(F.explode(each).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    """In thousandths: floor(1000 ln(1 + N / df)); a term of no text counts as one of one text."""
    return F.floor(1000 * F.log(1.0 + n / F.coalesce(df, F.lit(1)).cast("double"))).cast("long")


def gate(weighted: list, least: int = LEAST) -> str:
    """A pattern of the terms one of which a passage needs.  ``weighted``: rows of tpl, t, w.

    Of each template the heaviest terms, until the rest is shorter than ``least`` thousandths of the whole: without one
    of them no cosine reaches that (by the Cauchy-Schwarz inequality over the rest).
    """
    by_template: dict[str, list[tuple[int, str]]] = {}
    for r in weighted:
        by_template.setdefault(r.tpl, []).append((r.w, r.t))
    need = set()
    for rows in by_template.values():
        rest = total = sum(w * w for w, _ in rows)
        for w, t in sorted(rows, reverse=True):
            if rest * 1_000_000 < (least - 1) ** 2 * total:
                break
            need.add(t)
            rest -= w * w
    words, numbers = ("|".join(re.escape(t) for t in sorted(need) if t[0].isdigit() == digit) for digit in (False, True))
    return "|".join(p for p in (words and f"(?<![a-z])({words})(?![a-z])", numbers and f"(?<![0-9])({numbers})(?![0-9])") if p)


def scan(files: DataFrame, path: str = "path", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """``files`` without text and with ``found``: struct(score, license) of the best passage, score in thousandths; null
    below LEAST or without one.

    ``files``: path, text (null: none) and any other columns.  Texts are read twice and never shuffled; only passages
    that pass the gate are, each different one once.
    """
    spark = files.sparkSession
    df = cut(frequencies(files.select("text")))
    n = F.lit(df.filter("t = ''").agg(F.coalesce(F.max("df"), F.lit(0))).first()[0])
    tv = spark.createDataFrame(vocabulary(templates), "tpl string, license string, t string, c long")
    weighted = tv.join(F.broadcast(df.join(F.broadcast(tv.select("t").distinct()), "t")), "t", "left").select("tpl", "license", "t", (F.col("c") * idf(n, F.col("df"))).alias("w"))
    weighted = cut(weighted)  # as many rows as the templates have terms
    needed = gate(weighted.collect())
    sizes = weighted.groupBy("tpl", "license").agg(F.sum(F.col("w") * F.col("w")).cast("double").alias("size"))
    text = F.coalesce("text", F.lit(""))
    whole = F.when(F.col(path).rlike(LICENCE_FILE), F.array(text)).otherwise(F.array().cast("array<string>"))
    passages = F.array_distinct(F.concat(F.filter(F.split(text, "\n"), lambda x: F.lower(x).rlike(needed)), F.filter(F.split(text, PARAGRAPH), lambda x: F.lower(x).rlike(needed)), whole))
    rows = cut(files.withColumn("_l_passages", F.when(F.lower(text).rlike(needed), passages)).drop("text"))
    rows = rows.withColumn("_l_row", F.monotonically_increasing_id())
    each = rows.select("_l_row", F.explode("_l_passages").alias("p")).withColumn("k", F.xxhash64("p")).withColumn("k2", F.xxhash64(F.lit("second"), "p"))
    lines = each.groupBy("k", "k2").agg(F.first("p").alias("p"))
    # Terms of one passage: those of templates are joined by broadcast, the others' frequencies by their term.
    counted = cut(lines.select("k", "k2", F.explode(terms(F.col("p"))).alias("t")).groupBy("k", "k2", "t").agg(F.count(F.lit(1)).alias("c")))
    norms = counted.join(df, "t").groupBy("k", "k2").agg(F.sum(F.pow(F.col("c") * idf(n, F.col("df")), 2)).alias("norm"))
    own = weighted.groupBy("t").agg(F.collect_list(F.struct("tpl", "w")).alias("of"))  # a fixed number
    held = counted.join(F.broadcast(df.join(F.broadcast(tv.select("t").distinct()), "t")), "t").select("k", "k2", "t", (F.col("c") * idf(n, F.col("df"))).alias("pw"))
    dots = held.join(F.broadcast(own), "t").select("k", "k2", "pw", F.explode("of").alias("o")).groupBy("k", "k2", F.col("o.tpl").alias("tpl")).agg(F.sum(F.col("pw") * F.col("o.w")).alias("dot"))
    scored = dots.join(F.broadcast(sizes), "tpl").join(norms, ["k", "k2"])
    score = F.floor(1000.0 * F.col("dot") / F.sqrt(F.col("norm") * F.col("size"))).cast("long")
    best = cut(scored.select("k", "k2", score.alias("score"), "license").filter(F.col("score") >= LEAST).groupBy("k", "k2").agg(F.max(F.struct("score", "license")).alias("found")))
    got = each.select("_l_row", "k", "k2").join(maybe_broadcast(best, best.count()), ["k", "k2"]).groupBy(F.col("_l_row").alias("_l_of")).agg(F.max("found").alias("found"))
    return rows.join(got, F.col("_l_row") == F.col("_l_of"), "left").drop("_l_row", "_l_of", "_l_passages")


def parent(path: Column) -> Column:
    """The directory of a path, without a slash at its end; the root is empty."""
    return F.regexp_replace(path, r"/[^/]*$", "")


def inherit(files: DataFrame, path: str = "path", licence_file: str = LICENCE_FILE) -> DataFrame:
    """Add ``license``, ``score`` and ``license_from``: 'own', a directory, or null.

    ``files``: path and found (from scan()); a null path has no directory.  The best licence file of a directory counts
    (by score, then name).  Only distinct directories are joined with their ancestors, however many files they have.
    """
    df = files.withColumn("_l_dir", parent(F.col(path)))
    named = df.filter(F.col("found").isNotNull() & F.col(path).rlike(licence_file)).groupBy(F.col("_l_dir").alias("at")).agg(F.max("found").alias("given"))
    dirs = df.filter("found is null").select("_l_dir").filter("_l_dir is not null").distinct()
    parts = F.split("_l_dir", "/")
    ups = dirs.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("up", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    nearest = ups.join(named, F.col("up") == F.col("at")).groupBy(F.col("_l_dir").alias("_l_key")).agg(F.max(F.struct("depth", "at", "given")).alias("_l_near"))
    out = df.join(nearest, F.col("found").isNull() & (F.col("_l_dir") == F.col("_l_key")), "left")
    got = F.coalesce("found", "_l_near.given")
    return out.withColumns({"license": got["license"], "score": got["score"], "license_from": F.when(F.col("found").isNotNull(), F.lit("own")).otherwise(F.col("_l_near.at"))}).drop("_l_dir", "_l_key", "_l_near", "found")


def scan_licences(files: DataFrame, path: str = "path") -> DataFrame:
    """path and text -> all other columns with license, score and license_from.  Repeated rows are kept, an empty table
    gives an empty result, null texts have no notice; input columns named as the added ones (or ``found``) are replaced and
    ``_l_*`` names are used here.  The scores are cut to a table before the joins of paths."""
    return inherit(cut(scan(files.drop("found", "license", "score", "license_from"), path)), path)
