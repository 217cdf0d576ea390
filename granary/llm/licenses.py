"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

A text is read as its terms. Each template names terms that a block must have, the
first of which is its anchor: no text without it has the licence. Where a text has the
anchor, the stretch of terms that the template would cover there is a block, wherever
in a line or across lines it begins; the whole text is a block too. A block's vector has tf * idf for each of its terms; idf comes from the
templates, and terms that no template has get the idf of a term never seen. A file's
licence is that of the best block whose cosine with the template reaches LEAST, and
which has the terms it must and none of its siblings' (version, Lesser, Affero, number
of clauses). A file is a licence file if its name says so and it has a licence,
or if its whole text reaches WHOLE; a file without a licence inherits that of the
licence file in the nearest directory above it.

Everything is DataFrame operations. Edges: null and empty texts have no licence of
their own; a null path has no directory, so nothing is inherited. Rows are scanned
each for itself; equal texts are looked at once and get equal results. Ties go to the
first template, then the whole text, then the first block; of several licence files
in a directory the best counts, then the first path. A very long text is read whole;
its blocks are as many as its anchors. An empty table gives an empty table; other
columns, whatever their names, are ignored unless they are asked for by `keep`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.storage import Scratch

LEAST = 0.8
WHOLE = 0.9
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
FILE_NAME = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"


@dataclass(frozen=True)
class Template:
    name: str
    text: str
    must: tuple[str, ...]  # its anchor, then terms that tell it from its siblings
    never: tuple[str, ...] = field(default=())  # terms of its siblings


_GPL = ("lesser", "library", "affero")
_OTHER = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
_HEAD = "GNU {0} Version {1} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: The GNU licences: SPDX name, title, version, terms of its own, terms of its siblings.
_GNU = [
    ("GPL-2.0", "General Public License", "2", ("2",), (*_GPL, "3")),
    ("GPL-3.0", "General Public License", "3", ("3",), (*_GPL, "2")),
    ("LGPL-2.1", "Lesser General Public License", "2.1", ("lesser", "2.1"), ("affero",)),
    ("LGPL-3.0", "Lesser General Public License", "3", ("lesser", "3"), ("affero",)),
    ("AGPL-3.0", "Affero General Public License", "3", ("affero", "3"), ("lesser",)),
]
_SPDX = ("Apache-2.0", "MIT", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense")

# Notices, standard headers and texts of common licences, by SPDX name.
TEMPLATES: list[Template] = [
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "2.0")),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ("apache", "2.0")),
    Template("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", ("apache", "2.0")),
    Template("MIT", "Released under the MIT License.", ("license", "mit")),
    Template("MIT", _MIT, ("sublicense",)),
    Template("MIT", f"{_MIT} {_AS_IS}", ("sublicense",)),
    *[Template(n, f"This work is licensed under the GNU {title}, version {v}.", ("gnu", *must), never) for n, title, v, must, never in _GNU],
    *[Template(n, _OTHER.format(title, v), ("gnu", *must), never) for n, title, v, must, never in _GNU],
    *[Template(n, _HEAD.format(title, v), ("gnu", "verbatim", *must), never) for n, title, v, must, never in _GNU],
    Template("BSD-2-Clause", "Released under the BSD 2-Clause License.", ("bsd", "2")),
    Template("BSD-3-Clause", "Released under the BSD 3-Clause License.", ("bsd", "3")),
    Template("BSD-2-Clause", f"{_BSD} {_BSD_END}", ("redistribution",), ("endorse",)),
    Template("BSD-3-Clause", f"{_BSD} {_BSD3} {_BSD_END}", ("redistribution", "endorse")),
    Template("ISC", "Released under the ISC License.", ("license", "isc")),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("permission", "fee")),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla", "2.0")),
    Template("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse", "2.0")),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0.", ("licensed", "cc", "4.0"), ("sa", "nc", "nd")),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("licensed", "cc", "sa", "4.0"), ("nc",)),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("licensed", "cc", "nc", "4.0"), ("sa", "nd")),
    Template("CC0-1.0", "Released into the public domain under CC0 1.0 Universal.", ("cc0",)),
    Template("Unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered",)),
    *[Template(n, f"SPDX-License-Identifier: {n}", ("spdx", *re.findall(TERM, n.lower()))) for n in _SPDX],
]


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def vectors(templates: list[Template]) -> tuple[dict[str, float], float, list[dict[str, float]]]:
    """idf of the templates' terms, idf of any other, and the templates' unit vectors."""
    bags = [Counter(terms(t.text)) for t in templates]
    df = Counter(t for b in bags for t in b)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()}
    out = []
    for b in bags:
        v = {t: n * idf[t] for t, n in b.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / norm for t, x in v.items()})
    return idf, math.log(1 + len(bags)) + 1, out


def places(templates: list[Template]) -> list[tuple[str, int, int, int]]:
    """(anchor, template, offset in its terms, number of its terms) of each occurrence of an anchor in its template."""
    out = []
    for t, template in enumerate(templates):
        all_ = terms(template.text)
        out += [(x, t, i, len(all_)) for i, x in enumerate(all_) if x == template.must[0]]
    return out


def scan(files: DataFrame, templates: list[Template] = TEMPLATES, least: float = LEAST, whole: float = WHOLE, path: str = "path", text: str = "text", keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(keep..., path, license, method, score, licence_path) of each row of files.

    method: own, inherited or none. licence_path: the licence file inherited from.
    """
    spark = files.sparkSession
    scratch = Scratch(spark, "licenses")
    idf, unseen, units = vectors(templates)
    at = places(templates)
    names = sorted({a for a, *_ in at})
    file_key = F.xxhash64(F.col("text"), F.octet_length("text"))
    rows = files.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], F.col(path).alias("path"), F.col(text).alias("text"))

    # a text without an anchor has no block: told by plain search, no expression is matched on it
    roots = [a for a in names if not any(b != a and b in a for b in names)]
    low = rows.select(file_key.alias("file"), F.explode(F.array(F.lower("text"))).alias("low"))
    any_root = F.contains("low", F.lit(roots[0]))
    for r in roots[1:]:
        any_root = any_root | F.contains("low", F.lit(r))
    found = low.where(any_root).select("file", F.regexp_extract_all("low", F.lit(TERM), F.lit(0)).alias("terms"))
    hits = F.filter(F.transform("terms", lambda x, i: F.struct(x.alias("anchor"), i.alias("i"))), lambda h: h["anchor"].isin(names))
    found = found.select("file", "terms", F.explode(F.array(hits)).alias("hits")).where(F.size("hits") > 0)
    # constants of the templates, some hundred entries
    table = F.create_map(*[x for n in names for x in (F.lit(n), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(o).alias("o"), F.lit(k).alias("k")) for a, t, o, k in at if a == n]))])
    every = F.flatten(F.transform("hits", lambda h: F.transform(F.element_at(table, h["anchor"]), lambda p: F.struct(p["t"].alias("t"), F.greatest(h["i"] - p["o"], F.lit(0)).alias("start"), (F.least(h["i"] - p["o"], F.lit(0)) + p["k"]).alias("k")))))
    found = found.select("file", "terms", F.explode(F.array(every)).alias("every"))
    all_ = F.transform(F.array_distinct(F.transform("every", lambda b: b["t"])), lambda t: F.struct(t.alias("t"), F.lit(-1).alias("start"), F.size("terms").alias("k")))
    block = found.select("file", "terms", F.explode(F.concat("every", all_)).alias("b"))
    block = block.select("file", F.col("b.t").alias("t"), F.col("b.start").alias("start"), F.slice("terms", F.greatest(F.col("b.start"), F.lit(0)) + 1, F.col("b.k")).alias("terms"))
    lists = lambda side: F.array(*[F.array(*[F.lit(x) for x in getattr(t, side)]).cast("array<string>") for t in templates])
    must, never = (F.element_at(lists(side), F.col("t") + 1) for side in ("must", "never"))
    block = block.where((F.size(F.array_except(must, "terms")) == 0) & ~F.arrays_overlap(never, "terms"))
    # equal texts have equal blocks, which are one from here on
    tf = block.groupBy("file", "t", "start").agg(F.first("terms").alias("terms")).select("file", "t", "start", F.explode("terms").alias("term"))
    tf = tf.groupBy("file", "t", "start", "term").agg(F.count("*").alias("tf"))
    weights = spark.createDataFrame([(x, i, [v.get(x, 0.0) for v in units]) for x, i in sorted(idf.items())], "term string, idf double, weights array<double>")
    met = tf.join(F.broadcast(weights), "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    dot = F.coalesce(F.sum(F.col("x") * F.element_at("weights", F.col("t") + 1)), F.lit(0.0))
    sums = met.groupBy("file", "t", "start").agg((dot / F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("score"))
    best = sums.select("file", "t", "start", F.round("score", 6).alias("score")).where(F.col("score") >= least)
    best = best.groupBy("file").agg(F.max(F.struct("score", (-F.col("t")).alias("t"), (-F.col("start")).alias("start"))).alias("b"), F.max(F.when(F.col("start") < 0, F.col("score"))).alias("whole"))
    licence = F.element_at(F.array(*[F.lit(x.name) for x in templates]), 1 - F.col("b.t"))
    best = scratch.save(best.select("file", licence.alias("own"), F.col("b.score").alias("score"), F.coalesce("whole", F.lit(0.0)).alias("whole")), "own")

    own = rows.withColumn("file_", file_key).drop("text").join(best, F.col("file_") == F.col("file"), "left").drop("file_", "file")
    own = own.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit("")))
    is_file = F.col("own").isNotNull() & F.col("path").isNotNull() & ((F.col("whole") >= whole) | F.element_at(F.split("path", "/"), -1).rlike(FILE_NAME))
    # the least struct: the best score, then the first path
    licensed = own.where(is_file).groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("path").alias("p"), F.col("own").alias("l"))).alias("from"))
    licensed = scratch.save(licensed, "licensed").withColumnRenamed("dir", "up")
    dirs = own.where("own is null and path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.array_union(F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), F.array(F.lit("")))
    nearest = dirs.select("dir", F.posexplode(above).alias("steps", "up")).join(licensed, "up").groupBy("dir").agg(F.min_by("from", "steps").alias("from"))
    nearest = scratch.save(nearest, "nearest").withColumnRenamed("dir", "dir_")
    out = own.join(nearest, (F.col("dir") == F.col("dir_")) & F.col("own").isNull() & F.col("path").isNotNull(), "left")
    method = F.when(F.col("own").isNotNull(), F.lit("own")).when(F.col("from").isNotNull(), F.lit("inherited")).otherwise(F.lit("none"))
    return out.select(
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)],
        F.col("path"),
        F.coalesce("own", "from.l", F.lit("none")).alias("license"),
        method.alias("method"),
        F.when(F.col("own").isNotNull(), F.col("score")).when(F.col("from").isNotNull(), -F.col("from.s")).otherwise(F.lit(0.0)).alias("score"),
        F.when(F.col("own").isNull(), F.col("from.p")).alias("licence_path"),
    )
