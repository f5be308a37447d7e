"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

DataFrame functions only. Templates are grouped by length class L (8, 16, 32, ... words); the windows of a class are
2 L words long and begin every L words, so a notice of up to L words lies wholly inside one. Window and template are
sets of five-word shingles. A window's MinHash signature has one row a band; a template with a containment of at least
``CONTAINMENT`` then has a Jaccard similarity of at least J with the window, J following from the class, and the number
of bands is chosen so that (1 - J) ^ bands is at most ``MISS``. Templates met in a band are verified by the exact share
of their shingles in the window.

Only windows that hold at least one template shingle are hashed (others cannot contain a template); that test is a set
lookup on word pairs and then on shingles, bounded by the templates as is the broadcast table of their bands.

Defined results: null, empty and wordless texts match nothing; of several windows a template's best one counts, the
first among equals; repeated rows report their own matches; templates of under five words and more than
``MAX_TEMPLATES`` of them are refused.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.llm.common import plan_row, table
from strophe.llm.decontaminate import words

SHINGLE = 5
CONTAINMENT = 0.8
#: Templates at most, as their shingles travel with the plan.
MAX_TEMPLATES = 1000
#: Chance that a matching window shares no band with its template.
MISS = 1e-4

# Customary notices of public licenses.
TEMPLATES = [
    ("mit-notice", "MIT", "Released under the MIT License."),
    ("mit-notice-2", "MIT", "This project is licensed under the MIT License"),
    ("mit-grant", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-header", "Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-notice", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2-notice", "GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-header", "GPL", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-header", "LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-header", "AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("bsd-grant", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc-grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-header", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("epl-notice", "EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("cc0-notice", "CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("zlib-grant", "Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain."),
]

# Whole texts of short public licenses, without their copyright lines.
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software"
    " without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
    " persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies"
    " or substantial portions of the Software."
)
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR"
    " PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
    " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials"
    " provided with the distribution."
)
_BSD_3 = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior"
    " written permission."
)
_BSD_AS_IS = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF"
    " MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS"
    " INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE"
    " USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this"
    " permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES"
    " OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS"
    " OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
    " Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following"
    " restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an"
    " acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented"
    " as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
    " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,"
    " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
TEMPLATES += [
    ("mit-text", "MIT", f"{_GRANT} {_AS_IS}"),
    ("bsd-2-text", "BSD-2-Clause", _BSD + _BSD_AS_IS),
    ("bsd-3-text", "BSD-3-Clause", _BSD + _BSD_3 + _BSD_AS_IS),
    ("isc-text", "ISC", _ISC),
    ("zlib-text", "Zlib", _ZLIB),
    ("apache-text", "Apache-2.0", _APACHE),
]


#: Notices that differ in their version only, and what is left of the license where the version does not fit.
VERSIONS = {"gpl-notice": "GPL", "gpl-2-notice": "GPL", "bsd-2-text": "BSD", "bsd-3-text": "BSD"}


def templates(spark: SparkSession) -> DataFrame:
    """(template_id, license, text) of the notices above."""
    values = ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in t)) for t in TEMPLATES)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(template_id, license, text)")


def class_of(n_words: int) -> int:
    """Length class of a template."""
    return max(8, 1 << max(n_words - 1, 1).bit_length())


def bands_of(size: int, shingles: int) -> int:
    """Bands for the shortest template of a class: the least J decides."""
    most = 2 * size - SHINGLE + 1
    inside = math.ceil(CONTAINMENT * shingles)
    j = inside / (most + shingles - inside)
    return math.ceil(math.log(MISS) / math.log(1 - j)) if j < 1 else 1


def _shingles(array: str, first: str, last: str) -> str:
    return f"array_distinct(transform(sequence({first}, {last}), i -> xxhash64(slice({array}, i, {SHINGLE}))))"


def _signature(shingles: str, n: str) -> str:
    return f"transform(sequence(1, {n}), j -> array_min(transform({shingles}, x -> xxhash64(x, j))))"


def scan(docs: DataFrame, templates_: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc_id, rid, template_id, license, containment, first_word) for each template in a text; words count from 1."""
    t = templates_.select("template_id", "license", words(F.col("text")).alias("w"))
    known = t.limit(MAX_TEMPLATES + 1).collect()
    if len(known) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    if short := [r["template_id"] for r in known if len(r["w"]) < SHINGLE]:
        raise ValueError(f"templates of under {SHINGLE} words: {short}")
    sizes: dict[int, int] = {}
    for r in known:
        size, n = class_of(len(r["w"])), len(r["w"]) - SHINGLE + 1
        sizes[size] = min(sizes.get(size, n), n)
    bands = {size: bands_of(size, n) for size, n in sizes.items()}
    band = "CASE size " + " ".join(f"WHEN {s} THEN {b}" for s, b in bands.items()) + " END"
    size = "CASE " + " ".join(f"WHEN size(w) <= {s} THEN {s}" for s in sorted(sizes)) + " END"
    t = t.withColumn("size", F.expr(size)).withColumn("ts", F.expr(_shingles("w", "1", f"size(w) - {SHINGLE - 1}")))
    lookup = t.select("template_id", "license", "size", "ts", F.posexplode(F.expr(_signature("ts", band))).alias("band", "h"))

    heads = sorted({" ".join(r["w"][i : i + 2]) for r in known for i in range(len(r["w"]) - SHINGLE + 1)})
    grams = sorted({" ".join(r["w"][i : i + SHINGLE]) for r in known for i in range(len(r["w"]) - SHINGLE + 1)})
    quoted = lambda xs: ",".join(f"'{x}'" for x in xs)  # noqa: E731  words hold no quotes
    hits = F.expr(
        f"CASE WHEN size(w) >= {SHINGLE} THEN filter(sequence(1, size(w) - {SHINGLE - 1}), i -> concat(element_at(w, i), ' ', element_at(w, i + 1)) IN ({quoted(heads)})"
        f" AND array_join(slice(w, i, {SHINGLE}), ' ') IN ({quoted(grams)})) ELSE array() END"
    )
    found = docs.select(plan_row().alias("rid"), F.col(doc).alias("doc_id"), words(F.col(text)).alias("w")).withColumn("hits", hits).filter(F.size("hits") > 0)
    classes = F.explode(F.array(*[F.lit(s) for s in sorted(sizes)]))
    # The two windows of a class that hold a hit: the one that begins in its stretch of L words, and the one before.
    touched = F.expr("array_distinct(flatten(transform(hits, p -> array((p - 1) DIV size, greatest((p - 1) DIV size - 1, 0)))))")
    cut = found.select("rid", "doc_id", "w", "hits", classes.alias("size")).withColumn(
        "windows",
        F.transform(touched, lambda i: F.struct((i * F.col("size") + 1).alias("first"), F.slice("w", (i * F.col("size") + 1).cast("int"), 2 * F.col("size")).alias("v"))),
    )
    windows = (
        cut.select("rid", "doc_id", "size", F.explode("windows").alias("x"))
        .filter(F.size("x.v") >= SHINGLE)
        .select("rid", "doc_id", "size", "x.first", F.expr(_shingles("x.v", "1", f"size(x.v) - {SHINGLE - 1}")).alias("ws"))
    )
    probes = windows.select("rid", "doc_id", "size", "first", "ws", F.posexplode(F.expr(_signature("ws", band))).alias("band", "h"))
    inside = F.size(F.array_intersect("ts", "ws")) / F.size("ts")
    verified = probes.join(F.broadcast(lookup), ["size", "band", "h"]).withColumn("containment", inside).filter(F.col("containment") >= CONTAINMENT)
    best = verified.groupBy("rid", "doc_id", "template_id", "license").agg(F.max(F.struct("containment", (-F.col("first")).alias("at"))).alias("best"))
    return best.select("rid", "doc_id", "template_id", "license", F.col("best.containment").alias("containment"), (-F.col("best.at")).cast("long").alias("first_word"))


def with_versions(found: DataFrame) -> DataFrame:
    """Matches with a version in ``license`` only where it fits: of VERSIONS in one place, the one with the most shingles."""
    family = F.expr("CASE template_id " + " ".join(f"WHEN '{t}' THEN '{f}'" for t, f in VERSIONS.items()) + " END")
    here = Window.partitionBy("rid", "first_word", "_family")
    rows = found.withColumn("_family", family).withColumn("_most", F.max("containment").over(here))
    rows = rows.withColumn("_ties", F.sum((F.col("containment") == F.col("_most")).cast("int")).over(here))
    fits = (F.col("containment") == 1) | (F.col("containment") == F.col("_most")) & (F.col("_ties") == 1)
    return rows.withColumn("license", F.when(F.col("_family").isNull() | fits, F.col("license")).otherwise(F.col("_family"))).drop("_family", "_most", "_ties")


def query(spark, sf_dir: str) -> DataFrame:
    return with_versions(scan(table(spark, sf_dir, "documents", "doc_id", "text"), templates(spark))).drop("rid")
