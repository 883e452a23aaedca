"""Licence scan with DataFrame functions only.

Texts are read in overlapping windows, one window size for each class of
template sizes (as in a size-partitioned index): templates of up to B shingles
meet windows of 2B shingles that start every B, so each occurrence lies whole
in a window. At a containment of 0.8 a template's Jaccard similarity with that window
is at least 0.8 / 4.2 = 0.19, and each of the 64 bands is one MinHash value, so
a match is retrieved with a probability over 0.999998. Retrieved templates are
verified by the exact containment of their shingles in the window, and told from
their like: for each template of another licence that has half of the shingles, at least half
of those that it lacks must be there (texts of two versions may differ in one word).

Anchors narrow the work without loss: they are words chosen so that in every
template less than a share of 0.8 of the shingles has none of them. A window
that holds 0.8 of a template's shingles therefore has an anchor, and so has the text.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH, CONTAINMENT, BANDS = 5, 0.8, 64

#: (template, licence, text). Text that licences have in common stands for their family.
_TERMS = "you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation"
_LATER = "either version {} of the License, or (at your option) any later version"
_NOTICE = "This work is licensed under the GNU {}General Public License, version {}."
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)
TEMPLATES = (
    ("apache-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-header", "Apache-2.0", _APACHE),
    ("mit-notice", "MIT", "Released under the MIT License."),
    ("mit-permission", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit-warranty", "MIT", _WARRANTY),
    ("isc-permission", "ISC", _ISC),
    ("gpl-terms", "GPL", _TERMS.format("")),
    ("lgpl-terms", "LGPL", _TERMS.format("Lesser ")),
    ("agpl-terms", "AGPL", _TERMS.format("Affero ")),
    ("version-2-or-later", "GNU version 2 or later", _LATER.format("2")),
    ("version-2.1-or-later", "GNU version 2.1 or later", _LATER.format("2.1")),
    ("version-3-or-later", "GNU version 3 or later", _LATER.format("3")),
    ("gpl2-notice", "GPL-2.0", _NOTICE.format("", "2")),
    ("gpl3-notice", "GPL-3.0", _NOTICE.format("", "3")),
    ("lgpl2.1-notice", "LGPL-2.1", _NOTICE.format("Lesser ", "2.1")),
    ("lgpl3-notice", "LGPL-3.0", _NOTICE.format("Lesser ", "3")),
    ("agpl3-notice", "AGPL-3.0", _NOTICE.format("Affero ", "3")),
    ("cc-by-notice", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("bsd-conditions", "BSD", _BSD),
    ("bsd-names", "BSD-3-Clause", _BSD_NAMES),
    ("mpl-notice", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    """Runs of a-z and 0-9 after lower-casing A-Z."""
    return re.findall("[a-z0-9]+", text.translate(str.maketrans(_UPPER, _LOWER)))


def _parts(text: str) -> list[tuple[str, ...]]:
    words = words_of(text)
    return list(dict.fromkeys(tuple(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1)))


def telling_parts(templates: tuple = TEMPLATES) -> list[list[list[str]]]:
    """For each template, and each of another licence that has half of its shingles, the shingles that the other lacks."""
    parts = [set(_parts(text)) for _, _, text in templates]
    out = []
    for (_, licence, _), own in zip(templates, parts):
        rivals = [own - other for (_, name, _), other in zip(templates, parts) if name != licence and 2 * len(own & other) >= len(own)]
        out.append([sorted(" ".join(p) for p in rest) for rest in rivals if rest])
    return out


def size_class(text: str) -> int:
    """The power of two that bounds the template's number of distinct shingles."""
    parts = _parts(text)
    if not parts:
        raise ValueError("a template needs a whole shingle")
    return 1 << (len(parts) - 1).bit_length()


def anchors(templates: tuple = TEMPLATES, least: float = CONTAINMENT) -> list[str]:
    """Words, as few as a greedy choice finds, without which no template can reach ``least``."""
    bare = [_parts(text) for _, _, text in templates]
    chosen: list[str] = []
    while True:
        open_ = [[p for p in parts if not set(p) & set(chosen)] for parts in bare]
        needy = [rest for rest, parts in zip(open_, bare) if len(rest) >= least * len(parts) - 1e-9]
        if not needy:
            return chosen
        gain: dict[str, float] = {}
        for rest in needy:
            for word in {w for p in rest for w in p}:
                gain[word] = gain.get(word, 0) + len(word) * sum(word in p for p in rest) / len(rest)
        chosen.append(max(sorted(gain), key=gain.get))


def _shingles(words):
    """Distinct 64-bit shingle hashes of an array of at least WIDTH words."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - (WIDTH - 1)), lambda i: F.xxhash64(F.array_join(F.slice(words, i, WIDTH), " "))))


def _signature(shingles):
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda band: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, band))))


def template_table(spark: SparkSession, templates: tuple = TEMPLATES) -> DataFrame:
    """(template, license, class, wanted, telling): constant rows, one a template."""
    rows = F.array(*[F.struct(F.lit(a).alias("template"), F.lit(b).alias("license"), F.lit(size_class(text)).alias("class"), F.lit(" ".join(words_of(text))).alias("body"), F.array(*(F.lit("|".join(rest)) for rest in own)).cast("array<string>").alias("own")) for (a, b, text), own in zip(templates, telling_parts(templates))])
    table = spark.range(1).select(F.inline(rows))
    return table.select("template", "license", "class", _shingles(F.split("body", " ")).alias("wanted"), F.transform("own", lambda rest: F.transform(F.split(rest, "\\|"), lambda s: F.xxhash64(s))).alias("telling"))


def scan(docs: DataFrame, templates: tuple = TEMPLATES, least: float = CONTAINMENT) -> DataFrame:
    """One row per doc_id and template found in a text: doc_id, template, license, matched, shingles, first_word.

    ``matched`` is the most of the template's distinct shingles that one window
    holds, ``first_word`` where the first such window starts. Null, empty and
    short texts hold nothing. Rows that repeat a doc_id (or have none) are
    reported together. Extra columns are not carried; an empty table gives an
    empty table.
    """
    marks = anchors(templates, least)
    sizes = sorted({size_class(text) for _, _, text in templates})
    lowered = F.lower("text")
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    likely = numbered.where(reduce(or_, [F.contains(lowered, F.lit(m)) for m in marks]))
    worded = likely.select("row", "doc_id", F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit("([a-z0-9]+)"), 1).alias("words")).where(F.size("words") >= WIDTH)
    sized = worded.select("row", "doc_id", "words", F.explode(F.array(*map(F.lit, sizes))).alias("class"))
    starts = sized.select("row", "doc_id", "words", "class", F.explode(F.sequence(F.lit(0), F.size("words") - WIDTH, F.col("class"))).alias("start"))
    windows = starts.select("row", "doc_id", "class", "start", F.slice("words", F.col("start") + 1, 2 * F.col("class") + (WIDTH - 1)).alias("window"))
    windows = windows.where(F.arrays_overlap("window", F.array(*map(F.lit, marks)))).select("row", "doc_id", "class", "start", _shingles(F.col("window")).alias("shingles"))
    bands = windows.select("row", "doc_id", "class", "start", "shingles", F.posexplode(_signature(F.col("shingles"))).alias("band", "value"))
    known = template_table(docs.sparkSession, templates)
    index = known.select("template", "class", F.posexplode(_signature(F.col("wanted"))).alias("band", "value"))
    met = bands.join(F.broadcast(index), ["class", "band", "value"])  # BANDS rows a template
    pairs = met.groupBy("row", "class", "start", "template").agg(F.first("doc_id").alias("doc_id"), F.first("shingles").alias("shingles"))  # one window of one row
    checked = pairs.join(F.broadcast(known.drop("class")), "template").withColumn("matched", F.size(F.array_intersect("shingles", "wanted")))
    told = F.forall("telling", lambda rest: 2 * F.size(F.array_intersect(F.col("shingles"), rest)) >= F.size(rest))
    found = checked.where((F.col("matched") >= F.lit(least) * F.size("wanted")) & told)
    return found.groupBy("doc_id", "template", "license").agg(F.max("matched").cast(T.LongType()).alias("matched"), F.max(F.size("wanted")).cast(T.LongType()).alias("shingles"), F.min("start").cast(T.LongType()).alias("first_word"))
