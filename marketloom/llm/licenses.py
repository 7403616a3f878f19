"""Licence scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

A document is cut into windows of twice a template's words, half of it overlapping, so every passage of the template's
length lies in one window whole. Bands have one row each: a window that holds ``CONTAINMENT`` of a template's t shingles
has a Jaccard similarity s of at least c t / (w + t - c t), with w shingles in the window, and meets it in one of b bands
with probability 1 - (1 - s)^b; b is chosen so that this is at least ``SURE`` for every template.

Windows that cannot match are left out before hashing by a rule that loses nothing: for each template some anchor words
are chosen so that more than a fifth of its shingles hold one, so a window that holds four fifths of the shingles holds an
anchor.

Defined cases: null and empty texts and texts of fewer words than a shingle have no window and no match; each row is
scanned by itself, rows of one id give one result per row; a null id stays null; other columns are ignored; templates
shorter than a shingle raise an error; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import staged

SHINGLE, CONTAINMENT, SURE = 5, 0.8, 0.9999
#: Public licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "MIT": "Released under the MIT License",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/"),
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def template_shingles(text: str) -> list[str]:
    w = template_words(text)
    if len(w) < SHINGLE:
        raise ValueError(f"a template needs {SHINGLE} words: {text!r}")
    return sorted({" ".join(w[i: i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)})


def bands(longest: int, shortest: int) -> int:
    """Bands of one row that find a window of ``2 * longest`` words with any template of ``shortest`` words or more."""
    t, w = shortest - SHINGLE + 1, 2 * longest - SHINGLE + 1
    s = CONTAINMENT * t / (w + t - CONTAINMENT * t)
    return math.ceil(math.log(1 - SURE) / math.log(1 - s))


def anchors(templates: dict[str, str]) -> list[str]:
    """Words, long ones first, until more than a fifth of each template's shingles hold one."""
    chosen: list[str] = []
    for text in templates.values():
        shingles = template_shingles(text)
        for word in sorted(set(template_words(text)), key=lambda x: (x not in chosen, -len(x), x)):
            if sum(any(c in s.split() for c in chosen) for s in shingles) > (1 - CONTAINMENT) * len(shingles):
                break
            if word not in chosen:
                chosen.append(word)
    return sorted(chosen)


def classes(templates: dict[str, str]) -> list[dict[str, str]]:
    """Templates of like length, at most twice the shortest's words, share windows."""
    out: list[dict[str, str]] = []
    for name, text in sorted(templates.items(), key=lambda x: (len(template_words(x[1])), x[0])):
        if out and len(template_words(text)) <= 2 * len(template_words(next(iter(out[-1].values())))):
            out[-1][name] = text
        else:
            out.append({name: text})
    return out


def _shingles(words: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")))


def _minima(shingles: Column, n: int) -> Column:
    """(band, smallest hash) for each of n bands."""
    hashed = F.transform(shingles, lambda s: F.xxhash64(s))
    return F.transform(F.array(hashed), lambda h: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct(
        k.alias("band"), F.array_min(F.transform(h, lambda x: F.xxhash64(x, k))).alias("least"))))[0]


def license_matches(documents: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document and template with a window of at least ``CONTAINMENT``: doc_id, template, n_found, n_template, containment, word (of the window)."""
    spark = documents.sparkSession
    anchor = anchors(templates)
    # Word ends as the words below have them: an underscore or a letter beyond a-z ends a word too.
    holds = "(?<![a-z0-9])(?:" + "|".join(anchor) + ")(?![a-z0-9])"
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter(F.lower("text").rlike(holds))
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    docs = staged(docs.select("doc_id", words.alias("w")).withColumn("row", F.monotonically_increasing_id()), "licensed")
    found = []
    for group in classes(templates):
        longest = max(len(template_words(t)) for t in group.values())
        shortest = min(len(template_words(t)) for t in group.values())
        n = bands(longest, shortest)
        # Windows of twice the longest template start at each of its multiples; the last may be short.
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - SHINGLE + 1), F.lit(longest))
        window = docs.filter(F.size("w") >= SHINGLE).select("doc_id", "row", "w", F.explode(starts).alias("word")).select(
            "doc_id", "row", "word", F.slice("w", F.col("word"), 2 * longest).alias("w"))
        window = window.filter((F.size("w") >= SHINGLE) & F.arrays_overlap("w", F.array(*[F.lit(a) for a in anchor])))
        window = staged(window.select("doc_id", "row", "word", _shingles(F.col("w")).alias("s")), "windows")
        # The templates are a parameter held by the driver, and their bands too, so both are small enough to travel; a template
        # that most documents carry is then no key of a shuffle.
        known = spark.createDataFrame([(k, template_shingles(t)) for k, t in group.items()], "template string, t array<string>")
        banded = known.select("template", "t", F.explode(_minima(F.col("t"), n)).alias("m"))
        hits = (
            window.select("row", "word", F.explode(_minima(F.col("s"), n)).alias("m"))
            .join(F.broadcast(banded.select("template", "m")), "m").select("row", "word", "template").distinct())
        exact = hits.join(window, ["row", "word"]).join(F.broadcast(known), "template").select(
            "doc_id", "row", "template", "word", F.size(F.array_intersect("s", "t")).cast("long").alias("n_found"), F.size("t").cast("long").alias("n_template"))
        found.append(exact.filter(F.col("n_found") >= CONTAINMENT * F.col("n_template")))
    best = reduce(DataFrame.union, found).groupBy("doc_id", "row", "template", "n_template").agg(
        F.max("n_found").alias("n_found"), F.min_by("word", F.struct(-F.col("n_found"), "word")).alias("word"))
    return best.select("doc_id", "template", "n_found", "n_template", (F.col("n_found") / F.col("n_template")).alias("containment"), "word")
