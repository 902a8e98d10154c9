"""License scans: sparse TF-IDF cosine of notices to templates, and inheritance along directories.

The *notices* of a file are its lines that hold a word of licensing, and whatever holds such a line: its paragraph (lines
up to one without an ASCII letter or digit, so a bare comment mark parts paragraphs), its block (lines up to a blank one, such
as a comment over the code), and, in a licence file, the whole text. So a header that is wrapped, or a licence text of
several paragraphs, is compared as a whole. Terms are weighed by ``(1 + ln tf) * (1 + ln((1 + N) / (1 + df)))``, where ``N``
and ``df`` count the notices of the whole corpus, and each notice is compared with every template by the cosine; the best one
at ``LEAST`` or above names the notice's license, the alphabetically first of equal ones. A file has the license of its best
notice, again the first of equal ones. A file named as a licence file speaks for its directory (the best of several); a file
without a license of its own inherits from the nearest directory above it that has one.

Scale: equal notices are one row before anything else (a notice repeated in a third of all files is scored once, with
its count as weight) and go by a 128-bit hash of their terms, so that long ones are shuffled once; templates are a few dozen
rows of fixed size, and inheritance is resolved per directory, by joining each directory's path prefixes with the licensed
directories, before files join theirs. What may still be hot (a much used notice or directory joining its files) is one row
on the right of a shuffle join, whose left side adaptive execution splits. Only DataFrame functions run.

Defined results: a null text has no notice. A null path is in no directory: such a file inherits nothing. Repeated
rows give repeated rows. An empty table gives no rows. Texts are whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.storage import write_table

LEAST = 0.6
SIGNAL = r"(?i)\b(licen[cs]\w*|sublicen[cs]\w*|copyright\w*|copyleft|spdx|warrant\w*|redistribut\w*|permission|public domain)\b"
TERM = r"[a-z0-9]+"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.\-_].*)?$"
PARAGRAPH = r"\n[^A-Za-z0-9\n]*\n"
BLOCK = r"\n[ \t\r]*\n"

# Usual header lines and texts of licences, in public use.
GNU = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
    "the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)
DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON "
    "ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
    "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain '
    "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
    'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
    "the specific language governing permissions and limitations under the License."
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
    "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
GPL, LESSER, AFFERO = "General Public License", "Lesser General Public License", "Affero General Public License"
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004", APACHE],
    "MIT": ["Released under the MIT License", "The MIT License (MIT)", "SPDX-License-Identifier: MIT", MIT],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "GNU General Public License Version 3, 29 June 2007",
        GNU.format(what="program", name=GPL, version="3"),
    ],
    "GPL-2.0": [
        "This program is licensed under the GNU General Public License, version 2",
        "GNU General Public License Version 2, June 1991",
        GNU.format(what="program", name=GPL, version="2"),
    ],
    "LGPL-2.1": [
        "GNU Lesser General Public License Version 2.1, February 1999",
        GNU.format(what="library", name=LESSER, version="2.1"),
        GNU.format(what="program", name=LESSER, version="2.1"),
    ],
    "LGPL-3.0": [
        "Licensed under the GNU Lesser General Public License, version 3",
        "GNU Lesser General Public License Version 3, 29 June 2007",
        GNU.format(what="library", name=LESSER, version="3"),
        GNU.format(what="program", name=LESSER, version="3"),
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3",
        "GNU Affero General Public License Version 3, 19 November 2007",
        GNU.format(what="program", name=AFFERO, version="3"),
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License", BSD + BSD_NAMES + DISCLAIMER],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License", BSD + DISCLAIMER],
    "ISC": ["Released under the ISC License", ISC],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["Released into the public domain under CC0 1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", UNLICENSE],
}


def _terms(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(TERM), F.lit(0))


def notices(text: Column, whole: Column) -> Column:
    """The different notices of a text, each as its terms joined by spaces; null for most texts, which one scan spares the splits.

    ``whole`` tells of the texts that are a notice as they stand.
    """
    parts = F.concat(F.split(text, "\n"), F.split(text, PARAGRAPH), F.split(text, BLOCK), F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>")))
    signed = F.array_distinct(F.filter(parts, lambda part: part.rlike(SIGNAL)))
    joined = F.transform(signed, lambda part: F.array_join(F.regexp_extract_all(F.lower(part), F.lit(TERM), F.lit(0)), " "))
    return F.when(text.rlike(SIGNAL), F.array_distinct(joined))


def _key(notice: Column) -> Column:
    """128 bits that stand for a notice."""
    return F.unhex(F.left(F.sha2(notice, 256), F.lit(32)))


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(name, number, line) for name, lines in TEMPLATES.items() for number, line in enumerate(lines)]
    return spark.createDataFrame(rows, "license string, number int, line string")


def _weight(tf: str, df: str, n: str) -> Column:
    return (1 + F.log(F.col(tf))) * (1 + F.log((1 + F.col(n)) / (1 + F.col(df))))


def score_notices(counted: DataFrame) -> DataFrame:
    """``notice, license, similarity`` of different notices ``(notice, terms, n)``, ``notice`` a key; those under ``LEAST`` are left out."""
    spark = counted.sparkSession
    term = counted.select("notice", "n", F.explode(F.split("terms", " ")).alias("term")).groupBy("notice", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))  # one row
    df = term.groupBy("term").agg(F.sum("n").alias("df"))
    weighed = term.join(df, "term").crossJoin(F.broadcast(total)).select("notice", "term", _weight("tf", "df", "total").alias("w"))
    weighed = write_table(weighed, "weights")
    norm = weighed.groupBy("notice").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    lines = _templates(spark).select("license", "number", F.explode(_terms("line")).alias("term")).groupBy("license", "number", "term").agg(F.count(F.lit(1)).alias("tf"))
    known = df.join(F.broadcast(lines.select("term").distinct()), "term")  # at most the templates' terms
    vector = lines.join(F.broadcast(known), "term", "left").fillna(0, ["df"]).crossJoin(F.broadcast(total)).withColumn("t", _weight("tf", "df", "total"))
    length = vector.groupBy("license", "number").agg(F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("length"))
    vector = vector.join(F.broadcast(length), ["license", "number"]).select("license", "number", "term", (F.col("t") / F.col("length")).alias("t"))
    dot = weighed.join(F.broadcast(vector), "term").groupBy("notice", "license", "number").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    cosine = dot.join(norm, "notice").select("notice", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("similarity"))
    best = cosine.groupBy("notice").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("b"))
    return best.select("notice", F.col("b.license").alias("license"), (-F.col("b.s")).alias("similarity")).where(F.col("similarity") >= LEAST)


def folders(path: Column) -> Column:
    """The directories of a path, the nearest last: ``a/b/c.txt`` gives ``a`` and ``a/b``; the root is the empty string, first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def scan(files: DataFrame) -> DataFrame:
    """``files`` are ``(doc_id, path, text)``. One row per file: ``doc_id, path, license, similarity, origin``.

    ``origin`` is ``header`` (own notice), ``directory`` (inherited) or null (no license known).
    """
    keyed = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("_t"))
    named = F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE)
    base = keyed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "path", notices(F.col("_t"), F.coalesce(named, F.lit(False))).alias("notices"))
    base = write_table(base, "notices")  # texts are read once: from here on there are only paths and notices
    terms = base.select("row", F.explode("notices").alias("terms")).where("terms != ''").withColumn("notice", _key(F.col("terms")))
    each = terms.select("row", "notice")
    counted = write_table(terms.groupBy("notice").agg(F.first("terms").alias("terms"), F.count(F.lit(1)).alias("n")), "counted")
    scored = write_table(score_notices(counted), "scored")
    own = each.join(scored, "notice").groupBy("row").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("b"))
    own = own.select("row", F.col("b.license").alias("own"), (-F.col("b.s")).alias("similarity"))
    rows = write_table(base.drop("notices").join(own, "row", "left").withColumn("folder", F.element_at(folders(F.col("path")), -1)), "owned")
    licensed = rows.where(named & F.col("own").isNotNull()).groupBy("folder").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("own").alias("l"))).alias("b"))
    licensed = licensed.select(F.col("folder").alias("above"), F.col("b.l").alias("inherited"))
    steps = rows.where("own is null and folder is not null").select("folder").distinct()
    steps = steps.select("folder", F.posexplode(folders(F.concat("folder", F.lit("/x")))).alias("depth", "above"))
    steps = steps.where((F.col("folder") != "") | (F.col("depth") == 0))
    nearest = steps.join(licensed, "above").groupBy("folder").agg(F.max(F.struct("depth", "inherited")).alias("b")).select("folder", F.col("b.inherited").alias("inherited"))
    return rows.join(nearest, "folder", "left").select(
        "doc_id",
        "path",
        F.coalesce("own", "inherited").alias("license"),
        "similarity",
        F.when(F.col("own").isNotNull(), "header").when(F.col("inherited").isNotNull(), "directory").alias("origin"),
    )
