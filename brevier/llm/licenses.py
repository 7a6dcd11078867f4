"""Licence scan: lines and whole texts against licence templates by the Dice coefficient over word bigrams.

The Dice coefficient of two sets is at most 2 min / (a + b), so that a unit can only reach the threshold with
templates whose number of bigrams lies within fixed bounds of its own; units within no template's bounds are
pruned by their number of words, before bigrams are listed. The others' bigrams meet the templates' in a broadcast join, whose
size is fixed by the template table, and only shared bigrams are counted.

Passages are found wherever they stand in a text, over line ends and amid other words. A passage can only reach the
threshold if the whole text shares threshold / (2 - threshold) of the template's bigrams, which few texts do; in
those every run of words that starts and ends with a shared bigram, and is short enough, is scored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices and texts of well-known licences.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "Proprietary": ["All rights reserved."],
}


def bigrams_of(words: Column) -> Column:
    """Hashes of the word bigrams, repeats included, of an array of at least two words."""
    rest = F.size(words) - 1
    return F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: F.xxhash64(a, b))


def normal_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def template_rows(templates: dict[str, list[str]]) -> list[tuple[str, int, str]]:
    return [(name, k, text) for name, texts in templates.items() for k, text in enumerate(texts)]


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and greatest number of bigrams that can reach the threshold with so many."""
    share = threshold / (2 - threshold)
    return math.ceil(size * share - 1e-9), math.floor(size / share + 1e-9)


def n_bigrams(text: str) -> int:
    words = re.findall(r"[^\W_]+", text.lower())
    return len(words) - 1


def passages(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(doc_id, license_id, dice): the best passage of each text for each licence, where it reaches the threshold.

    A place counts in a passage unless the template's number of its bigram is already met since the passage's
    start: unless `full`, the place of that many equal bigrams before, lies in it.
    """
    share = threshold / (2 - threshold)
    met = (
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), normal_words(F.col(text_col)).alias("words"))
        .where(F.size("words") > 1)
        .select("row", "doc_id", F.posexplode(bigrams_of(F.col("words"))).alias("at", "gram"))
        .join(F.broadcast(known), "gram")
        .groupBy("row", "doc_id", "license_id", "template", "m", "theirs", "gram")
        .agg(F.sort_array(F.collect_set("at")).alias("places"))
    )
    likely = (
        met.withColumn("marks", F.expr("transform(places, (x, i) -> struct(x as at, get(places, i - int(theirs)) as full))"))
        .groupBy("row", "doc_id", "license_id", "template", "m")
        .agg(F.sum(F.least(F.size("places"), F.col("theirs"))).alias("both"), F.sort_array(F.flatten(F.collect_list("marks"))).alias("marks"))
        .where(F.col("both") >= F.col("m") * share - 1e-9)
        .withColumn("longest", F.floor(F.col("m") / share + 1e-9).cast("int"))
    )
    best = F.expr(
        """array_max(transform(marks, (s, i) -> aggregate(
             filter(slice(marks, i + 1, longest), x -> x.at < s.at + longest and (x.full is null or x.full < s.at)),
             named_struct('both', 0D, 'dice', 0D),
             (a, x) -> named_struct('both', a.both + 1D,
                                    'dice', greatest(a.dice, 2D * (a.both + 1D) / (x.at - s.at + 1 + m))),
             a -> a.dice)))"""
    )
    return likely.select("doc_id", "license_id", best.alias("dice")).where(F.col("dice") >= threshold)


def license_matches(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, list[str]] | None = None,
    threshold: float = 0.8,
) -> DataFrame:
    """(doc_id, license_id, n_units, dice): licences found in a document, with the number of units and the best score.

    A unit is a line, or the whole text where it has several lines. A passage of the text, which can cross lines
    or be a part of one, also counts for the score, and is the one unit where no line or whole text matches. Null and
    empty texts match nothing. Rows are judged one by one; those with one id, null too, are one document in the result,
    whose units are those of all its rows, exact repeats of a row included.
    """
    spark: SparkSession = docs.sparkSession
    listed = template_rows(TEMPLATES if templates is None else templates)
    sizes = sorted({n for r in listed for a, b in [size_bounds(n_bigrams(r[2]), threshold)] for n in range(a, b + 1)})
    known = (
        spark.createDataFrame(listed, "license_id string, template int, body string")
        .withColumn("words", normal_words(F.col("body")))
        .where(F.size("words") > 1)
        .select("license_id", "template", (F.size("words") - 1).alias("m"), F.explode(bigrams_of(F.col("words"))).alias("gram"))
        .groupBy("license_id", "template", "m", "gram")
        .agg(F.count("*").alias("theirs"))
    )
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lines = rows.select("row", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("unit", "body"))
    whole = rows.where(F.col("text").contains("\n")).select("row", "doc_id", F.lit(-1).alias("unit"), F.col("text").alias("body"))
    share = threshold / (2 - threshold)
    shared = (
        lines.unionByName(whole)
        .withColumn("words", normal_words(F.col("body")))
        .withColumn("n", F.size("words") - 1)
        .where(F.col("n").isin([x for x in sizes if x > 0]))
        .select("row", "doc_id", "unit", "n", F.explode(bigrams_of(F.col("words"))).alias("gram"))
        .join(F.broadcast(known), "gram")
        .where((F.col("n") >= F.ceil(F.col("m") * share - 1e-9)) & (F.col("n") <= F.floor(F.col("m") / share + 1e-9)))
        .groupBy("row", "doc_id", "unit", "license_id", "template", "n", "m", "gram")
        .agg(F.least(F.count("*"), F.max("theirs")).alias("both"))
        .groupBy("row", "doc_id", "unit", "license_id", "template", "n", "m")
        .agg(F.sum("both").alias("both"))
    )
    units = (
        shared.withColumn("dice", 2 * F.col("both") / (F.col("n") + F.col("m")))
        .where(F.col("dice") >= threshold)
        .select("doc_id", "license_id", F.struct("row", "unit").alias("unit"), "dice")
    )
    inner = passages(docs, known, id_col, text_col, threshold).select("doc_id", "license_id", F.lit(None).cast("struct<row: bigint, unit: int>").alias("unit"), "dice")
    return (
        units.unionByName(inner)
        .groupBy("doc_id", "license_id")
        .agg(
            F.greatest(F.countDistinct("unit"), F.lit(1).cast("long")).alias("n_units"),
            F.round(F.max("dice"), 6).alias("dice"),
        )
    )
