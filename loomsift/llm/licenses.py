"""License scans by diagonal voting.

Every rolling word 3-gram of every text is joined, by hash, with the 3-grams of the license
templates. The template side has a fixed size (some 1,500 rows of this module), so the join
is a broadcast one in the stage that reads the text: neither texts nor n-grams are shuffled,
only hits and one row per document are. A hit keeps its words and is checked against the
template's own. Hits vote for their offset diagonal, text position less template position.
A word put in moves what follows to the next higher diagonal, a word left out to the next
lower one; so diagonals close to each other are merged in the order of the text, as long as the
template goes on, and a span is verified by the share of the template's words that its hits cover.

Base phrases are templates that must stand whole; those of two words have a 2-gram of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsift.llm.frames import slices
from loomsift.scratch import materialise

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Texts and notices of well-known licences that the method adds, with its labels.
TEMPLATES = {
    "apache": (
        "licensed under the apache license version 2 0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
        and limitations under the License.""",
    ),
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "gpl-notice": (
        "licensed under the gnu general public license version",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the
        hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with
        this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
        met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
        HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
        LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
        THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    "isc": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
        LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    ),
    "zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
        product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    ),
    "boost": (
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
        covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare
        derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
        The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following
        disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such
        copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    ),
    "unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in
        the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
        successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
        software under copyright law.""",
    ),
    "mpl": (
        "subject to the terms of the mozilla public license",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    "cc-notice": ("licensed under cc by", "this work is licensed under a creative commons attribution 4 0 international license"),
    "proprietary": ("unauthorized copying of this file via any medium is strictly prohibited",),
}
GRAM = 3
#: Diagonals at most this far apart belong to one span.
NEAR = 3
#: Least share of a template's words that the hits of a verified span cover.
LEAST_COVER = 0.6
#: Words that they cover at least, all of a shorter template.
LEAST_WORDS = 5

_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()} | dict(zip(_UPPER, _LOWER)))


def template_words(text: str) -> list[str]:
    """Runs of digits, letters and characters above ASCII, ``A-Z`` as lower case."""
    return [w for w in text.translate(_PARTS).split(" ") if w]


def _hash(*words: Column) -> Column:
    return F.xxhash64(*[F.lower(w) for w in words])


class Wordings:
    """Numbered wordings: (label, is_base, words)."""

    def __init__(self, base: dict[str, str] = BASE, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        said = [(p, label, True) for p, label in base.items()] + [(p, label, False) for label, ps in templates.items() for p in ps]
        self.all = [(label, is_base, template_words(p)) for p, label, is_base in said]
        if any(len(words) < (2 if is_base else GRAM) for _, is_base, words in self.all):
            raise ValueError(f"a base phrase needs two words, a template {GRAM}")

    def grams(self, spark: SparkSession, size: int) -> DataFrame:
        """(template, at, w0, w1, ..., h): the rolling word n-grams of one size; those of 2 are phrases of two words."""
        rows = [
            (number, at, *words[at : at + size])
            for number, (_, _, words) in enumerate(self.all)
            for at in range(len(words) - size + 1)
            if size == GRAM or len(words) == size
        ]
        names = [f"w{i}" for i in range(size)]
        made = spark.createDataFrame(rows, ", ".join(["template int", "at int", *[f"{n} string" for n in names]]))
        return made.withColumn("h", _hash(*map(F.col, names)))


def hits(docs: DataFrame, wordings: Wordings) -> DataFrame:
    """(row_id, doc_id, n_words, pos, template, at): n-gram hits, and a row without a template per document."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.split(F.coalesce("text", F.lit("")), _SEPARATOR).alias("words"))
    lead = F.when(F.col("words")[0] == "", 1).otherwise(0)
    trail = F.when((F.size("words") > 1) & (F.element_at("words", -1) == ""), 1).otherwise(0)
    rows = rows.select("row_id", "doc_id", "words", lead.alias("lead"), (F.size("words") - lead - trail).alias("n_words"))
    each = rows.select("row_id", "doc_id", "words", "lead", "n_words", F.posexplode("words").alias("pos", "a"))
    each = each.withColumn("b", F.get("words", F.col("pos") + 1)).withColumn("c", F.get("words", F.col("pos") + 2))
    said = [F.col(x) for x in "abc"]
    grams = wordings.grams(spark, GRAM)
    found = each.withColumn("h", F.when(F.col("c").isNotNull(), _hash(*said))).join(F.broadcast(grams), "h", "left")
    same = F.col("template").isNotNull()
    for i, word in enumerate(said):
        same = same & (F.translate(word, _UPPER, _LOWER) == F.col(f"w{i}"))
    found = found.withColumn("template", F.when(same, F.col("template")))
    pairs = [(number, words) for number, (_, _, words) in enumerate(wordings.all) if len(words) == 2]
    pair = F.lit(None).cast("int")  # a phrase of two words that stands here
    for number, words in pairs:
        pair = F.when((F.translate("a", _UPPER, _LOWER) == words[0]) & (F.translate("b", _UPPER, _LOWER) == words[1]), number).otherwise(pair)
    starts = F.lower("a").isin([words[0] for _, words in pairs]) if pairs else F.lit(False)
    found = found.withColumn("pair", F.when(starts, pair))
    found = found.where("template is not null or pair is not null or pos = 0")
    return found.select("row_id", "doc_id", "n_words", (F.col("pos") - F.col("lead")).alias("pos"), "template", "at", "pair")


def merged(runs: list[tuple[int, list[int]]], n: int) -> list[tuple[int, int, float]]:
    """(start, end, share of words) of the verified spans of a template of ``n`` words, from the template positions that hit on each diagonal."""
    chains: list[dict] = []
    latest: dict[int, dict] = {}  # by the diagonal that a chain has reached
    for diagonal, ats in sorted(runs, key=lambda x: (x[0] + min(x[1]), x[0])):
        low, high = min(ats), max(ats)
        near = [c for d in range(diagonal - NEAR, diagonal + NEAR + 1) if (c := latest.get(d)) and c["diagonal"] == d and low > c["high"]]
        chain = max(near, key=lambda c: (len(c["words"]), -abs(c["diagonal"] - diagonal), -c["start"]), default=None)
        if chain is None:
            chain = {"start": diagonal + low, "words": set()}
            chains.append(chain)
        chain |= {"diagonal": diagonal, "high": high, "end": diagonal + high + GRAM}
        chain["words"].update(a + i for a in ats for i in range(GRAM))
        latest[diagonal] = chain
    return [(c["start"], c["end"], len(c["words"]) / n) for c in chains if len(c["words"]) >= max(LEAST_COVER * n, min(LEAST_WORDS, n))]


_SPAN = "row_id long, label string, is_base boolean, start long, end long, cover double"


def spans(found: DataFrame, wordings: Wordings) -> DataFrame:
    """(row_id, label, is_base, start, end, cover): verified spans in words, end exclusive; a base phrase's is each whole place of its own."""
    pairs = found.where("pair is not null").select("row_id", F.col("pair").alias("template"), F.col("pos").alias("diagonal"), F.lit(0).alias("at")).distinct()
    voted = found.where("template is not null").select("row_id", "template", (F.col("pos") - F.col("at")).alias("diagonal"), "at").unionByName(pairs)
    votes = voted.groupBy("row_id", "template", "diagonal").agg(F.collect_set("at").alias("ats"))  # a template's length at most
    by_row = votes.groupBy("row_id").agg(F.collect_list(F.struct("template", "diagonal", "ats")).alias("votes"))  # of one document
    said, names = wordings.all, [x.split()[0] for x in _SPAN.split(", ")]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for row_id, cast in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                runs: dict[int, list] = {}
                for x in cast:
                    runs.setdefault(x["template"], []).append((x["diagonal"], x["ats"]))
                for template, each in runs.items():
                    label, is_base, words = said[template]
                    if is_base:
                        whole = max(1, len(words) - GRAM + 1)
                        out += [(row_id, label, True, d, d + len(words), 1.0) for d, ats in each if len(ats) == whole]
                    else:
                        out += [(row_id, label, False, *x) for x in merged(each, len(words))]
            types = (pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, types)], names=names)

    return by_row.mapInArrow(verify, _SPAN)


def licenses(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of digits, letters and other characters above ASCII, ``A-Z`` taken as lower
    case, numbered from 0. n_base counts the places where a base phrase stands, first_word and
    last_word are their smallest and largest start, null without any. score is the largest
    share of a wording's words found in one span, 1 for a base phrase, 0 without any. A wording of
    fewer than LEAST_WORDS + GRAM words may have to stand whole, as what a word put in or left
    out leaves of it can be too short. A null or empty text has no words and no labels. Rows
    repeated whole stay repeated. An empty table gives no rows; other columns of ``docs`` are not read.
    """
    wordings = Wordings(base, templates)
    found = materialise(hits(docs, wordings), "hits")
    per_row = spans(found, wordings).groupBy("row_id").agg(
        F.count_if("is_base").alias("n_base"), F.min(F.when(F.col("is_base"), F.col("start"))).alias("first_word"), F.max(F.when(F.col("is_base"), F.col("start"))).alias("last_word"),
        F.collect_set(F.when(F.col("is_base"), F.col("label"))).alias("base_labels"), F.collect_set("label").alias("labels"), F.max("cover").alias("score"),
    )
    heads = found.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"))
    joined = heads.join(per_row, "row_id", "left")
    text = lambda c: F.coalesce(F.array_join(F.sort_array(c), ","), F.lit("")).alias(c)
    return joined.select(
        "doc_id", F.greatest("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        text("base_labels"), text("labels"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
    )
