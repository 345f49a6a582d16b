"""Licence scan: normalised text compared with licence templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound, saved

THRESHOLD = 0.8
#: Most templates that are written into a job as literals.
MAX_TEMPLATES = 1000

# Wordings of public licences and of the notices that point to them, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3.0."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS "
        "FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS "
        "PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
        "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
        "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, "
        "OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
        "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
        "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would "
        "be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public "
        "License for more details.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public "
        "License for more details.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author "
        "or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
        "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
        "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        "under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
)


def words(text: Column) -> Column:
    """Normalised text as words: a-z and 0-9 after lower-casing A-Z, all else between words. No text, no words."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), 0)


def bigrams(found: Column) -> Column:
    """Distinct pairs of neighbouring words; none where there are fewer than two words."""
    pairs = lambda said: F.transform(F.slice(said, 1, F.greatest(F.size(said) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(said, i + 1)))
    return F.array_distinct(bound(found, pairs))


def templates(spark: SparkSession, given=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """size (bigrams of a unit) and candidates: the templates (number, licence, bigrams) that a unit of that size can match.

    Dice is 2 c / (a + b) with c <= min(a, b), so only sizes from t b / (2 - t) to (2 - t) b / t can reach t.
    """
    if len(given) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates: scan with a part of them at a time")
    rows = spark.createDataFrame([(i, licence, text) for i, (licence, text) in enumerate(given)], "template int, licence string, text string")
    known = rows.withColumn("bigrams", bigrams(words(F.col("text")))).withColumn("n", F.size("bigrams")).where("n > 0")
    low = F.greatest(F.lit(1), F.ceil(threshold * F.col("n") / (2 - threshold) - 1e-9)).cast("int")
    high = F.floor((2 - threshold) * F.col("n") / threshold + 1e-9).cast("int")
    sized = known.select(F.explode(F.sequence(low, high)).alias("size"), F.struct("template", "licence", "bigrams").alias("t"))
    return sized.groupBy("size").agg(F.sort_array(F.collect_list("t")).alias("candidates"))


def anchors(given=TEMPLATES, threshold: float = THRESHOLD) -> tuple[dict[str, list[tuple[int, int, int, int]]], list[str]]:
    """Bigrams to look for in running text: for each, the places (template, words before it, words of the template, how often it is there) it has in templates; and the longer words of all.

    A text that reaches the threshold t has t b / (2 - t) of a template's b bigrams at least, so of any set of one bigram more than
    may be missing it has one for certain. Taken are those whose longer word is the longest: such words are rare in other texts.
    """
    said = [re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) for _, text in given]
    common = Counter(p for found in said for p in set(zip(found, found[1:])))
    rare = lambda p: max(p.split(), key=lambda x: (len(x), x))
    found: dict[str, list[tuple[int, int, int, int]]] = {}
    for t, w in enumerate(said):
        pairs = [f"{a} {b}" for a, b in zip(w, w[1:])]
        different = sorted(set(pairs), key=lambda p: (-len(rare(p)), -common[tuple(p.split())], p))
        missing = len(different) - math.ceil(threshold * len(different) / (2 - threshold) - 1e-9)
        for pair in different[: missing + 1]:
            found.setdefault(pair, []).extend((t, i, len(w), pairs.count(pair)) for i, p in enumerate(pairs) if p == pair)
    return found, sorted({rare(p) for p in found})


def windows(found: Column, given=TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """Runs of words (from, to and words) that may match a template: as long as it, laid so that an anchor in the text lies on its place in the
    template; and from the first anchor to the last of those that follow each other as in the template, with and without the words before and after them there.
    """
    return bound(found, lambda said: _windows(said, given, threshold))


def _stretches(found: Column, laid: Column, pairs: Column) -> Column:
    """from and to of stretches of anchors laid (t, i: place in the text, q: place in the template, m: its words), sorted; pairs: the bigrams of each template.

    A stretch goes on while places in the template go up and less than a template's length lies between. Words that were put in or left out
    between its ends don't move these, as they do with a window of just the template's length. Before the first anchor and after the
    last there may be the words that the template has there, or from the farthest bigram of the template, or none.
    """
    last = F.size(laid) - 1
    parted = lambda a, b: (a.t != b.t) | (b.i - a.i > b.m) | (b.q <= a.q)
    every = F.filter(F.sequence(F.lit(0), last), lambda k: last >= 0)
    begins = F.filter(every, lambda k: (k == 0) | parted(F.get(laid, k - 1), F.get(laid, k)))
    ends = F.filter(every, lambda k: (k == last) | parted(F.get(laid, k), F.get(laid, k + 1)))
    whole = F.transform(begins, lambda k, j: F.struct(F.get(laid, k).alias("a"), F.get(laid, F.get(ends, j)).alias("b")))
    # Half as many words again may have been put in.
    reach = lambda n: F.floor(n * 1.5).cast("int") + 1

    def far(t: Column, a: Column, b: Column) -> Column:
        return bound(F.try_element_at(pairs, t), lambda own: F.filter(F.sequence(F.greatest(a, F.lit(0)), F.least(b, F.size(found) - 2)), lambda i: F.array_contains(own, F.concat_ws(" ", F.get(found, i), F.get(found, i + 1)))))

    def sides(s: Column) -> Column:
        before = F.array(s.a.i - s.a.q, s.a.i, F.array_min(far(s.a.t, s.a.i - reach(s.a.q), s.a.i)))
        after = F.array(s.b.i - s.b.q + s.b.m, s.b.i + 2, F.array_max(far(s.b.t, s.b.i, s.b.i + reach(s.b.m - s.b.q))) + 2)
        part = lambda a, b: F.struct(F.greatest(a, F.lit(0)).alias("from"), F.least(b, F.size(found)).alias("to"))
        return F.flatten(F.transform(before, lambda a: F.transform(after, lambda b: part(a, b))))

    return F.flatten(F.transform(F.filter(whole, lambda s: s.a.i < s.b.i), sides))


def _windows(found: Column, given, threshold: float) -> Column:
    known, rare = anchors(given, threshold)
    none = F.array().cast("array<struct<from:int,to:int,words:array<string>>>")
    if not known:
        return none
    pair = lambda i: F.concat_ws(" ", F.get(found, i), F.get(found, i + 1))
    # Literals in SQL: of anchors and templates there are thousands, with letters, digits and blanks only.
    entries = ", ".join(f"'{p}', array({', '.join('named_struct(' + ', '.join(f"'{n}', {v}" for n, v in zip('tqmn', place, strict=True)) + ')' for place in at)})" for p, at in known.items())
    places = F.expr(f"map({entries})")
    said = [re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) for _, text in given]
    pairs = F.expr("map(" + ", ".join(f"{t}, split('{','.join(f'{a} {b}' for a, b in sorted(set(zip(w, w[1:]))))}', ',')" for t, w in enumerate(said)) + ")")
    hits = F.filter(F.sequence(F.lit(0), F.size(found) - 2), lambda i: pair(i).isin(*known))
    laid = F.array_sort(F.flatten(F.transform(hits, lambda i: F.transform(F.try_element_at(places, pair(i)), lambda p: F.struct(p.t.alias("t"), i.alias("i"), p.q.alias("q"), p.m.alias("m"), p.n.alias("n"))))))

    def cut(laid: Column) -> Column:
        exact = F.transform(laid, lambda p: F.struct(F.greatest(p.i - p.q, F.lit(0)).alias("from"), F.least(p.i - p.q + p.m, F.size(found)).alias("to")))
        return F.transform(F.array_distinct(F.concat(exact, _stretches(found, F.filter(laid, lambda p: p.n == 1), pairs))), lambda r: F.struct(r["from"].alias("from"), r["to"].alias("to"), F.slice(found, r["from"] + 1, r["to"] - r["from"]).alias("words")))

    # Most texts have no word of any anchor, and end here.
    return F.when((F.size(found) >= 2) & F.arrays_overlap(found, F.array(*map(F.lit, rare))), bound(laid, cut)).otherwise(none)


def units(documents: DataFrame, given=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, line and words of all units of texts that may hold a template: lines (from 0), whole texts of several lines (-1), their paragraphs of several
    lines (-2, numbered in part), and windows (-3, with at: the places from and to in the text's words, and the first and last line and paragraph).

    Lines are what licence notices stand on; longer licence texts are paragraphs or whole documents. Windows find what shares its
    lines with other words, or runs over several paragraphs of a longer text. The words of a whole text are those of its lines.
    """
    text = F.coalesce("text", F.lit(""))
    several, parted = F.contains("text", F.lit("\n")), F.col("text").rlike("\n[ \t]*\n")
    blocks = F.split("text", "\n(?:[ \t]*\n)+")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).withColumn("lines", F.transform(F.split("text", "\n"), words)).withColumn("all", F.flatten("lines"))
    # What reaches the threshold has a word of some anchor: most texts have none and end here.
    rows = rows.where(F.arrays_overlap("all", F.array(*map(F.lit, anchors(given, threshold)[1])).cast("array<string>")))
    rows = rows.withColumn("windows", windows(F.col("all"), given, threshold))
    numbers = lambda found: F.flatten(F.transform(found, lambda w, i: F.array_repeat(i, F.size(w))))
    some = F.size("windows") > 0
    rows = rows.withColumn("line of", F.when(some, numbers(F.col("lines")))).withColumn("part of", F.when(some, numbers(F.transform(blocks, words))))
    span = "struct<from:int,to:int,line:int,last_line:int,part:int,last_part:int>"
    none = F.array().cast(f"array<struct<line:int,part:int,at:{span},words:array<string>>>")
    unit = lambda line, part, found, at=F.lit(None).cast(span): F.struct(line.cast("int").alias("line"), part.cast("int").alias("part"), at.alias("at"), found.alias("words"))
    ends = lambda c, r, a, b: (F.get(F.col(c), r["from"]).alias(a), F.get(F.col(c), r["to"] - 1).alias(b))
    at = lambda r: F.struct(r["from"].alias("from"), r["to"].alias("to"), *ends("line of", r, "line", "last_line"), *ends("part of", r, "part", "last_part"))
    every = F.concat(
        F.transform("lines", lambda w, i: unit(i, i, w)),
        F.when(several, F.array(unit(F.lit(-1), F.lit(0), F.col("all")))).otherwise(none),
        F.when(several & parted, F.filter(F.transform(blocks, lambda b, i: F.when(F.contains(b, F.lit("\n")), unit(F.lit(-2), i, words(b)))), lambda u: u.isNotNull())).otherwise(none),
        F.transform("windows", lambda r: unit(F.lit(-3), F.lit(0), r["words"], at(r))),
    )
    return rows.select("doc_id", "text_hash", F.inline(every))


def scan(documents: DataFrame, given=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line, licence, dice of every unit (see units) that matches a template: its best one, the first at a tie.

    Only matches shuffle: templates are bounded (MAX_TEMPLATES) and go to all tasks, found by a unit's
    number of bigrams. A window counts where no other unit that matches holds it, or meets it and is as good, and of windows
    that meet the best one. Null and empty texts match nothing, nor do units of one word. Rows that
    repeat, or lack, a doc_id have rows of their own. Other columns are ignored; an empty table gives none.
    """
    known = templates(documents.sparkSession, given, threshold)
    most = known.agg(F.max("size")).first()[0] or 0
    # A text with d different words has d - 1 different bigrams at least: most whole texts end here.
    found = units(documents, given, threshold).where((F.size("words") >= 2) & ((F.size("words") <= most + 1) | (F.size(F.array_distinct("words")) <= most + 1)))
    unit = ["doc_id", "text_hash", "line", "part", "at"]
    found = found.select(*unit, bigrams(F.col("words")).alias("bigrams")).withColumn("size", F.size("bigrams"))
    compared = found.join(F.broadcast(known), "size").select(
        *unit,
        F.transform(
            "candidates",
            lambda t: F.struct((2.0 * F.size(F.array_intersect(F.col("bigrams"), t.bigrams)) / (F.col("size") + F.size(t.bigrams))).alias("dice"), (-t.template).alias("order"), t.licence.alias("licence")),
        ).alias("scores"),
    )
    best = compared.select(*unit, F.array_max("scores").alias("best"))
    matched = saved(best.where(F.col("best.dice") >= threshold - 1e-9).select(*unit, "best.licence", "best.dice"), "licences")
    out = ["doc_id", "line", "licence", "dice"]
    return matched.where("line <> -3").select(*out).unionByName(_apart(matched).select(*out))


def _apart(matched: DataFrame) -> DataFrame:
    """The windows of matched that count (see scan). Rows of one doc_id and one text have the same ones."""
    is_window = F.col("line") == -3
    each = matched.groupBy("doc_id", "text_hash", "line", "part", "at", "licence", "dice").agg(F.count("*").alias("copies"))
    best_first = F.struct((-F.col("dice")).alias("order"), "at", "licence", "dice", "copies")
    texts = each.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.when(is_window, best_first))).alias("windows"), F.collect_list(F.when(~is_window, F.struct("line", "part", "dice"))).alias("others"))

    def held(w: Column, o: Column) -> Column:
        first, last = (F.when(o["line"] == -2, w["at"][p]).otherwise(w["at"][n]) for p, n in (("part", "line"), ("last_part", "last_line")))
        inside, meets = (first == o["part"]) & (last == o["part"]), (first <= o["part"]) & (o["part"] <= last)
        return (o["line"] == -1) | inside | (meets & (o["dice"] >= w["dice"]))

    free = F.filter("windows", lambda w: ~F.exists("others", lambda o: held(w, o)))
    meets = lambda a, b: (a["at"]["from"] < b["at"]["to"]) & (b["at"]["from"] < a["at"]["to"])
    alone = lambda free: F.aggregate(free, F.filter(free, lambda w: F.lit(False)), lambda acc, w: F.when(F.exists(acc, lambda a: meets(a, w)), acc).otherwise(F.concat(acc, F.array(w))))
    kept = texts.where(F.size("windows") > 0).select("doc_id", free.alias("free")).select("doc_id", F.inline(alone(F.col("free"))))
    return kept.select("doc_id", F.lit(-3).alias("line"), "licence", "dice", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


def by_document(documents: DataFrame, given=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per doc_id of documents: n_matches, licences (distinct, in order, comma-joined; empty where none) and dice (the best, 0 where none)."""
    found = scan(documents, given, threshold).groupBy("doc_id").agg(F.count("*").alias("n_matches"), F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"), F.max("dice").alias("dice"))
    everyone = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_matches"), F.lit("").alias("licences"), F.lit(0.0).alias("dice"))
    return everyone.unionByName(found).groupBy("doc_id").agg(F.max("n_matches").alias("n_matches"), F.max("licences").alias("licences"), F.max("dice").alias("dice"))
