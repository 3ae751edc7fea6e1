"""Licence scans: normalised text against licence templates, in DataFrame functions only.

A text is parted into paragraphs (between blank lines), lines and sentences.  Sentences, lines,
paragraphs and runs of consecutive paragraphs are *units*.  Units and templates are normalised (lower
case, runs of other characters than letters and digits to one blank) and become sets of
word bigrams; a unit matches a template if their Dice coefficient

    2 |A n B| / (|A| + |B|)

reaches the threshold t.  That needs t / (2 - t) <= |A| / |B| <= (2 - t) / t, so a
template is a candidate only for units of the sizes it admits: templates are
spread over their sizes and joined to units by size.  No unit has more words than the largest template admits
bigrams, which bounds the runs.  A match also shares t / (2 - t) of the template's bigrams, so texts (and units)
go first that hold none of the ``anchors`` of a short template and too few of the ``long_words`` of the long ones.
Templates are a fixed list, so their side has a proven bound.

Which licence it is: a unit keeps the template of the highest Dice, and all of them on a tie (flagged).
Where names and numbers tell a template from one of another licence (``lesser``, ``3``), the unit must have them.  Units
overlap; a match counts only if it is the best on every sentence it covers, by the bigrams it shares less those it
does not, first among matches of the same licence, then among all that are left.
"""

from __future__ import annotations

from collections import Counter
from math import ceil, floor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import Stored, cut

THRESHOLD = 0.8
#: Templates of other licences are so alike that the names and numbers in which they differ decide.
ALIKE = 0.6

#: Templates of so many bigrams are long.
LONG = 25

# Words that licences are named by, and words that are in most texts.
NAMES = {"affero", "apache", "bsd", "by", "cc", "cc0", "gnu", "gpl", "spdx", "isc", "lesser", "lgpl", "agpl", "mit", "mozilla", "mpl", "nc", "nd", "noderivatives", "noncommercial", "sa", "sharealike"}
COMMON = set("a all an and any are as at be but by can either following for from has have if in is it may must no not of on or other part provided see shall than that the their this to under use used which with without work you your".split())

# Public licence texts and the usual short notices.
TEMPLATES = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Released under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "Released under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Released under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "Released under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "Released under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "Released under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-SA-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-ND-4.0", "SPDX-License-Identifier: CC-BY-ND-4.0"),
    ("CC-BY-NC-SA-4.0", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"),
    ("CC-BY-NC-ND-4.0", "SPDX-License-Identifier: CC-BY-NC-ND-4.0"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced without permission."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)

_NOT_WORD = r"[^\p{L}\p{N}]+"
PARAGRAPH, SENTENCE = r"\n\s*\n", r"[.!?;]+\s+"


def normalised(text):
    """Lower-case words joined by one blank."""
    return F.trim(F.regexp_replace(F.lower(text), _NOT_WORD, " "))


def bigrams(words):
    """The set of word bigrams of an array of words; empty for fewer than two words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b)))


def _words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _pairs(text: str) -> set[tuple[str, str]]:
    w = _words(text)
    return set(zip(w, w[1:], strict=False))


def _need(pairs: set, threshold: float) -> int:
    """How many of a template's bigrams every match has at least."""
    return ceil(threshold / (2 - threshold) * len(pairs) - 1e-9)


def anchors(templates, threshold: float = THRESHOLD) -> list[str]:
    """Words of which every unit that matches a template of fewer than LONG bigrams has one: of each the words of four letters or more that licences
    are named by, then the longest, until so few of its bigrams are without them that no match can do with those alone."""
    out = set()
    for _, text in templates:
        bare = _pairs(text)
        if len(bare) >= LONG:
            continue
        need = _need(bare, threshold)
        for w in sorted(set(_words(text)), key=lambda w: (w in COMMON, len(w) <= 3, w not in NAMES, -len(w), w)):
            if len(bare) < need:
                break
            out.add(w)
            bare = {p for p in bare if w not in p}
    return sorted(out)


def long_words(templates, threshold: float = THRESHOLD) -> tuple[list[str], int]:
    """Words that are not COMMON of the templates of LONG bigrams or more, and how many different ones every match has.

    A match has need bigrams, with 2 need places for words.  What places of the template common words do not fill, others
    must, and each fills at most those that it has in the template."""
    vocabulary, least = set(), None
    for _, text in templates:
        pairs = _pairs(text)
        if len(pairs) < LONG:
            continue
        places = Counter(w for p in pairs for w in p)
        missing = 2 * _need(pairs, threshold) - sum(n for w, n in places.items() if w in COMMON)
        many = sorted((n for w, n in places.items() if w not in COMMON), reverse=True)
        n = 0
        while missing > 0:
            missing -= many[n]
            n += 1
        vocabulary |= places.keys() - COMMON
        least = n if least is None else min(least, n)
    return sorted(vocabulary), least or 0


def telling(templates) -> list[list[str]]:
    """For each template the names and numbers that tell it from templates of other licences that are ALIKE."""
    pairs, out = [_pairs(t) for _, t in templates], []
    for i, (licence, text) in enumerate(templates):
        mine = set()
        for k, (other, rival) in enumerate(templates):
            if other != licence and 2 * len(pairs[i] & pairs[k]) >= ALIKE * (len(pairs[i]) + len(pairs[k])):
                mine |= {w for w in set(_words(text)) - set(_words(rival)) if w in NAMES or w.isdigit() and len(w) == 1}
        out.append(sorted(mine))
    return out


def most_words(templates, threshold: float = THRESHOLD) -> int:
    """Words of the longest unit that can match."""
    return floor(max(len(_pairs(t)) for _, t in templates) * (2 - threshold) / threshold + 1e-9) + 1


def template_sizes(spark: SparkSession, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """(size, licence, grams, telling): each template once for every size of a set that can reach the threshold."""
    rows = spark.createDataFrame([(*t, words) for t, words in zip(templates, telling(templates), strict=True)], "licence string, text string, telling array<string>")
    rows = rows.select("licence", "telling", bigrams(F.split(normalised("text"), " ")).alias("grams")).where(F.size("grams") > 0)
    n = F.size("grams")
    low, high = F.ceil(n * threshold / (2 - threshold) - 1e-9), F.floor(n * (2 - threshold) / threshold + 1e-9)
    return rows.select(F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("size"), "licence", "grams", "telling")


_DOC = ["doc_id", "h"]


def _hints(words, templates, threshold: float):
    """Whether a text or unit of these words has an anchor, and whether it has words enough for a long template."""
    many, least = long_words(templates, threshold)
    of = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    return F.arrays_overlap(words, of(anchors(templates, threshold))), (F.size(F.array_intersect(words, of(many))) >= max(least, 1)) & F.lit(bool(many))


def _may_match(words, templates, threshold: float):
    few, many = _hints(words, templates, threshold)
    return few | many


def paragraphs(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, h, p, lines, many): the paragraphs of texts that may match.  ``lines`` are arrays of sentences with words,
    struct(id, w), of ids in the order of the text; h is the text's hash, and ``many`` says that the text has words enough for a long template.

    A sentence longer than any template stays, as its first words: enough that no line, paragraph or run with it can match."""
    most = most_words(templates, threshold)
    words = F.split(normalised("text"), " ")
    few, many = _hints(words, templates, threshold)
    likely = docs.select("doc_id", "text", F.explode(F.array(F.struct(few.alias("few"), many.alias("many")))).alias("m")).where("m.few or m.many")
    each = likely.select("doc_id", F.xxhash64("text").alias("h"), "m.many", F.posexplode(F.split("text", PARAGRAPH)).alias("p", "x"))
    number = lambda l, i: F.col("p").cast("long") * (1 << 42) + l.cast("long") * (1 << 21) + i.cast("long")  # noqa: E731, E741
    kept = lambda parts: F.filter(parts, lambda s: s["w"][0] != "")
    line = lambda x, l: kept(F.transform(F.split(x, SENTENCE), lambda s, i: F.struct(number(l, i).alias("id"), F.slice(F.split(normalised(s), " "), 1, most + 1).alias("w"))))  # noqa: E731, E741
    lines = F.filter(F.transform(F.split("x", "\n"), line), lambda x: F.size(x) > 0)
    return each.select("doc_id", "h", "p", "many", F.explode(F.array(lines)).alias("lines")).where(F.size("lines") > 0)


def _joined(parts):
    """Sentences as one unit."""
    return F.struct(F.transform(parts, lambda s: s["id"]).alias("ids"), F.flatten(F.transform(parts, lambda s: s["w"])).alias("w"))


def units(rows: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, h, ids, w): sentences, lines of several sentences, paragraphs of several lines and runs of paragraphs that may match,
    with the sentences that they cover; of up to ``most_words``.

    A run starts and ends with a paragraph that has a bigram of a template: without such an end it is nearer to any template.
    Only texts that may hold a long template have runs; nothing else is shuffled here."""
    most = most_words(templates, threshold)
    may = lambda u: F.filter(u, lambda x: (F.size(x["w"]) <= most) & _may_match(x["w"], templates, threshold))
    single = F.transform(F.flatten("lines"), lambda s: F.struct(F.array(s["id"]).alias("ids"), s["w"].alias("w")))
    line = F.transform(F.filter("lines", lambda x: F.size(x) > 1), _joined)
    whole = F.when(F.size("lines") > 1, F.array(_joined(F.flatten("lines")))).otherwise(F.array().cast("array<struct<ids:array<bigint>,w:array<string>>>"))
    within = rows.select(*_DOC, F.explode(may(F.concat(single, line, whole))).alias("u")).select(*_DOC, "u.ids", "u.w")
    known = F.array(*map(F.lit, sorted({" ".join(p) for _, t in templates for p in _pairs(t)})))
    paragraph = rows.where("many").select(*_DOC, "p", _joined(F.flatten("lines")).alias("u")).select(*_DOC, "p", "u.ids", "u.w").where(F.size("w") <= most)
    placed = paragraph.dropDuplicates([*_DOC, "p"]).withColumn("edge", F.arrays_overlap(bigrams("w"), known))
    placed = placed.withColumn("upto", F.sum(F.size("w")).over(Window.partitionBy(*_DOC).orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    near = F.collect_list(F.struct("p", "upto", "ids", "w", "edge")).over(Window.partitionBy(*_DOC).orderBy("upto").rangeBetween(Window.currentRow, most))
    runs = placed.withColumn("near", near).where("edge and size(near) > 1")
    nth = lambda k: F.col("near")[k - 1]
    end = F.filter(F.sequence(F.lit(2), F.size("near")), lambda k: nth(k)["edge"] & (nth(k)["p"] - F.col("p") == k - 1) & (nth(k)["upto"] - F.col("upto") + F.size("w") <= most))
    runs = runs.select(*_DOC, "near", F.explode(end).alias("k")).withColumn("part", F.slice("near", 1, F.col("k")))
    runs = runs.select(*_DOC, F.flatten(F.transform("part", lambda x: x["ids"])).alias("ids"), F.flatten(F.transform("part", lambda x: x["w"])).alias("w"))
    return within.unionByName(runs.where(_may_match(F.col("w"), templates, threshold)))


def _best(found: DataFrame, *by: str) -> DataFrame:
    """The matches that are the best on every sentence that they cover (among those of the same ``by``)."""
    mine = F.struct("score", "dice", (-F.col("lo")).alias("a"), "hi")
    each = found.withColumn("at", F.explode("ids")).withColumn("top", F.max(mine).over(Window.partitionBy(*_DOC, "at", *by)))
    lost = each.where(F.col("top") != mine).select(*_DOC, "lo", "hi").distinct()
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*_DOC, "lo", "hi")]
    return found.alias("a").join(lost.alias("b"), same, "left_anti")


def matches(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """(doc_id, h, lo, hi, ids, licences, dice, score): the units that match, with the licences (more than one on a tie)."""
    sizes = template_sizes(docs.sparkSession, threshold, templates)
    parts = Stored(paragraphs(docs, templates, threshold))
    pairs = units(parts.df, templates, threshold).select(*_DOC, "ids", "w", bigrams("w").alias("have")).withColumn("size", F.size("have")).join(F.broadcast(sizes), "size")
    both, total = F.size(F.array_intersect("have", "grams")), F.size("have") + F.size("grams")
    pairs = pairs.where(F.size(F.array_except("telling", "w")) == 0).select(*_DOC, "ids", "licence", (2.0 * both / total).alias("dice"), (3 * both - total).alias("score"))
    most = pairs.where(F.col("dice") >= threshold).groupBy(*_DOC, F.get("ids", F.lit(0)).alias("lo"), F.element_at("ids", -1).alias("hi"), "ids").agg(F.max("dice").alias("dice"), F.collect_list(F.struct("dice", "licence", "score")).alias("x"))
    top = F.filter("x", lambda x: x["dice"] == F.col("dice"))
    names = F.array_sort(F.array_distinct(F.transform(top, lambda x: x["licence"])))
    found = cut(most.select(*_DOC, "lo", "hi", "ids", F.array_join(names, ",").alias("licences"), "dice", F.array_max(F.transform(top, lambda x: x["score"])).alias("score")))
    parts.drop()
    return _best(_best(found, "licences"))


def report(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_matches, n_tied, n_licences, licences and best_dice, a row for each doc_id.

    ``licences`` are the ids found, sorted, comma-joined ('' for none); ``n_matches`` counts
    the units that match, ``n_tied`` those on which licences tie.  Null and empty texts match nothing; equal rows
    of an id count once, different texts of it together; other columns are ignored; a null id is an id."""
    found = matches(docs.where("text is not null"), threshold, templates)
    each = found.select("doc_id", "dice", F.col("licences").contains(",").cast("long").alias("tied"), F.split("licences", ",").alias("l"))
    by = each.groupBy("doc_id").agg(F.count("*").alias("n_matches"), F.sum("tied").alias("n_tied"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("l")))).alias("l"), F.max("dice").alias("best_dice"))
    by = by.select(F.col("doc_id").alias("d"), "n_matches", "n_tied", F.size("l").cast("long").alias("n_licences"), F.array_join("l", ",").alias("licences"), "best_dice")
    out = docs.select("doc_id").distinct().join(by, F.col("doc_id").eqNullSafe(F.col("d")), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", *[F.coalesce(c, zero).alias(c) for c in ("n_matches", "n_tied", "n_licences")], F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("best_dice", F.lit(0.0)).alias("best_dice"))
