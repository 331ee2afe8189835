"""Licence texts by Dice coefficient over word bigrams, with DataFrame operations only.

Text and templates are normalised alike: lower case, runs of other signs than ASCII
letters and digits are one space. Bigrams of a document that a template has are hits. Hits
of a template make regions: runs of hits, and runs with a few other words between hits where
no plain run in them is a finding. Outside of these findings every other window that begins
and ends with a hit is a region too, whatever lies between its hits. A region is compared with its template: twice the common bigrams (as multisets) over the bigrams of
both. Regions whose size alone keeps the coefficient below the threshold are pruned
before anything is compared: for sizes a and b it is at most 2 min(a, b) / (a + b). Hits
that are in no window with enough hits for its length are dropped first. Of windows that
overlap, the one with the highest coefficient is told.

Templates are whole texts of the short licences, the standard headers of the long ones, and one-line notices.

Defined cases: a null or empty text has no findings; of windows that overlap with equal coefficients the one that begins first is
told, and of those the shorter; a template is found wherever it
stands and however often; rows that repeat an id and a text are reported once; null ids
are kept as null; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titlelake.llm.common import row_key, written

#: Coefficient from which a region is a licence text.
LEAST = 0.8
#: Words between two hits of a region, at most.
GAP = 4

FOUND = ["key", "doc_id", "license", "first_word", "last_word", "dice"]

# Short public licence notices, as authors put them in files; whole texts follow.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}

# Whole texts of short licences, and the standard headers of long ones.
AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. "
)
BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
WITHOUT_WARRANTY = (
    "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
)
TEMPLATES |= {
    "MIT-whole": TEMPLATES["MIT-text"] + " " + AS_IS,
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS "
        "IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": BSD_CLAUSES + BSD_DISCLAIMER,
    "BSD-3-Clause": BSD_CLAUSES + BSD_THIRD + BSD_DISCLAIMER,
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of "
        "this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for "
        "the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an "
        "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        + AS_IS.replace("AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS", "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS")
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
        "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and "
        "transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software "
        "is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, "
        "including the above license grant, this restriction and the following disclaimer, must be included in all copies of the "
        "Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are "
        "solely in the form of machine-executable object code generated by a source language processor."
    ),
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, " + WITHOUT_WARRANTY + "See the GNU General Public "
        "License for more details. You should have received a copy of the GNU General Public License along with this program; if "
        "not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, " + WITHOUT_WARRANTY + "See the GNU General Public "
        "License for more details. You should have received a copy of the GNU General Public License along with this program. If "
        "not, see https://www.gnu.org/licenses/."
    ),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, " + WITHOUT_WARRANTY + "See the GNU Affero "
        "General Public License for more details. You should have received a copy of the GNU Affero General Public License along "
        "with this program. If not, see https://www.gnu.org/licenses/."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later "
        "version. This library is distributed in the hope that it will be useful, " + WITHOUT_WARRANTY + "See the GNU Lesser "
        "General Public License for more details. You should have received a copy of the GNU Lesser General Public License along "
        "with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA "
        "02110-1301 USA"
    ),
    "EPL-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
        "available at https://www.eclipse.org/legal/epl-2.0/. SPDX-License-Identifier: EPL-2.0"
    ),
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. "
        "This work is published under the CC0 1.0 Universal Public Domain Dedication."
    ),
}


def normal_words(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded = F.translate(F.coalesce(text, F.lit("")), upper, lower)
    return F.array_remove(F.split(folded, "[^a-z0-9]+"), "")


def bigrams(words: Column) -> Column:
    """Pairs of a word and the next, in order; the last word's has no second."""
    return F.arrays_zip(words.alias("first"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("second"))


def template_bigrams(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    """``license``, ``first``, ``second``, ``times``, ``size``, the template's bigrams in all, and ``pair``, the bigram's number in its template."""
    texts = [F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in sorted((templates or TEMPLATES).items())]
    rows = spark.range(1).select(F.inline(F.array(*texts)))
    words = rows.select("license", normal_words(F.col("text")).alias("words"))
    pairs = words.select("license", (F.size("words") - 1).alias("size"), F.inline(bigrams(F.col("words"))))
    pairs = pairs.filter("second is not null")
    counted = pairs.groupBy("license", "size", "first", "second").agg(F.count(F.lit(1)).cast("int").alias("times"))
    return counted.withColumn("pair", F.row_number().over(Window.partitionBy("license").orderBy("first", "second")))


def outside(hits: DataFrame, found: DataFrame) -> DataFrame:
    """The hits in no finding, with the number of the ``stretch`` between findings they lie in."""
    events = hits.select("key", "license", "at", F.lit(1).alias("step"), F.lit(0).alias("opens"), F.struct(*hits.columns).alias("hit"))
    none = F.lit(None).cast(events.schema["hit"].dataType).alias("hit")
    for at, step, opens in ((F.col("first_word"), 0, 1), (F.col("last_word") - 1, 2, -1)):
        ends = found.select("key", "license", at.cast("int").alias("at"), F.lit(step).alias("step"), F.lit(opens).alias("opens"), none)
        events = events.unionAll(ends)
    own = Window.partitionBy("key", "license").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0)
    marked = events.select("hit", F.sum("opens").over(own).alias("open"), F.sum(F.greatest("opens", F.lit(0))).over(own).alias("stretch"))
    return marked.filter("open = 0 and hit is not null").select("hit.*", "stretch")


def windows(hits: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """The best windows of hits outside of the findings that don't overlap each other."""
    each = ["key", "license", "stretch"]
    own = Window.partitionBy(*each).orderBy("at")
    # A window's hits, twice, less ``least`` for each of its bigrams must reach ``least`` times the size.
    sums = outside(hits, found).withColumn("sum", 2 * F.row_number().over(own) - least * F.col("at"))
    to, on = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    most = F.max("sum").over(on) - F.min("sum").over(to) + 2 - least
    kept = sums.withColumn("kept", most >= least * F.col("size") - 1e-6)
    zones = kept.withColumn("zone", F.sum(F.when(F.col("kept"), 0).otherwise(1)).over(to)).filter("kept")
    each = ["key", "doc_id", "license", "size", "stretch", "zone"]
    # A hit adds to what is common unless the window holds as many of its bigram before as the template.
    places = zones.groupBy(*each, "pair", "times").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    places = places.select(*each, F.posexplode("ats").alias("k", "at"), "ats", "times").withColumn(
        "before", F.when(F.col("k") >= F.col("times"), F.get("ats", (F.col("k") - F.col("times")).cast("int")))
    )
    rows = places.groupBy(*each).agg(F.sort_array(F.collect_list(F.struct("at", "before"))).alias("hits"))
    longest = F.floor(F.col("size") * ((2 - least) / least) + 1e-6).cast("int")

    def best(start: Column, i: Column) -> Column:
        def longer(a: Column, x: Column) -> Column:
            adds = (x["before"].isNull() | (x["before"] < start["at"])).cast("int")
            common, length = a["common"] + adds, x["at"] - start["at"] + 1
            dice = 2.0 * common / (length + F.col("size"))
            better = (length <= longest) & (dice > a["dice"])
            return F.struct(
                common.alias("common"),
                F.when(better, dice).otherwise(a["dice"]).alias("dice"),
                F.when(better, x["at"]).otherwise(a["high"]).alias("high"),
            )

        first = F.struct(F.lit(0).alias("common"), F.lit(0.0).alias("dice"), start["at"].alias("high"))
        top = F.aggregate(F.slice("hits", i + 1, longest), first, longer)
        return F.transform(F.array(top), lambda t: F.struct((-t["dice"]).alias("minus"), start["at"].alias("low"), t["high"].alias("high")))[0]

    tried = rows.select("key", "doc_id", "license", F.transform("hits", best).alias("tried"))
    good = tried.withColumn("tried", F.array_sort(F.filter("tried", lambda t: -t["minus"] >= least))).filter(F.size("tried") > 0)
    apart = F.aggregate(
        "tried",
        F.slice("tried", 1, 1),
        lambda a, x: F.when(F.exists(a, lambda y: (y["low"] <= x["high"]) & (x["low"] <= y["high"])), a).otherwise(F.concat(a, F.array(x))),
    )
    told = good.select("key", "doc_id", "license", F.explode(apart).alias("w"))
    return told.select(
        "key", "doc_id", "license", F.col("w.low").cast("long").alias("first_word"),
        (F.col("w.high") + 1).cast("long").alias("last_word"), (-F.col("w.minus")).alias("dice"),
    )


def license_scan(
    docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text", least: float = LEAST
) -> DataFrame:
    """Findings: ``doc_id``, ``license``, ``first_word`` and ``last_word`` (from 0, in
    normalised words), ``dice``. Of two templates that overlap in a text, both are told."""
    wanted = template_bigrams(docs.sparkSession, templates)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        row_key(doc_id, text).alias("key"),
        normal_words(F.col(text)).alias("words"),
    )
    places = rows.select("doc_id", "key", F.posexplode(bigrams(F.col("words"))).alias("at", "two"))
    # The templates are fixed and few. What moves of a hit are numbers and its licence, no words.
    hits = places.select("doc_id", "key", "at", "two.first", "two.second").join(F.broadcast(wanted), ["first", "second"]).drop("first", "second")
    hits = written(hits.dropDuplicates(["key", "license", "at"]), "hits")
    own = Window.partitionBy("key", "license").orderBy("at")
    apart = F.col("at") - F.lag("at").over(own)
    # Runs of hits without a gap, and runs with small gaps that hold them.
    marked = hits.withColumn("apart", apart).select(
        "*", *[F.sum(F.when(F.col("apart") <= gap, 0).otherwise(1)).over(own).alias(name) for gap, name in ((1, "run"), (GAP + 1, "loose"))]
    )
    levels = F.array(F.struct(F.lit(0).alias("level"), F.col("run").alias("region")), F.struct(F.lit(1).alias("level"), F.col("loose").alias("region")))
    regions = marked.select("*", F.inline(levels))
    each = ["key", "doc_id", "license", "size", "loose", "level", "region"]
    extent = Window.partitionBy("key", "license", "level", "region")
    sized = regions.withColumn("length", F.max("at").over(extent) - F.min("at").over(extent) + 1)
    bound = 2 * F.least("length", "size") / (F.col("length") + F.col("size"))
    compared = (
        sized.filter(bound >= least)
        .groupBy(*each, "length", "pair", "times")
        .agg(F.count(F.lit(1)).alias("own"), F.min("at").alias("low"), F.max("at").alias("high"))
        .groupBy(*each, "length")
        .agg(
            F.sum(F.least("own", "times")).alias("common"),
            F.min("low").cast("long").alias("first_word"),
            (F.max("high") + 1).cast("long").alias("last_word"),
        )
        .withColumn("dice", 2.0 * F.col("common") / (F.col("length") + F.col("size")))
        .filter(F.col("dice") >= least)
    )
    # A run with gaps is told only if no run without gaps in it is a finding.
    closest = F.min("level").over(Window.partitionBy("key", "license", "loose"))
    found = compared.withColumn("closest", closest).filter("level = closest")
    found = written(found.select(*FOUND), "found")
    while True:
        # What lies between findings may hold more; each round leaves less of it.
        more = written(windows(hits, found, least).select(*FOUND), "more")
        if more.isEmpty():
            return found.drop("key")
        found = found.unionAll(more)
