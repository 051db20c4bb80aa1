"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment confirms them.

Words are those of decontamination, shingles runs of SHINGLE words. A template with m shingles belongs to the class of the next power of
two M (4 at least); its class has windows of M + M/2 shingles, one at each M/2, so any M shingles in a row
are whole in some window. A band is one minimum. Where a window holds three quarters of a template, the Jaccard
similarity is at least 0.75 m / (1.5 M + 0.25 m), 0.23 for the least m of a class above 4 and 0.12 in the class of 4;
BANDS = 128 bands find it with a probability of more than 1 - 1e-7 (0.23: 1 - 3e-15). Retrieved templates count if the
window holds at least three quarters of their different shingles.

Windows without any shingle of a template of their class can't hold one, and are passed over before minima are taken: the shingles of all documents are joined with
those of the templates, which are broadcast while there are at most BROADCAST_ROWS of them, and shuffled beyond. Templates are a table of any size.

Null text has no windows; templates of fewer words than a shingle are ignored; rows with equal doc_id count together, a null
doc_id too; documents without a license give no row; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiline.llm.common import let, materialise, table, workspace
from lexiline.llm.op7_decontaminate import gram_hashes, small, word_hashes, words

SHINGLE, BANDS = 3, 128
#: documents with windows, and bands of templates with their shingles, that may be broadcast, by count
BROADCAST_DOCS, BROADCAST_BANDS = 100_000, 10_000
#: fixed values: short notices by which texts state their license, and full texts of short licenses
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-3-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def seeds(n: int = BANDS) -> list[int]:
    rng = random.Random(6)
    return [rng.getrandbits(64) - (1 << 63) for _ in range(n)]


def shingles(text: Column) -> Column:
    """Hashes of the shingles of a text, in order."""
    return let(word_hashes(words(text)), lambda h: gram_hashes(h, SHINGLE))


def bands(window: str) -> Column:
    """Minima of the shingles under xor with each seed, which is a permutation of all hashes."""
    each = F.transform(F.array(*[F.lit(s) for s in seeds()]), lambda s: F.array_min(F.transform(F.col(window), lambda x: x.bitwiseXOR(s))))
    return F.posexplode(each)


def license_scan(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, license_id, n_windows (that hold it), containment (best, in thousandths), first_word (of the first window)."""
    place = workspace(docs.sparkSession)
    known = templates.select("license_id", F.array_distinct(shingles(F.col("text"))).alias("template")).filter("size(template) > 0")
    power = F.when(F.size("template") > 4, F.call_function("shiftleft", F.lit(1), F.length(F.bin(F.size("template") - 1)))).otherwise(4)
    known = materialise(known.withColumn("class", power.cast("int")), place, "templates")
    parts = materialise(known.select(F.explode("template").alias("s"), "class").distinct(), place, "shingles")

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    each = own.select("doc_id", F.posexplode(shingles(F.col("text"))).alias("pos", "s")).join(small(parts, parts.count()), "s")
    # windows of a class begin at each half of it and have one and a half: the last three that begin at or before a shingle can have it
    half = F.expr("class div 2")
    last = F.expr("pos div (class div 2)")
    starts = F.transform(F.sequence(F.greatest(F.lit(0), last - 2), last), lambda k: (k * half).cast("int"))
    found = each.select("doc_id", "class", F.explode(starts).alias("at")).distinct().groupBy("doc_id").agg(F.collect_set(F.struct("class", "at")).alias("cuts"))
    found = materialise(found.withColumnRenamed("doc_id", "own_id"), place, "found")
    # a document's windows are bounded by its words
    hit = own.join(small(found, found.count(), BROADCAST_DOCS), F.col("doc_id").eqNullSafe(F.col("own_id"))).select("doc_id", "cuts", "text")
    one = lambda s, x: F.struct(x["class"].alias("class"), x["at"].alias("at"), F.slice(s, x["at"] + 1, x["class"] + F.floor(x["class"] / 2).cast("int")).alias("w"))
    windows = let(shingles(F.col("text")), lambda s: F.filter(F.transform("cuts", lambda x: one(s, x)), lambda x: F.size(x["w"]) > 0))
    window = hit.select("doc_id", F.explode(windows).alias("x")).select("doc_id", "x.class", "x.at", "x.w")
    banded = materialise(known.select("license_id", "class", "template", bands("template").alias("band", "value")), place, "bands")
    met = window.select("doc_id", "class", "at", "w", bands("w").alias("band", "value")).join(small(banded, banded.count(), BROADCAST_BANDS), ["class", "band", "value"])
    pairs = met.select("doc_id", "at", "license_id", F.size("template").alias("m"), F.size(F.array_intersect("w", "template")).alias("held"))
    confirmed = pairs.filter("4 * held >= 3 * m").distinct()
    return confirmed.groupBy("doc_id", "license_id").agg(
        F.countDistinct("at").cast("long").alias("n_windows"), F.max(F.expr("1000 * held div m")).cast("long").alias("containment"), F.min("at").cast("long").alias("first_word")
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), spark.createDataFrame([*NOTICES.items()], "license_id string, text string"))


_CUT = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
ORACLE_SQL = f"""
WITH t(license_id, text) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in NOTICES.items())}),
ts AS (SELECT DISTINCT license_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM (SELECT license_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM (SELECT license_id, {_CUT} AS w FROM t))),
tm AS (SELECT license_id, count(*) AS m, greatest(4, power(2, ceil(log2(count(*))))::BIGINT) AS cls FROM ts GROUP BY 1),
dw AS (SELECT doc_id, {_CUT} AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM dw WHERE len(w) >= {SHINGLE})),
hit AS (SELECT doc_id, license_id, pos, s, m, cls FROM ds JOIN ts USING (s) JOIN tm USING (license_id)),
win AS (SELECT *, unnest(range(greatest(0, (pos - cls - cls // 2) // (cls // 2) - 1), pos // (cls // 2) + 1)) * (cls // 2) AS "at" FROM hit),
held AS (SELECT doc_id, license_id, "at", m, count(DISTINCT s) AS held FROM win WHERE "at" <= pos AND pos < "at" + cls + cls // 2 GROUP BY ALL)
SELECT doc_id, license_id, count(*)::BIGINT AS n_windows, max(1000 * held // m)::BIGINT AS containment, min("at")::BIGINT AS first_word FROM held WHERE 4 * held >= 3 * m GROUP BY ALL
"""
