"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies. Native.

Words are runs of letters and digits, lower-cased; shingles are five words. For every template of t shingles, the text is cut
into windows of t shingles that overlap by three quarters. A window's signature is ``BANDS`` MinHash values of one row each;
it retrieves the templates of its length that share a band.

Where a text holds a share c of a template, some window holds at least c - 1/8 of it, so its Jaccard similarity is at least
(c - 1/8) / (2 - c + 1/8), 0.51 at c = 0.8, and the bands miss it with a probability of at most 0.49 ** 24, under 1e-7.
With bands of one row, a window can share a band only if it holds the template's least shingle of that band; windows
without any template shingle therefore can't collide and are never made.

Verification counts the template's different shingles in the window and a quarter of its length on either side; a match has
a containment of 0.8 or more.

Template shingles are looked up in one hash set, made of the templates and not of the data; the bands are joined by a broadcast
of a row for each template and band. Windows are cut out before they are exploded, so a document's shingles don't travel.

Defined results: a null text is empty and matches nothing, as do texts of less than five words; every row is a document of its
own, whatever its id, so rows that repeat are reported each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh

SHINGLE, BANDS, CONTAINMENT = 5, 24, 0.8

# Common license notices and whole license texts.
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES = {
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
    "BSD-2-Clause-text": _BSD + _BSD_END,
    "BSD-3-Clause-text": _BSD + _BSD_3 + _BSD_END,
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _WARRANTY.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS"),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}


def let(value, body):
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text):
    """The array of the text's shingle hashes, in order, as a native expression."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    each = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)]))
    return let(hashes, lambda h: F.when(F.size(h) >= SHINGLE, each(h)).otherwise(F.array().cast("array<bigint>")))


def signature(own):
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(own, lambda s: F.xxhash64(s, b))))


def stride(t):
    return F.greatest(F.lit(1), F.floor(t / 4)).cast("int")


def scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", least: float = CONTAINMENT) -> DataFrame:
    """One row per document and template found: id, license, containment (the best window's), first_shingle (the first match's)."""
    spark = df.sparkSession
    known = spark.createDataFrame(sorted(templates.items()), "license string, notice string").select("license", F.array_distinct(shingles(F.col("notice"))).alias("own"))
    known = known.filter(F.size("own") > 0).withColumn("t", F.size("own"))
    # constants of the templates, not of the data: a few hundred shingles
    rows = known.collect()
    if not rows:
        return spark.createDataFrame([], f"{id_col} {df.schema[id_col].dataType.simpleString()}, license string, containment double, first_shingle long")
    every = sorted({s for r in rows for s in r.own})
    sizes = sorted({r.t for r in rows})
    known = spark.createDataFrame([(r.license, r.own, r.t) for r in rows], "license string, own array<bigint>, t int")
    bands = known.select("t", F.posexplode(signature(F.col("own"))).alias("band", "least"), "license", "own")

    own_id, row = fresh("id"), fresh("row")
    docs = df.select(F.col(id_col).alias(own_id), F.monotonically_increasing_id().alias(row), shingles(F.col(text_col).cast("string")).alias("all"))
    hits = let(F.col("all"), lambda a: F.filter(F.sequence(F.lit(0), F.size(a)), lambda i: F.get(a, i).isin(every)))

    def cut(t):
        """The windows of t shingles that hold a hit, with a quarter more on either side for verification."""
        s = stride(t)

        def at_hit(p):
            first = F.greatest(F.lit(0), F.ceil((p - (t - 1)) / s).cast("int"))
            return F.sequence(first, F.greatest(first, F.floor(p / s).cast("int")))

        def window(w):
            at = (w * s).cast("int")
            wide = F.greatest(F.lit(0), at - s)
            return F.struct(t.alias("t"), at.alias("at"), F.slice("all", at + 1, t).alias("inner"), F.slice("all", wide + 1, t + 2 * s).alias("outer"))

        return F.transform(F.array_distinct(F.flatten(F.transform(F.col("hits"), at_hit))), window)

    near = docs.select(own_id, row, "all", F.explode(F.array(hits)).alias("hits")).filter(F.size("hits") > 0)
    asked = near.select(own_id, row, F.explode(F.flatten(F.transform(F.array(*map(F.lit, sizes)), cut))).alias("w")).select(own_id, row, "w.*").filter(F.size("inner") > 0)
    asked = asked.select(own_id, row, "t", "at", "outer", F.posexplode(signature(F.col("inner"))).alias("band", "least"))
    found = asked.join(F.broadcast(bands), ["t", "band", "least"])
    verified = found.select(own_id, row, "license", "at", (F.size(F.array_intersect("outer", "own")) / F.size("own")).alias("containment")).filter(F.col("containment") >= least)
    best = verified.groupBy(own_id, row, "license").agg(F.max("containment").alias("containment"), F.min("at").cast("long").alias("first_shingle"))
    return best.drop(row).withColumnRenamed(own_id, id_col)
