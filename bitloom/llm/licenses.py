"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

For every template size (in shingles of five words) the scan lays windows of that size over a text, overlapping by
three quarters, draws HASHES minima of hashed shingles from each, and joins BANDS bands of two minima with those of
the templates. A window that holds a template with 0.8 of its shingles, shifted by up to half a step, has a Jaccard
similarity of 0.5 or more with it and shares a band with a chance of over 0.999. What is retrieved counts only if the
text around the window really holds the asked share of the template's shingles.

A window without any of the templates' shingles can hold no share of a template; such windows, which are nearly all,
are left out before their minima are drawn, as are windows with fewer such shingles around them than the asked share.
All of it is DataFrame functions.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, text_of

WORDS = 5
CONTAINED = 0.8
BANDS, ROWS = 24, 2
HASHES = BANDS * ROWS
#: Notices that name a license, standard headers and whole texts.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "You may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "bsd": "Released under the BSD License.",
    "mpl-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
}
_WARRANTY = "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"
_BSD_1_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(thing: str, license: str, version: str) -> str:
    return f"""This {thing} is free software: you can redistribute it and/or modify it under the terms of the {license} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; {_WARRANTY} {license} for more details."""


TEMPLATES |= {
    "gpl-2.0-header": _gnu("program", "GNU General Public License", "2"),
    "gpl-3.0-header": _gnu("program", "GNU General Public License", "3"),
    "lgpl-2.1-header": _gnu("library", "GNU Lesser General Public License", "2.1"),
    "lgpl-3.0-header": _gnu("program", "GNU Lesser General Public License", "3"),
    "agpl-3.0-header": _gnu("program", "GNU Affero General Public License", "3"),
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "apache-2.0-header-whole": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "mit-text-whole": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause-text": f"{_BSD_1_2}\n{_BSD_AS_IS}",
    "bsd-3-clause-text": f"{_BSD_1_2}\n{_BSD_3}\n{_BSD_AS_IS}",
} | {f"{path.stem}-text": path.read_text() for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
MARKS = ".,;:!?()[]{}\"'*#"
SPACES = " \t\n\x0b\x0c\r"


def shingle_hashes(text: Column) -> Column:
    """Hashes of a text's runs of five words, in order; words are in lower case, without marks, and hold a letter or digit."""
    words = F.filter(F.split(F.translate(F.lower(text), SPACES + MARKS, " " * len(SPACES)), " "), lambda w: w.rlike(r"[\p{L}\p{N}]"))
    of = lambda w: F.when(F.size(w) >= WORDS, F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WORDS)]))).otherwise(F.array().cast("array<bigint>"))
    return F.element_at(F.transform(F.array(words), of), 1)


def band_keys(window: Column) -> Column:
    """A hash for each band of the minima of a window's hashed shingles."""
    minimum = lambda t, r: F.array_min(F.transform(window, lambda x: F.xxhash64(x, t, F.lit(r))))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda t: F.xxhash64(t, *[minimum(t, r) for r in range(ROWS)]))


def template_shingles(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    pairs = [F.struct(F.lit(name).alias("license"), F.lit(text).alias("template")) for name, text in sorted(templates.items())]
    rows = spark.range(1).select(F.explode(F.array(*pairs)).alias("t")).select("t.*") if pairs else spark.range(0).select(F.lit("").alias("license"), F.lit("").alias("template"))
    return rows.select("license", F.array_distinct(shingle_hashes(F.col("template"))).alias("shingles")).where(F.size("shingles") > 0)


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, license, containment, start_word) for every document and template that it holds.

    containment is the largest share of the template's shingles in one place, start_word the first window that has it.
    Null, empty and shorter texts than five words hold nothing, as do templates of fewer words. Repeated rows, and
    rows with a null doc_id, are one document each id; other columns are ignored. Of places that are equally like a
    template the first counts; templates that are equally like a place are all reported. A long text is one row whose
    windows are laid over all of it; its cost is linear. Empty input: empty result.
    templates is a parameter, and so of known size; it is the only thing that is broadcast.
    """
    spark = docs.sparkSession
    known = template_shingles(spark, templates).collect()
    if not known:
        return spark.createDataFrame([], "doc_id long, license string, containment double, start_word int")
    every = ", ".join(f"{x}L" for x in sorted({x for r in known for x in r["shingles"]}))
    sizes = sorted({len(r["shingles"]) for r in known})
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shingle_hashes(text_of()).alias("sh"))
    # The few texts with a template's shingle are written, so that the windows are laid over what was kept.
    kept = materialize(texts.where(F.expr(f"exists(sh, x -> x in ({every}))")))
    kept = materialize(kept.withColumn("hits", F.expr(f"filter(transform(sh, (x, i) -> if(x in ({every}), i, null)), i -> i is not null)")))
    sized = kept.withColumn("size", F.explode(F.array(*[F.lit(x) for x in sizes]))).where(F.size("hits") >= F.col("size") * contained - 1e-9)
    sized = sized.withColumn("step", F.greatest(F.lit(1), F.floor(F.col("size") / 4).cast("int")))
    grid = lambda i: F.floor(F.greatest(F.lit(0), i) / F.col("step")).cast("int")
    starts = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.transform(F.sequence(grid(h - F.col("size") + 1), grid(h)), lambda x: x * F.col("step")))))
    placed = sized.withColumn("start", F.explode(starts))
    first, length = F.greatest(F.lit(0), F.col("start") - F.col("step")), F.col("size") + 2 * F.col("step")
    enough = F.size(F.filter("hits", lambda h: (h >= first) & (h < first + length))) >= F.col("size") * contained - 1e-9
    placed = placed.where(enough)
    laid = placed.select("doc_id", "size", "start", F.array_distinct(F.slice("sh", F.col("start") + 1, F.col("size"))).alias("window"), F.array_distinct(F.slice("sh", first + 1, length)).alias("around"))
    banded = laid.select("doc_id", "size", "start", "around", F.posexplode(band_keys(F.col("window"))).alias("band", "key"))
    wanted = template_shingles(spark, templates).select("license", "shingles", F.size("shingles").alias("size"), F.posexplode(band_keys(F.col("shingles"))).alias("band", "key"))
    retrieved = banded.join(F.broadcast(wanted), ["size", "band", "key"]).select("doc_id", "license", "start", "around", "shingles").distinct()
    share = F.size(F.array_intersect("around", "shingles")) / F.size("shingles")
    found = retrieved.withColumn("containment", share).where(F.col("containment") >= contained - 1e-9)
    best = F.max(F.struct("containment", (-F.col("start")).alias("start"))).alias("best")
    return found.groupBy("doc_id", "license").agg(best).select("doc_id", "license", "best.containment", (-F.col("best.start")).alias("start_word"))
