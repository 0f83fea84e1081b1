"""License scans: MinHash bands over overlapping text windows, in DataFrame functions only.

Templates are sorted into classes by their number of word shingles, up to 1, 2, 4, ... For a class
of up to s shingles a text is cut into windows of 2 * s shingles that begin every s shingles, so
that any passage as long as a template lies whole in some window. A window holding the asked
share of a template has a Jaccard similarity with it of at least

    least(s) = share * (s / 2 + 1/2) / (2 * s + (1 - share) * (s / 2 + 1/2))

and a class has so many bands of one row that its own templates, at their least similarity, meet
such a window with probability MEETS at least: 1 - (1 - similarity)^bands. Templates that a window
collides with are verified by exact containment of their shingles in it.

One step before loses nothing and saves most work: to hold the asked share of a template a text
must hold one of any few of its shingles, so texts that lack words of all of these are left out, and
in the others windows without the longest word of any. All other windows get bands, and only what
the bands retrieve is verified. The templates are a parameter of bounded size; their bands are
broadcast.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

SHINGLE = 5
SHARE = 0.8
MEETS = 0.9999
MOST_TEMPLATES = 200

#: Notices and whole texts that stand for a license, by name.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "bsd-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "0bsd-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
}

#: Words are runs of these characters in the lower-cased text (A-Z only), without dots or hyphens at their ends.
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    name: str
    shingles: tuple[str, ...]
    width: int

    @property
    def size_class(self) -> int:
        s = 1
        while s < len(self.shingles):
            s *= 2
        return s


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def template(name: str, text: str) -> Template:
    """Templates of fewer than SHINGLE words are one shingle of all their words."""
    words = words_of(text)
    if not words:
        raise ValueError(f"template {name} has no words")
    width = min(SHINGLE, len(words))
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    return Template(name, tuple(dict.fromkeys(grams)), width)


def library(templates: dict[str, str] = TEMPLATES) -> list[Template]:
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return [template(n, t) for n, t in sorted(templates.items())]


def need(t: Template) -> int:
    """The least number of a template's shingles that is the asked share."""
    return -(-round(SHARE * 100) * len(t.shingles) // 100)


def anchors(t: Template) -> list[list[str]]:
    """Groups of words: a text that holds the asked share of the template holds all words of some group.

    Runs of up to three neighbouring shingles give a group of the words that they share, those
    with most letters first, until so many shingles have a group that the others are too few.
    """
    runs = [t.shingles[i : i + 3] for i in range(0, len(t.shingles), 3)]
    shared = [(sorted(set.intersection(*(set(x.split()) for x in run)), key=lambda w: (-len(w), w)), len(run)) for run in runs]
    shared.sort(key=lambda x: (-sum(map(len, x[0])), x[0]))
    out, covered = [], 0
    for words, n in shared:
        if covered > len(t.shingles) - need(t):
            break
        out.append(words)
        covered += n
    return out


def holds_anchor(text: Column, found: list[Template]) -> Column:
    """Whether a text holds all words of some group, whatever their case. It is put into lower case once, as an array's only element."""

    def any_group(low: Column) -> Column:
        any_of = F.lit(False)
        for group in sorted({tuple(g) for t in found for g in anchors(t)}):
            every = F.lit(True)
            for word in group:
                every = every & F.contains(low, F.lit(word))
            any_of = any_of | every
        return any_of

    return F.exists(F.array(F.lower(text)), any_group)


def bands_of(found: list[Template]) -> dict[tuple[int, int], int]:
    """Bands by (width, size class)."""
    least: dict[tuple[int, int], float] = {}
    for t in found:
        s = t.size_class
        least[t.width, s] = min(least.get((t.width, s), 1.0), need(t) / (2 * s + len(t.shingles) - need(t)))
    return {k: math.ceil(math.log(1.0 - MEETS) / math.log1p(-j)) for k, j in least.items()}


def band_keys(shingles: Column, bands: Column) -> Column:
    """One key a band: the band's number with the least of its hashes over the hashed shingles."""
    seeds = F.sequence(F.lit(0), bands - 1)
    return F.transform(seeds, lambda b: F.xxhash64(b, F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, b)))))


def hashed(one: Column, width: int) -> Column:
    """Hashes of the runs of `width` words, in order, from the words' hashes; none for fewer words."""
    chained = one
    for k in range(1, width):
        n = F.greatest(F.size(one) - k, F.lit(0))
        chained = F.zip_with(F.slice(chained, F.lit(1), n), F.slice(one, F.lit(k + 1), n), lambda x, y: F.xxhash64(x, y))
    return chained


def windows(words: DataFrame, found: list[Template]) -> DataFrame:
    """(row, width, step, bands, at, grams): the windows of every class that hold some group's longest word, with their shingles' hashes, from (row, words)."""
    widths = sorted({t.width for t in found})
    longest = sorted({g[0] for t in found for g in anchors(t)})
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(longest))
    one = words.filter(F.size("words") > 0).select("__license_row", F.transform("words", lambda w: F.xxhash64(w)).alias("__one"), places.alias("places"))
    every = one.select("__license_row", "places", *[hashed(F.col("__one"), w).alias(f"__h{w}") for w in widths])
    kinds = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(s).alias("step"), F.lit(n).alias("bands"), F.col(f"__h{w}").alias("hashes")) for (w, s), n in sorted(bands_of(found).items())])
    placed = every.select("__license_row", "places", F.explode(kinds).alias("kind")).select("__license_row", "places", "kind.*").filter(F.size("hashes") > 0)
    step, last = F.col("step"), F.floor((F.size("hashes") - 1) / F.col("step")).cast("int")
    first = lambda p: F.greatest(F.lit(0), F.ceil((p - 2 * step - F.col("width") + 2) / step).cast("int"))
    until = lambda p: F.least(F.floor(p / step).cast("int"), last)
    near = F.transform("places", lambda p: F.when(first(p) <= until(p), F.sequence(first(p), until(p))).otherwise(F.array().cast("array<int>")))
    cut = F.transform(F.array_distinct(F.flatten(near)), lambda w: F.struct((w * step).alias("at"), F.slice("hashes", w * step + 1, 2 * step).alias("grams")))
    return placed.select("__license_row", "width", "step", "bands", F.explode(cut).alias("w")).select("__license_row", "width", "step", "bands", "w.at", "w.grams")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """docs with `licenses`, the sorted names of the templates whose shingles a window holds to the share asked for.

    Null and empty texts hold none, an empty table stays empty, and very long texts are cut into
    windows like others. Repeated rows are scanned each; a column named licenses is replaced. Only
    rows that hold an anchor are cut into windows; the template tables are as small as
    MOST_TEMPLATES allows.
    """
    found, spark = library(templates), docs.sparkSession
    none = F.array().cast("array<string>")
    if not found:
        return docs.drop("licenses").withColumn("licenses", none)
    low = F.translate(text_of(), UPPER, LOWER)
    row = F.struct(F.col("doc_id"), F.xxhash64(text_of()).alias("hash"))
    maybe = docs.filter(holds_anchor(text_of(), found)).select(row.alias("__license_row"), low.alias("text"))
    words = maybe.select("__license_row", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    count = bands_of(found)
    named = [(t.name, t.width, t.size_class, count[t.width, t.size_class], [x.split() for x in t.shingles]) for t in found]
    table = spark.createDataFrame(named, "name string, width int, step int, bands int, words array<array<string>>")
    keys = F.lit(None).cast("array<bigint>")
    for width in sorted({t.width for t in found}):
        keys = F.when(F.col("width") == width, F.transform("words", lambda x: F.get(hashed(F.transform(x, lambda w: F.xxhash64(w)), width), F.lit(0)))).otherwise(keys)  # noqa: B023
    bands = table.select("name", "width", "step", "bands", keys.alias("hashes")).withColumn("band", F.explode(band_keys(F.col("hashes"), F.col("bands")))).drop("hashes", "bands")
    keyed = windows(words, found).select("__license_row", "width", "step", "at", F.explode(band_keys(F.col("grams"), F.col("bands"))).alias("band"))
    met = keyed.join(F.broadcast(bands), ["width", "step", "band"]).groupBy("__license_row").agg(F.collect_set(F.struct("at", "name")).alias("met"))
    entries = [x for t in found for x in (F.lit(t.name), F.struct(F.lit(t.width).alias("width"), F.lit(t.size_class).alias("step"), F.lit(need(t)).alias("need"), F.array(*map(F.lit, t.shingles)).alias("shingles")))]
    known = F.create_map(*entries)

    def held(m: Column) -> Column:
        t = F.element_at(known, m["name"])
        last = F.least(F.size("words") - t["width"], m["at"] + 2 * t["step"] - 1)
        grams = F.transform(F.sequence(m["at"], last), lambda i: F.array_join(F.slice("words", i + 1, t["width"]), " "))
        return F.size(F.array_intersect(grams, t["shingles"])) >= t["need"]

    names = F.array_sort(F.array_distinct(F.transform(F.filter("met", held), lambda m: m["name"])))
    # the words of what the bands met are cut again after the join: texts are a fraction of their words in size
    again = maybe.join(met, "__license_row").withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    verified = again.select("__license_row", names.alias("licenses")).dropDuplicates(["__license_row"])
    joined = docs.drop("licenses").withColumn("__license_key", row).join(verified, F.col("__license_key").eqNullSafe(F.col("__license_row")), "left")
    return joined.withColumn("licenses", F.coalesce("licenses", none)).drop("__license_row", "__license_key")


def report(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


def oracle_sql() -> str:
    """DuckDB SQL for report(): exact containment in every window, without bands."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    found = library()
    rows = ", ".join(f"({quote(t.name)}, {quote(g)}, {t.width}, {t.size_class}, {need(t)})" for t in found for g in t.shingles)
    widths = " union all ".join(
        f"select doc_id, {w} as width, unnest(list_transform(generate_series(1, len(w) - {w - 1}), lambda i: {{'place': i - 1, 'gram': array_to_string(w[i:i + {w - 1}], ' ')}})) as x from d"
        for w in sorted({t.width for t in found})
    )
    return f"""
with t(name, gram, width, step, need) as (values {rows}),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from documents),
g as (select doc_id, width, x.place as place, x.gram as gram from ({widths})),
h as (select g.doc_id, t.name, t.need, t.gram, unnest([place // step, place // step - 1]) as win from g join t using (gram, width)),
m as (select doc_id, name from h where win >= 0 group by doc_id, name, need, win having count(distinct gram) >= need),
n as (select doc_id, count(distinct name)::bigint as n, string_agg(distinct name, ',' order by name) as names from m group by doc_id)
select documents.doc_id, coalesce(n.n, 0)::bigint as n_licenses, coalesce(n.names, '') as licenses from documents left join n using (doc_id)"""
