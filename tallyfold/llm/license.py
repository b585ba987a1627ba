"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

A window is three neighbouring shingles of five words; the next one begins three
words on, so windows overlap in words.  ORDERS orders of the hashes give a window
two bands each, its least hash and its greatest one.  A table names the template
and shingle behind every hash that a template's windows can have in a band, and a
join of the bands with it retrieves templates and where they would begin.

A template's own windows agree with the text's in all bands.  Of a window that
holds only one shingle of a template, that shingle is the least or the greatest
in an order with probability 2/3, so that a template of a single shingle is missed
with probability 3 ** -ORDERS, less than one in two thousand.  Retrieved templates are
verified at the place by the share of their shingles that occur there, compared
as strings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, exploded, let, small_side, text_key

SHINGLE = 5
#: Shingles of a window.
WINDOW = 3
ORDERS = 7
CONTAINMENT = 0.8
#: A match may be so much longer than its template, as a share of it.
STRETCH = 0.25

_MASK = (1 << 64) - 1
#: A turn and a flip make one hash into ORDERS orders: other bits lead in each.
TURNS = [round(k * 64 / ORDERS) for k in range(ORDERS)]
FLIPS = [xxhash.xxh64_intdigest(b"order %d" % k) for k in range(ORDERS)]


@dataclass(frozen=True)
class Template:
    license: str
    text: str


#: License notices as their licenses word them, and short forms in common use.
TEMPLATES = [
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    Template("mit", "Released under the MIT License."),
    Template("mit", "Licensed under the MIT License."),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("gpl-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("gpl-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    Template("gpl", "You should have received a copy of the GNU General Public License along with this program."),
    Template("lgpl-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("lgpl-2.1", "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    Template("agpl-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("cc-by-4.0", "Licensed under CC BY 4.0."),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    Template("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    Template("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    Template("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission."),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("unlicense", "This is free and unencumbered software released into the public domain."),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    Template("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
]

#: Words are runs of letters, digits and other characters beyond ASCII.
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_ENDS = "".join(map(chr, range(128))).translate({k: None for k in [*range(0x30, 0x3A), *range(0x61, 0x7B)]})


def template_words(text: str) -> list[str]:
    return [w for w in re.split(_BETWEEN, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def template_shingles(text: str) -> list[str]:
    """All shingles of five words, in order; none of a shorter text."""
    words = template_words(text)
    return [" ".join(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ordered(h: Column, turn: int, flip: int) -> Column:
    turned = F.shiftleft(h, turn).bitwiseOR(F.shiftrightunsigned(h, 64 - turn)) if turn else h
    return turned.bitwiseXOR(F.lit(_signed(flip)))


def band_values(shingle: str) -> list[int]:
    """What a shingle's hash is in each order."""
    h = 42  # Spark's seed; each word's hash is the next one's seed
    for word in shingle.split(" "):
        h = xxhash.xxh64_intdigest(word.encode(), h)
    return [_signed((h << t | h >> (64 - t)) & _MASK ^ f) for t, f in zip(TURNS, FLIPS, strict=True)]


def _slack(shingles: int) -> int:
    """How far from where a template would begin and end its shingles are looked for."""
    return int(shingles * STRETCH) + WINDOW


def word_list(text: Column) -> Column:
    """A text's words; a text without any has one empty word."""
    return F.split(F.btrim(ascii_lower(text), F.lit(_ENDS)), _BETWEEN)


def retrieved(texts: DataFrame, bands: DataFrame) -> DataFrame:
    """``key, template, start``: what the bands of each window of ``texts`` (``key, text``) retrieve, once each.

    ``start`` is the shingle, up to WINDOW off, with which the template would
    begin.  ``bands`` has ``value, template, place``.
    """
    rows = texts.select("key", word_list(F.col("text")).alias("words"))
    places = F.when(F.size("words") >= SHINGLE, F.sequence(F.lit(0), F.size("words") - SHINGLE, F.lit(WINDOW)))
    windows = exploded(rows, places, "at", "key", "words")
    # The last window repeats its last shingle, which changes neither least nor greatest.
    last = F.size("words") - SHINGLE
    starts = [F.least(F.col("at") + j, last) if j else F.col("at") for j in range(WINDOW)]
    hashes = [F.xxhash64(*[F.get("words", at + k) for k in range(SHINGLE)]).alias(f"h{j}") for j, at in enumerate(starts)]
    windows = windows.select("key", "at", *hashes)
    orders = [[_ordered(F.col(f"h{j}"), t, f) for j in range(WINDOW)] for t, f in zip(TURNS, FLIPS, strict=True)]
    each = exploded(windows, F.array(*[end(*o) for o in orders for end in (F.least, F.greatest)]), "value", "key", "at")
    return each.join(bands, "value").select("key", "template", (F.col("at") - F.col("place")).alias("start")).distinct()


def scan_licenses(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: list[Template] | None = None, containment: float = CONTAINMENT,
) -> DataFrame:
    """``doc_id`` and ``matches`` for every row of ``docs``.

    ``matches`` is ``array<struct<license, template, containment, at>>``: for each
    template found its best containment and the first word, within a few, of the
    first place with it, by the template's place in the list; a template needs
    five words.  A null or empty text, or one of fewer than five words, has none.
    Repeated rows each keep a row; other columns are not read; an empty table
    gives an empty result.  A very long text is held by one row, as its words;
    each occurrence of a template in it is verified once or a few times.

    A window is a row, and a band of it another, so that hashing and retrieval
    run in generated code; only what is retrieved is shuffled.
    """
    templates = TEMPLATES if templates is None else templates
    shingles = [template_shingles(t.text) for t in templates]
    if not all(shingles):
        raise ValueError(f"a template needs {SHINGLE} words")
    spark = docs.sparkSession
    bands = [(value, number, place) for number, own in enumerate(shingles) for place, s in enumerate(own) for value in band_values(s)]
    bands = small_side(spark.createDataFrame(bands, "value bigint, template int, place int"))
    known = [(number, t.license, list(dict.fromkeys(own)), len(own), _slack(len(own))) for number, (t, own) in enumerate(zip(templates, shingles, strict=True))]
    known = small_side(spark.createDataFrame(known, "template int, license string, own array<string>, n int, slack int"))

    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(text_key(F.col(doc_id), body).alias("key"), body.alias("text"))
    asked = retrieved(texts, bands).join(known.select("template", "n", "slack"), "template")
    asked = asked.groupBy(F.col("key").alias("asked")).agg(F.collect_list(F.struct("template", "start", "n", "slack")).alias("places"))
    asked = small_side(checkpointed(asked))

    # Texts come back for documents that retrieved a template; of each place only its words go on.
    near = texts.join(asked, F.col("key") == F.col("asked")).select("key", F.struct(word_list(F.col("text")).alias("words"), "places").alias("s"))

    def around(s: Column) -> Column:
        def one(p: Column) -> Column:
            first = F.greatest(F.lit(0), p["start"] - p["slack"])
            stop = p["start"] + p["n"] + p["slack"] + SHINGLE - 1
            return F.struct(p["template"].alias("template"), F.greatest(p["start"], F.lit(0)).alias("at"), F.slice(s["words"], first + 1, F.greatest(stop - first, F.lit(0))).alias("w"))

        return F.transform(s["places"], one)

    near = exploded(near, let(F.col("s"), around), "x", "key").select("key", "x.template", "x.at", F.col("x.w").alias("w"))
    here = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - SHINGLE, F.lit(0))), lambda k: F.concat_ws(" ", *[F.get("w", k + j) for j in range(SHINGLE)]))
    share = F.size(F.array_intersect("own", here)) / F.size("own").cast("double")
    found = near.join(known, "template").select("key", "template", "license", "at", share.alias("containment")).filter(F.col("containment") >= containment)
    best = found.groupBy("key", "template", "license").agg(F.max(F.struct("containment", (-F.col("at")).alias("back"))).alias("b"))
    best = best.select("key", F.struct("license", "template", "b.containment", (-F.col("b.back")).alias("at")).alias("m"))
    by_template = lambda a, b: F.when(a["template"] < b["template"], -1).when(a["template"] > b["template"], 1).otherwise(0)
    matches = best.groupBy(F.col("key").alias("found")).agg(F.array_sort(F.collect_list("m"), by_template).alias("matches"))
    matches = small_side(checkpointed(matches))
    none = F.array().cast("array<struct<license:string,template:int,containment:double,at:int>>")
    every = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(doc_id), body).alias("key"))
    return every.join(matches, F.col("key") == F.col("found"), "left").select("doc_id", F.coalesce("matches", none).alias("matches"))
