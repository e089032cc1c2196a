"""License scans by diagonal voting, in DataFrame functions only.

Each text is a sequence of words; the hashes of all its rolling word k-grams are joined to the places of the same
k-grams in the templates. A copy of a template shows as many hits on one diagonal (place in the text less place in
the template); hits are added up by diagonal, neighbouring diagonals (words put in or left out) are merged, and the
merged span is verified: the words of its hits are those of the template, it holds enough of the template's different
places, and it is not much longer than the template.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose every place counts, and their labels. Fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates of license notices, by label.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-notice", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-notice", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
K = 3
#: Places of a template in one word of the set of those that were hit.
BITS = 63


def words_of(text: Column) -> Column:
    """Words of a text in lower case (A-Z only); null: none."""
    plain = F.coalesce(text, F.lit(""))
    odd = plain.contains("\u0130") | plain.contains("\u212a")  # the only others whose lower case has an ASCII letter
    low = F.when(odd, F.translate(plain, UPPER, LOWER)).otherwise(F.lower(plain))
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def pair_hashes(words: Column) -> Column:
    """The hash of the words at i and i + 1, for each i."""
    return F.transform(F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))).alias("a"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("b")), lambda x: F.xxhash64(x["a"], x["b"]))


def skip_hashes(words: Column) -> Column:
    """The hash of the words at i and i + 2, for each i."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    return F.transform(F.arrays_zip(F.slice(words, 1, n).alias("a"), F.slice(words, 3, n).alias("b")), lambda x: F.xxhash64(x["a"], x["b"]))


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], phrases: dict[str, str]) -> DataFrame:
    """(gram, text, label, phrase, template, at, grams): a row for each k-gram of each template, and one for each phrase; ``text`` has its words."""
    rows = [(i, label, text, False) for i, (label, text) in enumerate(templates)] + [(len(templates) + i, label, text, True) for i, (text, label) in enumerate(sorted(phrases.items()))]
    named = spark.createDataFrame(rows, "template int, label string, text string, phrase boolean").withColumn("words", words_of(F.col("text")))
    paired = named.withColumn("pairs", pair_hashes(F.col("words")))
    triples = F.zip_with(F.slice("pairs", 1, F.size("pairs") - 1), F.slice("pairs", 2, F.size("pairs") - 1), lambda a, b: F.xxhash64(a, b))
    grams = F.when(F.size("words") >= K, triples).otherwise(F.col("pairs"))
    k = F.when(F.size("words") >= K, F.lit(K)).otherwise(F.lit(2))
    split = paired.select("template", "label", "phrase", "words", F.size(grams).alias("grams"), k.alias("k"), F.posexplode(grams).alias("at", "gram"))
    return split.withColumn("text", F.array_join(F.slice("words", F.col("at") + 1, F.col("k")), " ")).drop("words")


def license_spans(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, merge: int = 3, cover: float = 0.6, stretch: float = 1.5, short: int = 12) -> DataFrame:
    """A row for each document and verified span, and one with nulls for a document's words: row_id, doc_id, n_words,
    template, label, phrase, first_word, last_word, coverage. Spans of phrases are single places with coverage 1.
    A template of ``short`` k-grams or fewer must be there whole, so that notices that differ in a version are told apart;
    but its k-grams may each skip one word of the text, so that a word put in doesn't hide it."""
    spark = docs.sparkSession
    grams = template_grams(spark, TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)
    places = F.collect_list(F.struct("template", "label", "phrase", "grams", "at"))
    triple = grams.where(F.col("k") == K).groupBy("gram", "text").agg(places.alias("by_triple")).withColumnsRenamed({"gram": "triple", "text": "triple_words"})
    may_skip = grams.where((F.col("k") == K) & ~F.col("phrase") & (F.col("grams") <= short)).groupBy("gram", "text").agg(places.alias("places"))
    late, early = (may_skip.withColumnsRenamed({"gram": side, "text": f"{side}_words", "places": f"by_{side}"}) for side in ("late", "early"))
    pair = grams.where(F.col("k") == 2).groupBy("gram", "text").agg(places.alias("by_pair")).withColumnsRenamed({"gram": "pair", "text": "pair_words"})

    worded = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", words_of(F.col("text")).alias("words"))
    rest = F.greatest(F.size("words"), F.lit(1))
    hashed = worded.select("row_id", "doc_id", F.size("words").cast("long").alias("n_words"), "words", F.slice("words", 2, rest).alias("second"), F.slice("words", 3, rest).alias("third"), F.slice("words", 4, rest).alias("fourth"), pair_hashes(F.col("words")).alias("pairs"), skip_hashes(F.col("words")).alias("skips"))
    after = F.slice("pairs", 2, F.greatest(F.size("pairs"), F.lit(1)))
    both = F.zip_with("pairs", after, lambda a, b: F.struct(a.alias("pair"), F.xxhash64(a, b).alias("triple")))
    # of four words the first, second and fourth, and the first, third and fourth
    skips_after, pairs_after = F.slice("skips", 2, F.greatest(F.size("skips"), F.lit(1))), F.slice("pairs", 3, F.greatest(F.size("pairs"), F.lit(1)))
    skipping = F.zip_with(F.zip_with("pairs", skips_after, lambda a, b: F.xxhash64(a, b)), F.zip_with("skips", pairs_after, lambda a, b: F.xxhash64(a, b)), lambda a, b: F.struct(a.alias("late"), b.alias("early")))
    spoken = F.slice(F.arrays_zip(F.col("words").alias("a"), F.col("second").alias("b"), F.col("third").alias("c"), F.col("fourth").alias("d")), 1, F.size("pairs"))
    rolled = hashed.select("row_id", "doc_id", "n_words", F.posexplode_outer(F.arrays_zip(both.alias("hash"), skipping.alias("skip"), spoken.alias("said"))).alias("place", "x"))
    flat = rolled.select("row_id", "doc_id", "n_words", "place", F.col("x.hash.pair").alias("pair"), F.col("x.hash.triple").alias("triple"), F.col("x.skip.late").alias("late"), F.col("x.skip.early").alias("early"), *[F.col(f"x.said.{c}").alias(c) for c in "abcd"])
    # both tables hold the templates' k-grams: their size is that of the list above
    met = flat.join(F.broadcast(triple), "triple", "left").join(F.broadcast(pair), "pair", "left").join(F.broadcast(late), "late", "left").join(F.broadcast(early), "early", "left")
    # equal hashes are not taken for equal words
    joined = met.withColumns({
        "by_triple": F.when(F.concat_ws(" ", "a", "b", "c") == F.col("triple_words"), F.col("by_triple")),
        "by_pair": F.when(F.concat_ws(" ", "a", "b") == F.col("pair_words"), F.col("by_pair")),
        "by_late": F.when(F.concat_ws(" ", "a", "b", "d") == F.col("late_words"), F.col("by_late")),
        "by_early": F.when(F.concat_ws(" ", "a", "c", "d") == F.col("early_words"), F.col("by_early")),
    })
    first = F.coalesce(F.col("place") == 0, F.lit(True))
    found = joined.where(first | F.coalesce("by_triple", "by_pair", "by_late", "by_early").isNotNull())
    none = F.expr("cast(array() AS array<struct<template: int, label: string, phrase: boolean, grams: int, at: int>>)")
    here = F.concat(*[F.coalesce(f"by_{way}", none) for way in ("triple", "pair", "late", "early")], F.when(first, F.array(F.lit(None).cast("struct<template: int, label: string, phrase: boolean, grams: int, at: int>"))).otherwise(none))
    hits = found.select("row_id", "doc_id", "n_words", F.col("place").cast("long").alias("place"), F.explode(here).alias("hit"))
    flags = hits.select("row_id", "doc_id", "n_words", "place", F.col("hit.template").alias("template"), F.col("hit.label").alias("label"), F.col("hit.phrase").alias("phrase"), F.col("hit.grams").alias("grams"), F.col("hit.at").alias("at"))
    # a phrase's places are spans as they are; a template's hits vote by diagonal
    spot = F.when(F.col("phrase"), F.col("place"))
    diagonal = F.when(~F.col("phrase"), F.col("place") - F.col("at"))
    # the template's places that were hit, as bits of a few words
    words = range(max([len(re.split(BETWEEN, t)) for _, t in (TEMPLATES if templates is None else templates)], default=1) // BITS + 1)

    def bits(w: int) -> Column:
        return F.coalesce(F.bit_or(F.when(F.floor(F.col("at") / BITS) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % BITS))), F.lit(0).cast("long")).alias(f"hit_{w}")

    votes = flags.groupBy("row_id", "doc_id", "n_words", "template", "label", "phrase", "grams", spot.alias("spot"), diagonal.alias("diagonal")).agg(F.min("place").alias("low"), F.max("place").alias("high"), *[bits(w) for w in words])
    order = Window.partitionBy("row_id", "template").orderBy("diagonal", "low")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > merge) | F.col("phrase"), F.lit(True))
    groups = votes.withColumn("group", F.sum(new.cast("int")).over(order))
    spans = groups.groupBy("row_id", "doc_id", "n_words", "template", "label", "phrase", "grams", "group").agg(F.min("low").alias("first_word"), F.max("high").alias("last_word"), *[F.bit_or(f"hit_{w}").alias(f"hit_{w}") for w in words])
    n = sum((F.bit_count(F.col(f"hit_{w}")) for w in words), F.lit(0))
    coverage = F.when(F.col("phrase"), F.lit(1.0)).otherwise(n / F.col("grams"))
    within = F.col("last_word") - F.col("first_word") + 1 <= F.ceil(F.col("grams") * stretch) + merge
    needed = F.when(F.col("grams") <= short, F.lit(1.0)).otherwise(F.lit(cover))
    sound = F.col("template").isNull() | F.col("phrase") | ((coverage >= needed) & within)
    whole = F.col("template").isNotNull()
    return spans.where(sound).select(
        "row_id", "doc_id", "n_words", "template", "label", "phrase", F.when(whole, F.col("first_word")).alias("first_word"), F.when(whole, F.col("last_word")).alias("last_word"), F.when(whole, coverage).alias("coverage")
    )


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row.

    ``n_base`` counts all places of the phrases, ``first_word`` and ``last_word`` are their smallest and largest start
    (null: none). ``labels`` has the templates' labels besides; ``score`` is the largest coverage of a span, 1 for a
    phrase. A null or empty text has no words and empty labels; a null doc_id stays; repeated rows are scanned each;
    an empty table gives an empty result; other columns are neither read nor returned.
    """
    spans = license_spans(docs)
    base = F.col("phrase")

    def joined(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    return (
        spans.groupBy("row_id", "doc_id", "n_words")
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("first_word"))).alias("first_word"),
            F.max(F.when(base, F.col("first_word"))).alias("last_word"),
            joined(base).alias("base_labels"),
            joined(F.col("label").isNotNull()).alias("labels"),
            F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
        )
        .drop("row_id")
    )
