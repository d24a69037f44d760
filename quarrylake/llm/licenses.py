"""License scan: MinHash bands over overlapping word windows, then exact containment.

A template of m words is looked for in windows of m words that overlap by all
but an eighth of their length, so that one window always covers at least 15/16
of an embedded template.  Windows and templates are sets of 5-word shingles
(shorter templates: their whole sequence); a window is retrieved when one of
``BANDS`` bands of ``ROWS`` MinHash values equals the template's.  Containment
0.8 in a window as long as the template means a Jaccard similarity of at least
0.8 / 1.2 = 0.67, where the bands collide with probability
1 - (1 - 0.67**2)**24 > 0.999999.  Retrieved pairs are verified by exact shingle
containment of at least ``CONTAINMENT``.

Only windows with an anchor word are built.  A template's anchors are chosen so
that fewer than 0.8 of its shingles are free of them; a window without any
anchor cannot reach the containment, so nothing is lost.

The template table is fixed and small, so it is broadcast.  Everything is a
Spark SQL expression over whole texts.

Defined cases: a null or empty text has no match; ties of containment go to the
longer template, then the smaller id, then the shorter extent; matches whose exact
extents (first to last shingle found) overlap keep the best one;
repeated rows (equal doc_id and text) are reported once; an empty table gives no
rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
BANDS, ROWS = 24, 2
NOT_WORD = r"[^\p{L}\p{N}]+"

# Statements and notices of public licenses, by SPDX-style id.
TEMPLATES = {
    "MIT/statement": "Released under the MIT License.",
    "MIT/licensed": "Licensed under the MIT License.",
    "MIT/notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MIT/disclaimer": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "Apache-2.0/statement": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-2.0/statement": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0/statement": "This work is licensed under the GNU General Public License, version 3.",
    "GPL/notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "BSD/redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."
    ),
    "ISC/notice": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0/statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/statement": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0/short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/short": "Licensed under CC BY 4.0.",
    "Unlicense/notice": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software."
    ),
}


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def template_shingles(words: list[str]) -> list[str]:
    n = min(SHINGLE, len(words))
    return list(dict.fromkeys(" ".join(words[i : i + n]) for i in range(len(words) - n + 1)))


def anchors(shingles: list[str]) -> set[str]:
    """Longest words first until fewer than ``CONTAINMENT`` of the shingles are free of them."""
    chosen: set[str] = set()
    for w in sorted({w for s in shingles for w in s.split()}, key=lambda w: (-len(w), w)):
        if sum(chosen.isdisjoint(s.split()) for s in shingles) < CONTAINMENT * len(shingles):
            break
        chosen.add(w)
    return chosen


def _bands(shingles: Column) -> Column:
    """Keys of the MinHash bands of a shingle set."""
    h = F.transform(shingles, lambda s: F.xxhash64(s))

    def least(seed: int) -> Column:
        # one argument only: a second one would be the element's index
        return F.array_min(F.transform(h, lambda x: F.xxhash64(x, F.lit(seed))))

    keys = [F.xxhash64(F.lit(b), *[least(b * ROWS + r) for r in range(ROWS)]) for b in range(BANDS)]
    return F.array(*keys)


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per match: doc_id, template, start and n_words (word positions),
    n_shingles of the template found there, and containment."""
    spark = docs.sparkSession
    split = {t: template_words(x) for t, x in (TEMPLATES if templates is None else templates).items()}
    shingles = {t: template_shingles(w) for t, w in split.items() if w}
    lengths = sorted({len(split[t]) for t in shingles})
    words_of = {m: sorted(set().union(*(anchors(s) for t, s in shingles.items() if len(split[t]) == m))) for m in lengths}
    schema = "template string, m int, t_shingles array<string>"
    known = spark.createDataFrame([(t, len(split[t]), s) for t, s in shingles.items()], schema)
    known = known.withColumn("band", F.explode(_bands(F.col("t_shingles"))))

    every = sorted(set().union(*words_of.values()))
    rows = docs.where("text is not null").select("doc_id", "text").where(F.lower("text").rlike("|".join(every)))
    words = F.filter(F.split(F.lower("text"), NOT_WORD), lambda w: w != "")
    rows = rows.select("doc_id", F.xxhash64("text").alias("row_key"), words.alias("words"))
    rows = rows.withColumn("hits", F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(every)))

    def starts(m: int) -> Column:
        step = max(1, m // 8)
        last = F.greatest(F.lit(0), F.size("words") - min(m, SHINGLE))
        own = F.filter("hits", lambda x: x["w"].isin(words_of[m]))
        first = lambda x: F.greatest(F.lit(0), (F.ceil((x["i"] - m + 1) / step) * step).cast("int"))
        until = lambda x: F.least(last, (F.floor(x["i"] / step) * step).cast("int"))
        at = F.flatten(F.transform(own, lambda x: F.when(first(x) <= until(x), F.sequence(first(x), until(x), F.lit(step))).otherwise(F.expr("cast(array() as array<int>)"))))
        return F.transform(F.array_distinct(at), lambda s: F.struct(F.lit(m).alias("m"), s.alias("start")))

    rows = rows.where(F.size("hits") > 0).select("doc_id", "row_key", "words", F.explode(F.concat(*[starts(m) for m in lengths])).alias("at"))
    # the window for the bands, and one step more at either side for the verification
    step = F.greatest(F.lit(1), F.floor(F.col("at.m") / 8).cast("int"))
    left = F.least(step, F.col("at.start"))
    window = F.slice("words", F.col("at.start") + 1, F.col("at.m"))
    wide = F.slice("words", F.col("at.start") - left + 1, F.col("at.m") + left + step)
    rows = rows.select("doc_id", "row_key", "at.m", "at.start", (F.col("at.start") - left).alias("at"), window.alias("w"), wide.alias("wide"))
    n = F.least(F.lit(SHINGLE), "m")
    sh = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    rows = rows.where(F.size("w") >= n).select("doc_id", "row_key", "m", "start", "at", F.array_distinct(sh("w")).alias("shingles"), sh("wide").alias("around"))
    rows = rows.withColumn("band", F.explode(_bands(F.col("shingles"))))
    # the templates are fixed: len(TEMPLATES) * BANDS short rows
    pairs = rows.join(F.broadcast(known), ["m", "band"]).drop("band")
    # exact extent: the shortest that holds all template shingles of the wide window
    places = F.transform("t_shingles", lambda t: F.filter(F.transform("around", lambda x, i: F.when(x == t, i)), lambda i: i.isNotNull()))
    pairs = pairs.dropDuplicates(["doc_id", "row_key", "template", "m", "start"])
    pairs = pairs.withColumn("places", F.filter(places, lambda p: F.size(p) > 0)).withColumn("n", F.size("places"))
    pairs = pairs.withColumn("c", F.col("n") / F.size("t_shingles")).where(F.col("c") >= CONTAINMENT)
    pairs = pairs.withColumn("from", F.array_min(F.transform("places", F.array_max)))
    first = F.filter(F.flatten("places"), lambda p: p <= F.col("from"))
    until = lambda p: F.array_max(F.transform("places", lambda q: F.array_min(F.filter(q, lambda i: i >= p)))) + F.least(F.lit(SHINGLE), F.col("m"))
    pairs = pairs.withColumn("span", F.array_min(F.transform(first, lambda p: F.struct((until(p) - p).alias("length"), p.alias("from")))))
    start = F.col("at") + F.col("span.from")
    best = pairs.select("doc_id", "row_key", "template", "m", "n", "c", start.alias("start"), (start + F.col("span.length")).alias("end"))
    match = F.struct((-F.col("c")).alias("by"), (-F.col("m")).alias("longer"), "template", (F.col("end") - F.col("start")).alias("length"), "start", "end", "n", "c")
    found = best.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_set(match)).alias("all"))
    # best first; a match is kept unless it overlaps one kept before
    clash = lambda a, x: F.exists(a, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    none = F.filter("all", lambda x: F.lit(False))
    kept = F.aggregate("all", none, lambda a, x: F.when(clash(a, x), a).otherwise(F.concat(a, F.array(x))))
    return found.select("doc_id", F.explode(kept).alias("k")).select(
        "doc_id", "k.template", F.col("k.start").cast("long").alias("start"), (F.col("k.end") - F.col("k.start")).cast("long").alias("n_words"),
        F.col("k.n").cast("long").alias("n_shingles"), F.col("k.c").alias("containment"),
    )
