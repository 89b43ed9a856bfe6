"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Built-in functions only.  Texts become words (A-Z lowered, runs of 0-9 and a-z).  Documents are cut
into windows of ``WINDOW`` words every ``STRIDE`` words, so that every shingle of five words lies
whole in some window; templates into windows at every word.  A window's signature has ``BANDS``
minima, each a band of one row: a window that shares one shingle of its four with a template window
(the least a five-word notice shares) is retrieved with probability 1 - 0.75 ** 32 = 0.9999, and a
document window that lies within a verbatim copy equals some template window and always is.

A retrieved template is laid over the document where the windows met, with slack for insertions,
and kept if the region holds at least ``CONTAINMENT`` of its distinct shingles.

Templates are a stated set.  They are counted and broadcast in blocks of bounded rows; more templates
mean more passes.

Defined results: null and empty texts match nothing; templates of fewer than five words are one
shingle of all their words and match documents of those words only; rows repeating an id yield one
match per license; a null id is reported as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

SHINGLE = 5
WINDOW = 8
STRIDE = 4
BANDS = 32
CONTAINMENT = 0.8
#: Band rows of templates sent to all tasks at once: 40 bytes each.
BLOCK_ROWS = 200_000

# Short notices and standard headers of public licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words_of(text: Column) -> Column:
    tidy = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^0-9a-z]+", " "))
    return F.when(tidy == "", F.array().cast("array<string>")).otherwise(F.split(tidy, " "))


def _windows(df: DataFrame, stride: int) -> DataFrame:
    """Adds a row per window, ``at`` its first word and h0..h3 its shingle hashes; needs ``words``."""
    n = F.size("words")
    hashed = df.where(n > 0).withColumn("wh", F.transform("words", lambda w: F.xxhash64(w)))
    last = F.greatest(n - SHINGLE, F.lit(0))
    rows = hashed.withColumn("at", F.explode(F.sequence(F.lit(0), last, F.lit(stride))))
    shingle = lambda j: F.xxhash64(*[F.get("wh", F.col("at") + j + i) for i in range(SHINGLE)])
    count = WINDOW - SHINGLE + 1
    full = [shingle(0), *(F.when(F.col("at") + j + SHINGLE <= n, shingle(j)) for j in range(1, count))]
    return rows.select(*[c for c in rows.columns if c != "wh"], *[h.alias(f"h{j}") for j, h in enumerate(full)])


def _bands(windows: DataFrame) -> DataFrame:
    """A row per band of each window; ``key`` is the band's minimum (the band's number hashed in)."""
    hs = [f"h{j}" for j in range(WINDOW - SHINGLE + 1)]
    rows = windows.withColumn("band", F.explode(F.array(*[F.lit(b * 64 // BANDS) for b in range(BANDS)])))
    # The hashes are random bits already: turned by the band's bits, they sort in another order.
    turned = [F.expr(f"shiftleft({h}, band) | shiftrightunsigned({h}, 64 - band)") for h in hs]
    return rows.withColumn("key", F.least(*turned)).drop("band", *hs)


def _shingles(words: Column) -> Column:
    """Shingles in order, as strings; shorter sequences are one shingle."""
    last = F.greatest(F.size(words) - SHINGLE, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, SHINGLE), " "))


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(id, license, containment, position): each document's matches, position the number of the first
    word of the first match (from 0).  ``templates`` has license and text."""
    known = templates.select("license", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    known = known.withColumn("need", F.size("words")).withColumn("wanted", F.array_distinct(_shingles(F.col("words"))))
    rows = known.agg(F.coalesce(F.sum(F.greatest(F.col("need") - SHINGLE + 1, F.lit(1)) * BANDS), F.lit(0))).first()[0]
    blocks = max(1, -(-int(rows) // BLOCK_ROWS))
    words = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    cut = _bands(_windows(words, STRIDE))
    found = None
    for i in range(blocks):
        some = known.where(F.pmod(F.xxhash64("license"), F.lit(blocks)) == i) if blocks > 1 else known
        bands = _bands(_windows(some.select("license", "need", "words"), 1)).select("key", "license", "need", F.col("at").alias("offset")).distinct()
        start = F.greatest(F.col("at") - F.col("offset") - WINDOW, F.lit(0))
        length = F.col("need") + 2 * WINDOW + F.ceil(F.col("need") / 4).cast("int")
        met = cut.join(F.broadcast(bands), "key").select("id", "license", start.alias("start"), F.slice("words", start + 1, length).alias("region")).distinct()
        laid = met.join(F.broadcast(some.select("license", "wanted")), "license")
        laid = laid.withColumn("held", _shingles(F.col("region")))
        share = F.size(F.array_intersect("wanted", "held")) / F.size("wanted")
        first = F.array_position(F.transform("held", lambda s: F.array_contains("wanted", s)), True)
        kept = laid.withColumn("share", share).where(F.col("share") >= containment)
        kept = kept.select("id", "license", "share", (F.col("start") + first - 1).alias("start"))
        found = kept if found is None else found.unionByName(kept)
    best = found.groupBy("id", "license").agg(F.max("share").alias("containment"), F.min("start").alias("position"))
    return best


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(TEMPLATES.items()), "license string, text string")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), template_table(spark)).select(
        F.col("id").alias("doc_id"), "license", F.round("containment", 6).alias("containment"), "position"
    )
