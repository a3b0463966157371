"""License texts inside documents: MinHash bands over text windows, then exact containment.

Templates are sorted into classes by length. For each class, windows of matching length run
over a document with three quarters of overlap, so that an occurrence lies whole inside one
of them. Windows and templates whose MinHash agrees in a band are candidates, and those that
hold enough of a template's shingles are matches. Everything on the way is a built-in
expression.

A window can only agree with a template in a band if it holds the very shingle from which
the template's value in that band comes. Documents and windows without any such shingle are
left out before the values are computed; nothing that could agree is lost.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazarlytics.llm.common import computed, store

SHINGLE = 5

#: Notices and declarations by which the licenses ask to be applied.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)


def bands_for(share: float, miss: float = 1e-6) -> int:
    """One-row bands that an occurrence holding `share` of a template misses with probability
    `miss` at most. A template fills over half of its class's length, a window is a quarter
    longer than that, so their similarity is at least share / 2 over 1.25 + (1 - share) / 2."""
    similarity = share / 2 / (1.25 + (1 - share) / 2)
    return math.ceil(math.log(miss) / math.log(1 - similarity))


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.split(spaced, " ")


def shingles_of(words: Column) -> Column:
    """All runs of five words; fewer words give none."""
    return F.when(F.size(words) < SHINGLE, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1)), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))
    )


def hashes_of(words: Column) -> Column:
    return F.transform(shingles_of(words), lambda s: F.xxhash64(s))


def min_hashes(hashes: Column, bands: int) -> Column:
    """The least value of every band's hash over the shingles."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k))))


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license string, text string")


def match(docs: DataFrame, templates: DataFrame, share: float = 0.8, most_templates: int = 500) -> DataFrame:
    """doc_id, license, containment and first_word of every license a document holds.

    containment is the largest share of one template's distinct shingles within one window;
    first_word is the place, from 0, of the first window that reaches it. Templates need five
    words and are at most `most_templates`, which bounds what is broadcast and fetched.
    A document whose text is null or has fewer than five words matches nothing. Rows that
    repeat a doc_id count as one document.
    """
    bands = bands_for(share)
    listed = templates.where(F.col("text").isNotNull()).select("license", words_of(F.col("text")).alias("w"))
    listed = listed.select("license", F.array_distinct(shingles_of(F.col("w"))).alias("shingles")).where("size(shingles) > 0")
    if listed.count() > most_templates:
        raise ValueError(f"more than {most_templates} templates")
    span = F.pow(2, F.ceil(F.log2(F.size("shingles")))).cast("int")
    hashed = F.transform("shingles", lambda s: F.xxhash64(s))
    listed = store(
        listed.withColumn("span", span).withColumn("hashes", hashed).withColumn("values", min_hashes(F.col("hashes"), bands)),
        "license-templates",
    )
    keys = listed.select("span", F.posexplode("values").alias("band", "value"), "license", "shingles")
    source = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda k: F.get(
            F.filter("hashes", lambda h: F.xxhash64(h, k) == F.get(F.col("values"), k)), F.lit(0)
        ),
    )
    sources: dict[int, set[int]] = {}
    for row in listed.select("span", source.alias("s")).collect():
        sources.setdefault(row["span"], set()).update(row["s"])
    if not sources:
        sources = {1: set()}

    def known(values: set[int]) -> Column:
        return F.lit(sorted(values)) if values else F.array().cast("array<bigint>")

    hashed = computed(docs.select("doc_id", "text"), "words", words_of(F.col("text"))).drop("text")
    hashed = computed(hashed, "hashes", hashes_of(F.col("words")))
    hit = hashed.where(F.arrays_overlap("hashes", known(set().union(*sources.values()))))
    hit = store(hit, "license-documents")

    def windows(span: int, values: set[int]) -> DataFrame:
        step = max(1, span // 4)
        size = span + step - 1
        there = F.array_intersect("hashes", known(values))
        places = F.filter(
            F.sequence(F.lit(0), F.size("hashes") - 1), lambda i: F.array_contains(F.col("_there"), F.get("hashes", i))
        )
        starts = F.transform(
            F.col("_places"),
            lambda p: F.transform(
                F.sequence(F.greatest(F.lit(0), F.ceil((p - size + 1) / step)).cast("int"), F.floor(p / step).cast("int")), lambda s: s * step
            ),
        )
        rows = computed(hit, "_there", there).where(F.size("_there") > 0)
        rows = computed(rows, "_places", places).withColumn("_starts", F.array_distinct(F.flatten(starts)))
        rows = rows.select("doc_id", "words", "hashes", F.explode("_starts").alias("start"))
        return rows.select(
            "doc_id",
            F.lit(span).alias("span"),
            "start",
            F.slice("words", F.col("start") + 1, size + SHINGLE - 1).alias("words"),
            min_hashes(F.slice("hashes", F.col("start") + 1, size), bands).alias("values"),
        )

    found = reduce(DataFrame.union, [windows(*item) for item in sorted(sources.items())])
    found = found.select("doc_id", "span", "start", "words", F.posexplode("values").alias("band", "value"))
    pairs = found.join(F.broadcast(keys), ["span", "band", "value"]).dropDuplicates(["doc_id", "start", "license", "shingles", "words"])
    inside = F.size(F.array_intersect(shingles_of(F.col("words")), F.col("shingles"))) / F.size("shingles")
    sure = pairs.select("doc_id", "license", "start", inside.alias("containment")).where(F.col("containment") >= share)
    best = sure.groupBy("doc_id", "license").agg(F.max(F.struct("containment", (-F.col("start")).alias("s"))).alias("b"))
    return best.select("doc_id", "license", "b.containment", (-F.col("b.s")).alias("first_word"))
