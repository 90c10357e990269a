"""License notices in texts: MinHash bands over text windows retrieve templates, shingle containment verifies them.

Everything is DataFrame functions. Words are runs of ASCII letters and digits in lower case. Templates (notices, and
passages of at most 48 words of longer texts) fall in size classes a quarter apart; a text has windows of each class's
size, overlapping by steps of a sixth. Only windows that hold a *key word* (license, copyright, warranty, ...) are formed:
in every passage, more than a fifth of the shingles hold one, so a text with four fifths of a passage's shingles
has a key word in them, and no match is lost (``check_templates`` proves this for each passage of each template and fails otherwise). 24 bands
of one minimum: a window of similarity 0.3 to a passage is retrieved with probability 0.9998; the best-placed
window of a true match has 0.5 or more. Candidates are verified by the exact share of the passage's five-word shingles
in the text around the window, at least 0.8.

Result: one row for each (id, license), with the best containment and the word (from 0) at which the first shingle of such a passage stands. Near-equal
notices (two versions of one license) share most shingles; the query keeps the better one on the same words, and both if they are equal.

Defined cases: null and empty texts have no rows; a text without a notice has none; rows that repeat an id count as
one, with the notices of all their texts; rows without an id come as one of a null id; a notice repeated in a text counts once; an empty
table gives no rows; very long texts are read whole, in windows around their key words (each window once, so a
text of nothing but key words has a few windows a word); other columns are not read, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, CONTAINMENT, BANDS, PASSAGE = 5, 0.8, 24, 48
KEY = "licen[sc]|copyright|permission|warrant|redistribut|liab|unencumber|granted|software|conditions|modif"

#: Texts of public licenses' notices, as SPDX lists them, by their SPDX names.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
]


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def passages(templates=TEMPLATES) -> list[tuple[int, str, list[str]]]:
    """(number, license, words) of every template, longer ones in overlapping passages; ``check_templates`` has seen that all hold key words enough."""
    out = []
    for name, text in templates:
        words = template_words(text)
        step = PASSAGE // 2
        for at in range(0, max(1, len(words) - step), step):
            out.append((len(out), name, words[at : at + PASSAGE]))
    return out


def has_keys(words: list[str]) -> bool:
    """Whether any four fifths of the shingles hold a key word."""
    n = len(words) - SHINGLE + 1
    bare = sum(not any(re.search(KEY, w) for w in words[i : i + SHINGLE]) for i in range(n))
    return n > 0 and bare < CONTAINMENT * n


def check_templates(templates=TEMPLATES) -> None:
    for _, name, words in passages(templates):
        if not has_keys(words):
            raise ValueError(f"a passage of {name} has too few key words, add one to KEY: {' '.join(words)}")


def classes(found: list[tuple[int, str, list[str]]]) -> list[int]:
    """Window sizes, each at most a quarter above the passages it serves."""
    out: list[int] = []
    for n in sorted({len(w) for _, _, w in found}, reverse=True):
        if not out or n * 1.25 < out[-1]:
            out.append(n)
    return sorted(out)


def shingle_hashes(words):
    """Distinct hashes of five-word shingles of a column of word arrays."""
    at = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(1), F.size(words) - SHINGLE + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i, SHINGLE)))))


def bands(shingles):
    """Band keys of a column of shingle hashes: the minimum of each of BANDS hash functions."""
    least = lambda j: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(j))))
    return F.array(*[F.xxhash64(F.lit(j), least(j)) for j in range(BANDS)])


def unexplained(hits: DataFrame) -> DataFrame:
    """The hits that no better hit of another license on the same words explains. Hits are compared within cells of a text, so
    their number is bounded by a cell's windows and the templates."""
    row = ["id", "license", "passage", "start", "size", "containment"]
    cell = 4 * PASSAGE
    spread = hits.select(*row, F.size("wanted").alias("wanted"), "found", F.explode(F.array_distinct(F.transform("found", lambda x: F.floor(x["at"] / cell)))).alias("cell"))
    whole = F.struct("license", "passage", "start", "size", "containment", "wanted", "found").alias("hit")
    cells = spread.select("id", "cell", whole).groupBy("id", "cell").agg(F.collect_set("hit").alias("hits"))

    def explains(x, y):
        apart = F.filter(x["found"], lambda f: ~F.exists(y["found"], lambda g: g["at"] == f["at"]))
        alone = F.size(F.array_distinct(F.transform(apart, lambda f: f["h"])))
        return (y["license"] != x["license"]) & (y["containment"] > x["containment"]) & (alone < CONTAINMENT * x["wanted"])

    # another license's hit elsewhere in the cell takes no shingle away, so it explains nothing
    each = cells.select("id", F.explode(F.transform("hits", lambda x: F.struct(x.alias("hit"), F.exists("hits", lambda y: explains(x, y)).alias("beaten")))).alias("e"))
    each = each.select("id", "e.hit.license", "e.hit.passage", "e.hit.start", "e.hit.size", "e.hit.containment", (F.get("e.hit.found", F.lit(0))["at"] - 1).alias("first"), "e.beaten")
    return each.groupBy(*row).agg(F.max("beaten").alias("beaten"), F.min("first").alias("first")).filter(~F.col("beaten"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, best_only: bool = False) -> DataFrame:
    """(id, license, containment, first_word) of every notice found. With ``best_only``, a notice that a better one of another
    license explains is left out: without the words of the better one it has less than four fifths of its shingles."""
    check_templates(templates)
    spark: SparkSession = docs.sparkSession
    found = passages(templates)
    rows = F.array(*[F.struct(F.lit(n).alias("passage"), F.lit(name).alias("license"), F.split(F.lit(" ".join(w)), " ").alias("words")) for n, name, w in found])
    table = spark.range(1).select(F.inline(rows)).withColumn("wanted", shingle_hashes(F.col("words")))
    table = table.select("passage", "license", "wanted", F.size("words").alias("length"), F.explode(bands(F.col("wanted"))).alias("band"))

    sizes = F.array(*[F.struct(F.lit(n).alias("size"), F.lit(max(1, (n - SHINGLE + 1) // 6)).alias("step")) for n in classes(found)])
    texts = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("low")).filter(F.regexp_like("low", F.lit(KEY)))
    words = texts.select("id", F.filter(F.split("low", "[^a-z0-9]+"), lambda w: w != "").alias("words"))
    words = words.filter(F.size("words") >= SHINGLE).withColumn("keys", F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.regexp_like(F.get("words", i), F.lit(KEY))))
    # each window is formed for the first key word in it only; outer, as Spark would else test the size of ``keys`` before it has ``words``
    keys = words.select("id", "words", "keys", F.posexplode_outer("keys").alias("nth", "key")).filter("key is not null").withColumn("last", F.coalesce(F.get("keys", F.col("nth") - 1), F.lit(-1)))
    # only what a passage around the key word can reach goes on
    low = F.greatest(F.lit(0), F.col("key") - 2 * PASSAGE)
    near = keys.select("id", "key", "last", low.alias("low"), F.slice("words", low + 1, 4 * PASSAGE).alias("region"))
    spans = near.select("*", F.explode(sizes).alias("c"))
    first = F.ceil(F.greatest(F.col("last") + 1, F.col("key") - F.col("c.size") + 1) / F.col("c.step")) * F.col("c.step")
    starts = F.when(first <= F.col("key"), F.sequence(first.cast("int"), F.col("key"), F.col("c.step"))).otherwise(F.array().cast("array<int>"))
    windows = spans.select("id", "low", "region", F.col("c.size").alias("size"), F.explode(starts).alias("start"))
    windows = windows.withColumn("shingles", shingle_hashes(F.slice("region", F.col("start") - F.col("low") + 1, F.col("size")))).filter(F.size("shingles") > 0)
    keyed = windows.select("id", "low", "region", "start", "size", F.explode(bands(F.col("shingles"))).alias("band"))
    # the templates are a fixed list, so their side is bounded and broadcast
    hits = keyed.join(F.broadcast(table), "band").filter((F.col("length") <= F.col("size")) & (F.col("length") * 1.25 >= F.col("size")))
    around = F.slice("region", F.greatest(F.lit(1), F.col("start") - F.col("low") + 1 - F.col("size")), 3 * F.col("size"))
    texts_too = ["id", "text", "start", "size", "passage"]
    hits = hits.select("id", F.xxhash64("region", "low").alias("text"), "low", "region", "start", "size", "passage", "license", "wanted").dropDuplicates(texts_too)
    share = F.size(F.array_intersect("wanted", shingle_hashes(around))) / F.size("wanted")
    checked = hits.withColumn("containment", share).filter(F.col("containment") >= CONTAINMENT)
    # where the shingles of the hits that remain stand
    base = F.greatest(F.lit(0), F.col("start") - F.col("size"))
    found = F.transform(F.sequence(F.lit(1), F.size(around) - SHINGLE + 1), lambda i: F.struct((base + i).alias("at"), F.xxhash64(F.concat_ws(" ", F.slice(around, i, SHINGLE))).alias("h")))
    if best_only:
        checked = unexplained(checked.withColumn("found", F.filter(found, lambda x: F.array_contains("wanted", x.h))))
    else:
        checked = checked.withColumn("first", F.array_min(F.transform(F.filter(found, lambda x: F.array_contains("wanted", x.h)), lambda x: x["at"])) - 1)
    out = checked.groupBy("id", "license").agg(F.max("containment").alias("containment"), F.min("first").cast("long").alias("first_word"))
    return out.withColumnRenamed("id", id_col)


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), best_only=True)
