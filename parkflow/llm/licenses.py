"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Column functions only. A document's words (runs of letters and digits, lower case) give shingles of five words. Windows
of shingles overlap by half and are twice to four times as long as the templates they are meant for, so one of them
holds any whole occurrence. A window's band is the minimum of its shingles under one hash function; with 64 bands of
one row, a window that holds 0.8 of a template's n shingles among at most 4n of its own (Jaccard similarity 0.8 / 4.2 =
0.190 at least) collides with it with a probability above 1 - 0.81**64 = 0.9999986. Only windows with at least one shingle of any template are hashed: others can't collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS, BANDS, CONTAINMENT = 5, 64, 0.8

#: Well-known public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT": "Released under the MIT License",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "CC-BY-4.0": "licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "licensed under CC BY-NC 4.0",
}


def shingles(text: Column) -> Column:
    """Hashes of the shingles in order; a text of one to four words is one shingle."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return _hashes(words)


def _hashes(words: Column) -> Column:
    whole = F.transform(F.sequence(F.lit(0), F.size(words) - WORDS), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)]))
    return F.when(F.size(words) >= WORDS, whole).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def bands(window: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(window, lambda x: F.xxhash64(x, b))))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, set, n, width (of the windows meant for it) and bands; as many rows as templates are given."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("notice")) for k, v in templates.items()]))
    df = spark.range(1, numPartitions=1).select(rows.alias("t")).select("t.license", F.array_distinct(shingles(F.col("t.notice"))).alias("set"))
    df = df.withColumn("n", F.size("set"))
    return df.withColumn("width", (2 * F.pow(F.lit(2), F.ceil(F.log2("n")))).cast("int")).withColumn("bands", bands(F.col("set")))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, first_word, n_found, n_template and containment: a row for each row's text and each template of
    which one window holds at least `containment` of the shingles (its best window, the earliest if several).

    Null and empty texts, and those of which no template is found, have no row. Rows of docs repeated under one
    doc_id count as one. Other columns are ignored. templates: license -> notice of at least five words.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates or TEMPLATES)
    own = known.collect()  # as many rows as templates
    known = spark.createDataFrame(own, known.schema)
    every = sorted({x for r in own for x in r["set"]})
    widths = sorted({r["width"] for r in own})
    df = docs.select("doc_id", F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("words"))
    df = df.select("doc_id", _hashes(F.col("words")).alias("shingles"))
    at = F.filter(F.sequence(F.lit(0), F.size("shingles") - 1), lambda i: F.get("shingles", i).isin(every))
    df = df.withColumn("at", F.when(F.size("shingles") > 0, at))

    def starts(width: int) -> Column:
        step = max(1, width // 2)
        near = F.transform("at", lambda i: F.array(i - i % step, i - i % step - step))
        return F.transform(F.filter(F.array_distinct(F.flatten(near)), lambda s: s >= 0), lambda s: F.struct(F.lit(width).alias("width"), s.alias("start")))

    # Outer, then without nulls: a filter on the arrays would be moved below them, and build them again for each element.
    df = df.select("doc_id", "shingles", F.explode_outer(F.concat(*[starts(w) for w in widths])).alias("w")).filter("w is not null")
    df = df.select("doc_id", "w.width", "w.start", F.array_distinct(F.slice("shingles", F.col("w.start") + 1, F.col("w.width"))).alias("window"))
    df = df.withColumn("window_bands", bands(F.col("window")))
    met = df.join(F.broadcast(known), "width").filter(F.exists(F.zip_with("window_bands", "bands", lambda a, b: a == b), lambda x: x))
    met = met.withColumn("n_found", F.size(F.array_intersect("window", "set"))).filter(F.col("n_found") >= containment * F.col("n"))
    best = met.groupBy("doc_id", "license", "n").agg(F.max(F.struct("n_found", (-F.col("start")).alias("start"))).alias("best"))
    return best.select("doc_id", "license", (-F.col("best.start")).alias("first_word"), F.col("best.n_found").alias("n_found"), F.col("n").alias("n_template"), (F.col("best.n_found") / F.col("n")).alias("containment"))
