"""License scans in DataFrame operations only: MinHash bands over overlapping
text windows retrieve templates, exact shingle containment verifies them.

Texts become words (letters and digits, lower case) and 5-word shingles. A
template of t shingles is looked for in windows of 2s shingles that start every
s, s being the least power of two with s >= 1.25 t; so every run of up to 1.25 t
shingles lies whole in some window. A contained template then has a Jaccard
similarity of at least 0.8 / 5.2 = 0.154 with that window, and `BANDS` = 64
bands of one row meet with probability 1 - 0.846**64 > 0.9999
(`collision_probability`).

With one row a band, a window can only meet a template in a band if it holds
the very shingle that is the template's minimum there. So sketches are computed
for exactly the windows that hold one of these shingles (templates x bands at
most); for all others no band could meet. Retrieved pairs are verified on the
shingles' words: at least 0.8 of the template's shingles lie in the window.

Defined cases: NULL, empty and short texts (under five words) hold no license;
each repeated row gets its own result; ties between templates are all reported,
by name; an empty table gives an empty table; extra columns aren't read. Whole
texts are scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, texts

SHINGLE, CONTAINED, BANDS = 5, 0.8, 64

# Notices of public licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                         "with the License. You may obtain a copy of the License at",
    "apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
                           "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
                           "specific language governing permissions and limitations under the License.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                          "following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                      "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
                      "version.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                      "documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def collision_probability(similarity: float, bands: int = BANDS, rows: int = 1) -> float:
    return 1 - (1 - similarity ** rows) ** bands


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(w: Column) -> Column:
    """64-bit hash of each shingle of an array of words (none: empty)."""
    places = F.when(F.size(w) >= SHINGLE, F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(SHINGLE)]))


def shingle_texts(w: Column) -> Column:
    places = F.when(F.size(w) >= SHINGLE, F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(w, i, F.lit(SHINGLE)), " "))


def sketch(hashes: Column, bands: int = BANDS) -> Column:
    """array<struct<band, least>>: the smallest salted hash per band."""
    def least(b: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(b))))

    return F.array(*[F.struct(F.lit(b).alias("band"), least(b).alias("least")) for b in range(bands)])


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    """(template, shingles, hashes, step): one row per template, from literals."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("template"), F.lit(v).alias("text")) for k, v in (templates or TEMPLATES).items()]))
    t = spark.range(1).select(each.alias("t")).select("t.template", words(F.col("t.text")).alias("w"))
    t = t.select("template", F.array_distinct(shingle_texts(F.col("w"))).alias("shingles"), F.array_distinct(shingle_hashes(F.col("w"))).alias("hashes"))
    step = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("shingles") * 1.25))).cast("int")
    return t.where(F.size("shingles") > 0).withColumn("step", step)


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    templates: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """((row, doc_id) of every document; (row, template, containment, first_word) of every match)."""
    spark = docs.sparkSession
    table = template_table(spark, templates)
    # templates x bands rows at most
    mins = table.select(F.explode("hashes").alias("h"), "template").select("template", "h", F.explode(F.array(
        *[F.struct(F.lit(b).alias("band"), F.xxhash64("h", F.lit(b)).alias("least")) for b in range(BANDS)])).alias("s"))
    keys = sorted({r.h for r in mins.groupBy("template", "s.band").agg(F.min_by("h", "s.least").alias("h")).select("h").distinct().collect()})
    steps = sorted({r.step for r in table.select("step").distinct().collect()})
    names = F.array(*[F.lit(k) for k in keys]).cast("array<bigint>")
    t = texts(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    t = t.withColumn("h", shingle_hashes(F.col("w")))
    held = F.arrays_overlap("h", names)
    rows = materialise(t.select("row", "doc_id", F.when(held, F.col("w")).alias("w"), F.when(held, F.col("h")).alias("h")), "license-rows")
    some = rows.where("h is not null")
    at = F.filter(F.transform("h", lambda h, i: F.when(F.array_contains(names, h), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    some = some.withColumn("hits", at)
    # windows (step s): k covers shingles [k s, k s + 2 s); a hit at i lies in k = i div s and the one before
    def around(s: int) -> Column:
        def spot(k: Column) -> Column:
            return F.struct(F.lit(s).alias("step"), F.greatest(k, F.lit(0)).cast("int").alias("k"))

        return F.flatten(F.transform("hits", lambda i: F.array(spot(F.floor(i / s)), spot(F.floor(i / s) - 1))))

    spots = F.array_distinct(F.flatten(F.array(*map(around, steps))))
    windows = some.select("row", "w", "h", F.explode(spots).alias("p")).select(
        "row", "p.step", (F.col("p.step") * F.col("p.k")).alias("from"),
        F.slice("h", F.col("p.step") * F.col("p.k") + 1, 2 * F.col("p.step")).alias("h"),
        F.slice("w", F.col("p.step") * F.col("p.k") + 1, 2 * F.col("p.step") + SHINGLE - 1).alias("w"))
    bands = windows.select("row", "step", "from", "w", F.explode(sketch(F.col("h"))).alias("s")).select("row", "step", "from", "w", "s.band", "s.least")
    wanted = F.broadcast(table.select("template", "step", "shingles", F.explode(sketch(F.col("hashes"))).alias("s"))
                         .select("template", "step", "shingles", "s.band", "s.least"))  # templates x BANDS rows
    met = bands.join(wanted, ["step", "band", "least"]).dropDuplicates(["row", "step", "from", "template"])
    common = F.size(F.array_intersect(F.col("shingles"), shingle_texts(F.col("w"))))
    found = met.withColumn("containment", common / F.size("shingles")).where(F.col("containment") >= CONTAINED)
    return rows.select("row", "doc_id"), found.groupBy("row", "template").agg(
        F.max("containment").alias("containment"), F.min("from").alias("first_word"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_licenses, licenses, containment), one row per document: the
    templates it holds, by name and joined by commas, and the best containment."""
    rows, found = license_matches(docs, id_col, text_col, templates)
    by_row = found.groupBy("row").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("template")), ",").alias("licenses"),
                                      F.max("containment").alias("containment"))
    return rows.join(by_row, "row", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_licenses"),
                                                   F.coalesce("licenses", F.lit("")).alias("licenses"), "containment")
