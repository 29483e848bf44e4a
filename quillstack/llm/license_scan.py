"""License scans by MinHash bands over overlapping text windows, in DataFrame operations only.

Texts are cut into windows of consecutive word shingles. Each window and each template gets ``BANDS`` keys, every one made of the
minima of ``ROWS`` hash orders over its shingles; an equal key retrieves the template, and the share of the template's shingles
that the document holds verifies it exactly. For a template the window size is between 1.25 and 1.9 times its own shingles and
windows start every eighth of a window, so a passage that holds 80 % of a template lies in a window of similarity 0.38 or more
and is retrieved with probability 1 - (1 - 0.38**2)**48 > 0.999; a verbatim one (0.53 or more) with more than 0.9999999.

A window without any shingle of a template cannot share a minimum with one, so keys are made only for windows around such
shingles: the result is that of all windows.

Scale: one scan, no exchange before the matches. Template shingles and keys go into the plan in blocks of at most ``block_shingles``;
more templates take more passes over the texts.

Defined cases: null, empty and shorter texts hold no license; templates of fewer words than a shingle are refused; rows that
repeat doc_id and text give one row for each license; equal templates are told apart by their id; an empty table gives no
rows; whole texts are scanned; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .decontaminate import _let, words_of

SHINGLE = 3
BANDS, ROWS = 48, 2
SIZES = (4, 6, 9, 14, 21, 32, 48, 72, 108, 162, 243, 365, 547, 820, 1230, 1845, 2768, 4152, 6228)
#: Customary license notices.
TEMPLATES = (
    ("mit-line", "Released under the MIT License."),
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
)


def shingles_of(words: Column) -> Column:
    """A hash for every run of ``SHINGLE`` words, in order."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        count = F.greatest(F.size(h) - (SHINGLE - 1), F.lit(0))
        return F.transform(F.slice(h, F.lit(1), count), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, SHINGLE))))

    return _let(hashes, runs)


def band_keys(shingles: Column, size: Column) -> Column:
    """Keys of one window; ``size`` is its class, which the template shares. A hash order is the hashes xor a fixed mask."""
    masks = F.array(*[F.xxhash64(F.lit(f"order-{i}")) for i in range(BANDS * ROWS)])
    minima = F.transform(masks, lambda mask: F.array_min(F.transform(shingles, lambda s: s.bitwiseXOR(mask))))

    def keys(m: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(size, b, *(F.get(m, b * ROWS + r) for r in range(ROWS))))

    return _let(minima, keys)


def _template_rows(templates: DataFrame, scratch: Scratch) -> DataFrame:
    """(license_id, shingles, n, size, keys)."""
    rows = templates.select("license_id", F.array_distinct(shingles_of(words_of(F.col("text")))).alias("shingles"))
    rows = rows.withColumn("n", F.size("shingles"))
    size = reduce(lambda other, s: F.when(F.col("n") * 1.25 <= s, s).otherwise(other), reversed(SIZES), F.lit(None).cast("int"))
    rows = rows.withColumn("size", size)
    return scratch.keep(rows.withColumn("keys", band_keys(F.col("shingles"), F.col("size"))), "templates")


def scan_licenses(documents: DataFrame, templates: DataFrame | None = None, least: float = 0.8, block_shingles: int = 5000) -> DataFrame:
    """doc_id, license_id, n_shingles, n_found, containment, first_word: a row for each license that a document holds."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "licenses")
    templates = templates if templates is not None else spark.createDataFrame(list(TEMPLATES), "license_id string, text string")
    rows = _template_rows(templates, scratch)
    sizes = rows.select("license_id", "n", "size").collect()  # a row for each template
    if short := [r["license_id"] for r in sizes if not r["n"] or r["size"] is None]:
        raise ValueError(f"templates shorter than {SHINGLE} words or longer than {SIZES[-1]}: {short}")
    blocks, filled = [[]], 0
    for r in sorted(sizes, key=lambda r: (r["size"], r["license_id"])):
        if filled + r["n"] > block_shingles and blocks[-1]:
            blocks.append([])
            filled = 0
        blocks[-1].append(r)
        filled += r["n"]
    texts = documents.select("doc_id", F.xxhash64("text").alias("text_key"), shingles_of(words_of(F.col("text"))).alias("grams"))
    found = [_scan_block(texts, rows.where(F.col("license_id").isin([r["license_id"] for r in block])), sorted({r["size"] for r in block}), least) for block in blocks if block]
    hits = reduce(DataFrame.unionByName, found)
    once = hits.groupBy("doc_id", "text_key", "license_id").agg(F.first("n").alias("n_shingles"), F.first("n_found").alias("n_found"), F.min("start").alias("first_word"))
    return once.select("doc_id", "license_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.col("n_found").cast("long").alias("n_found"), (F.col("n_found") / F.col("n_shingles")).alias("containment"), F.col("first_word").cast("long").alias("first_word"))


def _scan_block(texts: DataFrame, rows: DataFrame, sizes: list[int], least: float) -> DataFrame:
    vocabulary = [r["s"] for r in rows.select(F.explode("shingles").alias("s")).distinct().collect()]  # at most block_shingles
    known = F.filter(F.transform("grams", lambda g, i: F.when(g.isin(vocabulary), i)), lambda i: i.isNotNull())
    near = texts.withColumn("places", known)  # a filter on the number of places would be pushed down and count them twice
    windows = F.array_distinct(F.flatten(F.transform("places", lambda p: F.flatten(F.array(*[_windows(p, s) for s in sizes])))))
    each = near.withColumn("window", F.explode(windows))
    size, start = F.col("window")["size"], F.col("window")["start"]
    cut = each.withColumn("cut", F.array_distinct(F.slice("grams", start + 1, size)))
    keyed = cut.select("doc_id", "text_key", "grams", start.alias("start"), F.explode(F.array_distinct(band_keys(F.col("cut"), size))).alias("key"))
    targets = F.broadcast(rows.select("license_id", "n", "shingles", F.explode("keys").alias("t_key")))
    n_found = F.size(F.array_intersect("shingles", "grams"))
    met = keyed.join(targets, F.col("key") == F.col("t_key")).select("doc_id", "text_key", "license_id", "n", "start", n_found.alias("n_found"))
    return met.where(F.col("n_found") >= F.ceil(F.col("n") * F.lit(least)))


def _windows(place: Column, size: int) -> Column:
    """The windows of a size that hold a place: their starts are multiples of the stride."""
    stride = max(1, size // 8)
    low = F.greatest(F.lit(0), F.ceil((place - (size - 1)) / F.lit(stride))).cast("int")
    high = F.floor(place / F.lit(stride)).cast("int")
    return F.transform(F.sequence(low, high), lambda w: F.struct(F.lit(size).alias("size"), (w * stride).alias("start")))
