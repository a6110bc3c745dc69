"""License scans: MinHash bands over overlapping text windows, in DataFrame functions only.

A text's words are hashed to shingles of five words. A template of s shingles is found where
2s consecutive shingles, starting anywhere, hold `containment` of its distinct shingles: words may
be put into it while that share is left, up to s of them. It is looked for in windows of 3s shingles that start at every
multiple of s, so that any 2s consecutive shingles lie in one window. Window and template are
compared by bands of minimum hashes; `band_count` gives as many bands as make a window that
holds `containment` of the template collide with probability 1 - `miss` at least. Only windows
that hold a shingle of some template can share a minimum with one, so the others are passed
over: two bit tables of the templates' shingles tell them. Windows that collide are verified,
once each, by the exact share of the template's shingles in the 2s shingles from each place of
their first s that holds one of them; no other start has more.

The scan is a map over the documents with broadcasts of the templates, whose number is a
parameter of the caller; only the best window of a document and license is aggregated.

Contract of `scan`: words are [a-z0-9]+ of the lower-cased text. A template of fewer than
five words is one shingle of all its words. Null and empty texts match nothing. Very long
texts are scanned whole. Rows that repeat a key are one document. Of several places the one
with most of the template, then the first, is reported: a shingle of the template stands there. Without documents or templates there are no rows. Other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# License notices in the wording of their publishers.
NOTICES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
    "except in compliance with the License. You may obtain a copy of the License at",
    "mit-short": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
    "or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
    "of the MPL was not distributed with this file, You can obtain one at",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

SHINGLE = 5
_TABLE_WORDS = 256


def band_count(similarity: float, rows: int, miss: float) -> int:
    """Bands of `rows` minimum hashes that sets of this similarity miss with probability `miss` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))


def least_similarity(containment: float) -> float:
    """Jaccard similarity of a template of s shingles and a window of 3s that holds this share of it."""
    return containment / (4 - containment)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), lambda bound: use(bound)), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def shingles(found: Column, size: int) -> Column:
    """Hashes of all runs of `size` words; none if there are fewer."""
    n = F.size(found)
    hashed = F.transform(
        F.sequence(F.lit(1), n - size + 1),
        lambda i: F.xxhash64(*[F.element_at(found, i + k) for k in range(size)]),
    )
    return F.when(n >= size, hashed).otherwise(F.array().cast("array<bigint>"))


def _bits(hashes: list[int], shift: int) -> list[int]:
    """A table of 64-bit words with the bit of each hash set."""
    table = [0] * _TABLE_WORDS
    for h in hashes:
        h >>= shift
        table[h % _TABLE_WORDS] |= 1 << (h // _TABLE_WORDS) % 64
    return [x - (1 << 64) if x >> 63 else x for x in table]


def _is_set(table: Column, h: Column, shift: int) -> Column:
    h = F.shiftright(h, shift) if shift else h
    word = F.element_at(table, (F.pmod(h, F.lit(_TABLE_WORDS)) + 1).cast("int"))
    place = F.pmod(F.shiftright(h, 8), F.lit(64))
    return F.call_function("getbit", word, place.cast("int")) == 1


def _windows(h: Column, sizes: list[int], table: list[tuple[list[int], int]], shingle: int) -> Column:
    """Candidate windows of one text: shingle length, template size, first place, shingles in their order."""
    place = F.array_compact(
        F.transform(
            h, lambda x, i: F.when(
                _is_set(F.lit(table[0][0]).cast("array<bigint>"), x, table[0][1])
                & _is_set(F.lit(table[1][0]).cast("array<bigint>"), x, table[1][1]), i.cast("long")
            )
        )
    )
    numbered = F.array(*[F.lit(s).cast("long") for s in sizes])
    # One long for each window: the number of its size is kept in the last places.
    many = F.lit(len(sizes))
    coded = F.array_distinct(F.flatten(F.transform(place, lambda i: F.flatten(F.transform(
        numbered, lambda s, c: _let(
            F.floor(i / s), lambda k: F.transform(F.sequence(F.greatest(k - 2, F.lit(0)), k), lambda own: own * many + c)
        )
    )))))
    return F.transform(coded, lambda code: _let(
        F.element_at(numbered, (code % many + 1).cast("int")), lambda s: F.struct(
            F.lit(shingle).alias("shingle"), s.cast("int").alias("size"),
            (F.floor(code / many) * s).alias("first"),
            F.slice(h, (F.floor(code / many) * s + 1).cast("int"), (3 * s).cast("int")).alias("held"),
        )
    ))


def _signature(held: Column, bands: int, rows: int) -> Column:
    """A key for each band: its minimum hashes, hashed together."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.aggregate(
            F.sequence(F.lit(0), F.lit(rows - 1)), F.lit(0).cast("long"),
            lambda key, r: F.xxhash64(key, F.array_min(F.transform(held, lambda x: F.xxhash64(x, b * rows + r)))),
        ),
    )


def _best_start(held: Column, wanted: Column, size: Column, first: Column) -> Column:
    """(less, first): share of the wanted shingles from the best start in the window, negated, and its place."""
    starts = F.array_compact(F.transform(
        F.slice(held, F.lit(1), size), lambda x, i: F.when(F.array_contains(wanted, x), i)
    ))
    return F.array_min(F.transform(starts, lambda i: F.struct(
        (-F.size(F.array_intersect(F.slice(held, i + 1, 2 * size), wanted)) / F.size(wanted)).alias("less"),
        (first + i).alias("first"),
    )))


def templates(spark: SparkSession, notices: dict[str, str], shingle: int = SHINGLE) -> DataFrame:
    """(license, shingle, size, wanted): distinct shingles of each notice."""
    rows = spark.createDataFrame(sorted(notices.items()), "license string, text string")
    found = rows.select("license", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = F.when(F.size("w") >= shingle, shingles(F.col("w"), shingle))
    for k in range(1, shingle):
        cut = cut.when(F.size("w") == k, shingles(F.col("w"), k))
    return found.select(
        "license", F.least(F.size("w"), F.lit(shingle)).alias("shingle"), cut.alias("h")
    ).select("license", "shingle", F.size("h").alias("size"), F.array_distinct("h").alias("wanted"))


def scan(
    docs: DataFrame, notices: dict[str, str], key: str = "doc_id", text: str = "text", containment: float = 0.8,
    shingle: int = SHINGLE, rows: int = 1, miss: float = 1e-6,
) -> DataFrame:
    """(key, license, containment, first_word): the best place of each document and license found in it."""
    spark = docs.sparkSession
    known = templates(spark, notices, shingle)
    held = known.collect()
    bands = band_count(least_similarity(containment), rows, miss)
    kinds = sorted({r["shingle"] for r in held})

    def windows(w: Column) -> Column:
        found = []
        for kind in kinds:
            own = [r for r in held if r["shingle"] == kind]
            hashes = [h for r in own for h in r["wanted"]]
            tables = [(_bits(hashes, shift), shift) for shift in (0, 20)]
            sizes = sorted({r["size"] for r in own})
            found.append(_let(shingles(w, kind), partial(_windows, sizes=sizes, table=tables, shingle=kind)))
        return F.concat(*found)

    if not held:
        return docs.select(
            F.col(key), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("first_word")
        ).where(F.lit(False))
    # An outer explode: a filter on the windows would be moved below and compute them twice.
    candidates = docs.select(
        F.col(key).alias("key"), F.explode_outer(_let(words(F.col(text)), windows)).alias("window")
    ).where(F.col("window").isNotNull())
    signed = candidates.select("key", "window.*", _signature(F.col("window.held"), bands, rows).alias("signature")).select(
        "*", F.posexplode("signature").alias("band", "value")
    )
    wanted = known.withColumn("wanted_signature", _signature(F.col("wanted"), bands, rows)).select(
        "*", F.posexplode("wanted_signature").alias("band", "value")
    )
    # A window and a template that collide in several bands are verified for the first of them.
    equal = F.zip_with("signature", "wanted_signature", lambda a, b: a == b)
    verified = signed.join(F.broadcast(wanted), ["shingle", "size", "band", "value"]).where(
        F.array_position(equal, True) == F.col("band") + 1
    ).select("key", "license", _best_start(F.col("held"), F.col("wanted"), F.col("size"), F.col("first")).alias("best"))
    found = verified.where(F.col("best.less") <= -containment)
    return found.groupBy("key", "license").agg(F.min("best").alias("best")).select(
        F.col("key").alias(key), "license", (-F.col("best.less")).alias("containment"), F.col("best.first").alias("first_word")
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in `documents`: at least 0.8 of a notice's s five-word shingles among 2s consecutive ones."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), NOTICES)
