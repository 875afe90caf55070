"""License scans: MinHash bands over overlapping text windows, DataFrame
functions only.

Templates are grouped by length; a group with templates of up to M words
looks at windows of M + M/2 words, M/2 apart, so that every span of M words
lies inside one. A window that holds the share ``containment`` of a template's
five-word shingles has a Jaccard similarity with it of at least some J that
follows from the lengths (0.2 or more for every group), so ``bands`` bands
of one minimum each collide with probability 1 - (1 - J)^bands, over 0.999999
for 64. Collisions only retrieve; the exact shingle containment decides.

A window without any template shingle cannot match. A few anchor words are
chosen from the templates such that no match can do without all of them, so
texts and windows without an anchor word are left out before any hashing; this
loses nothing. The templates' band keys are a small table by construction
(templates x bands rows) and are broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 5
# fixed values: license notices and the opening grants or conditions of common licenses
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
           "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
           "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                  "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
           "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
           "above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
               "this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words(text: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[^\W_]+", text)]


def shingles(w: list[str]) -> set[str]:
    return {" ".join(w[i: i + WIDTH]) for i in range(len(w) - WIDTH + 1)}


def anchors(templates: Mapping[str, str], containment: float) -> list[str]:
    """Words one of which every match holds: so many shingles of each template
    contain one that fewer are without than a match needs. Long words first,
    as these are rare in other texts."""
    out: list[str] = []
    for text in templates.values():
        left = shingles(words(text))
        need = math.ceil(containment * len(left) - 1e-9)
        left = {s for s in left if not set(out) & set(s.split())}
        while len(left) >= need:
            weight = Counter(w for s in left for w in set(s.split()))
            out.append(max(weight, key=lambda w: (min(len(w), 7), weight[w], w)))
            left = {s for s in left if out[-1] not in s.split()}
    return out


def groups(templates: Mapping[str, str]) -> dict[int, list[str]]:
    """Template names by the M of their group."""
    out: dict[int, list[str]] = {}
    for name, text in templates.items():
        n = len(words(text))
        if n < WIDTH:
            raise ValueError(f"template {name!r} has fewer than {WIDTH} words")
        out.setdefault(max(6, 6 * 2 ** math.ceil(math.log2(n / 6))), []).append(name)
    return out


def least_similarity(m: int, n: int, containment: float) -> float:
    """The least Jaccard similarity of a matching window and a template of
    ``n`` words in the group ``m``."""
    t, w = n - WIDTH + 1, m + m // 2 - WIDTH + 1
    need = math.ceil(containment * t - 1e-9)
    return need / (w + t - need)


def _word_list(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.lower(w))


def _shingle_list(w: Column) -> Column:
    n = F.size(w) - WIDTH + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws(" ", F.slice(w, i, WIDTH))))).otherwise(
        F.array().cast("array<string>"))


def _minima(s: Column, bands: int) -> Column:
    """Band keys: the smallest hash of the set under each of ``bands`` seeds."""
    def smallest(seed: int) -> Column:
        return F.array_min(F.transform(s, lambda x: F.xxhash64(x, F.lit(seed))))

    return F.array(*[F.xxhash64(F.lit(k), smallest(k)) for k in range(bands)])


def _windows(starts: Column, m: int, size: int, anchor: Column) -> Column:
    """The windows of a group, from the words ``w``, that hold an anchor word."""
    every = F.transform(starts, lambda at: F.struct(F.lit(m).alias("m"), at.alias("at"), F.slice(F.col("w"), at + 1, size).alias("w")))
    return F.filter(every, lambda x: F.arrays_overlap(x["w"], anchor))


def scan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] = TEMPLATES,
    containment: float = 0.8, bands: int = 64,
) -> DataFrame:
    """One row per document and template found in it: ``doc_id, license,
    containment`` (the largest over its windows, 0 to 1), ``first_word`` (where
    the first window with a match begins, from 0), ``n_words`` of the
    document.

    Words are runs of letters and digits, lowered. A template is found in a
    window that holds at least ``containment`` of its distinct five-word
    shingles. A NULL or empty text and one without a match give no row; rows
    that repeat an id are scanned each and give one row per id and template;
    each row without an id gives its own (``doc_id`` NULL).
    Texts are read whole; other columns are ignored.
    """
    spark = docs.sparkSession
    keys = anchors(templates, containment)
    some = "(?iu)(?<![\\p{L}\\p{N}])(?:" + "|".join(keys) + ")(?![\\p{L}\\p{N}])"
    # rows without an id are told apart by their place
    place = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    src = docs.select(F.col(id_col).alias("doc_id"), place.alias("row"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").rlike(some))
    src = src.select("doc_id", "row", _word_list(F.col("text")).alias("w"))
    anchor = F.array(*map(F.lit, keys))
    cut, known = [], []
    for m, names in sorted(groups(templates).items()):
        size, step = m + m // 2, m // 2
        assert all(1 - (1 - least_similarity(m, len(words(templates[n])), containment)) ** bands > 0.999 for n in names)
        known += [(m, n, sorted(shingles(words(templates[n])))) for n in names]
        last = F.greatest(F.size("w") - size + step - 1, F.lit(0))
        cut.append(_windows(F.sequence(F.lit(0), last, F.lit(step)), m, size, anchor))
    # only windows with an anchor leave the row of their text
    windows = src.select("doc_id", "row", F.size("w").alias("n_words"), F.explode(F.concat(*cut)).alias("x")).select("doc_id", "row", "n_words", "x.*")
    windows = windows.select("doc_id", "row", "n_words", "m", "at", _shingle_list(F.col("w")).alias("s")).filter(F.size("s") > 0)
    known = spark.createDataFrame(known, "m int, license string, has array<string>").withColumn("key", F.explode(_minima(F.col("has"), bands)))
    hit = windows.select("*", F.explode(_minima(F.col("s"), bands)).alias("key")).join(F.broadcast(known), ["m", "key"])
    share = F.size(F.array_intersect("s", "has")) / F.size("has")
    found = hit.select("doc_id", "row", "n_words", "license", "at", share.alias("share")).filter(F.col("share") >= containment)
    return found.groupBy("doc_id", "row", "license").agg(
        F.max("share").alias("containment"), F.min("at").cast("long").alias("first_word"), F.max("n_words").cast("long").alias("n_words")).drop("row")
