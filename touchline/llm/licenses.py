"""License scan: sparse TF-IDF cosine of header lines and licence files to templates, then inheritance from the nearest ancestor directory."""
from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import cut, table
from touchline.llm.registry import query

#: Least cosine to a template for a line, a block of lines or a whole file.
COSINE = 0.6
#: Public notices of common licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software "
            "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
                "either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Consecutive lines are also scored together, since notices are wrapped.
MOST_LINES = 8
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)(\.[a-z]+)?$"
_TERM = re.compile(r"[a-z]+(?:-[a-z]+)*|\d+(?:\.\d+)*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


VOCABULARY = frozenset(w for _, t in TEMPLATES for w in terms(t))


class Matcher:
    """Template vectors with the document frequencies of a corpus; other words weigh as if one document had them."""

    def __init__(self, df: dict[str, int], documents: int, cosine: float = COSINE):
        self.cosine, self.rare = cosine, float(np.log((1 + documents) / 2) + 1)
        self.idf = {w: float(np.log((1 + documents) / (1 + df.get(w, 0))) + 1) for w in VOCABULARY}
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        needed = set()
        for k, (_, t) in enumerate(TEMPLATES):
            v = {w: n * self.idf[w] for w, n in Counter(terms(t)).items()}
            norm = float(np.sqrt(sum(x * x for x in v.values())))
            light = 0.0  # terms whose joint share of the norm stays below the threshold cannot reach it alone
            for w, x in sorted(v.items(), key=lambda p: (p[1], p[0])):
                self.by_term.setdefault(w, []).append((k, x / norm))
                light += (x / norm) ** 2
                if light >= cosine ** 2:
                    needed.add(w)
        self.needed = frozenset(needed)

    def best(self, counts: Counter) -> tuple[float, int]:
        """Largest cosine and its template (the first of equals)."""
        dots, norm = [0.0] * len(TEMPLATES), 0.0
        for w, n in counts.items():
            x = n * self.idf.get(w, self.rare)
            norm += x * x
            for k, y in self.by_term.get(w, ()):
                dots[k] += x * y
        k = int(np.argmax(dots))
        return (dots[k] / norm ** 0.5 if norm else 0.0), k

    def scan(self, text: str | None) -> tuple[str | None, float, bool, bool]:
        """(licence, cosine, in the first line, the whole file): the best match of the whole file and of all runs of lines that can reach the threshold."""
        text = text or ""
        counts = Counter(terms(text))
        if self.needed.isdisjoint(counts):
            return None, 0.0, False, False
        whole, k = self.best(counts)
        best = (whole, TEMPLATES[k][0], False, True) if whole >= self.cosine else (0.0, None, False, False)
        lines = [Counter(terms(x)) for x in text.split("\n")]
        open_ = [i for i, c in enumerate(lines) if not self.needed.isdisjoint(c)]
        seen = set()
        for i in open_:
            for first in range(max(0, i - MOST_LINES + 1), i + 1):
                run = Counter()
                for last in range(first, min(len(lines), first + MOST_LINES)):
                    run.update(lines[last])
                    if last < i or (first, last) in seen:
                        continue
                    seen.add((first, last))
                    x, k = self.best(run)
                    if x >= self.cosine and x > best[0] + 1e-12:
                        best = (x, TEMPLATES[k][0], first == 0, best[3])
        return best[1], best[0], best[2], best[3]


def matcher(files: DataFrame, cosine: float = COSINE) -> Matcher:
    """Document frequencies of the template words over all files; counts are summed per batch before the shuffle, and only template words reach the driver."""
    def count(batches):
        for b in batches:
            held = Counter()
            for t in b["text"]:
                held.update(VOCABULARY & set(terms(t or "")))
            held[""] = len(b)
            yield pd.DataFrame({"term": list(held), "n": list(held.values())})

    found = {r[0]: r[1] for r in files.select("text").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n")).collect()}
    return Matcher(found, found.get("", 0), cosine)


def own_licenses(files: DataFrame, cosine: float = COSINE) -> DataFrame:
    """files (path, text, ...) with own_license, own_cosine, heads_file and whole_file; the text is dropped. Null, empty and unlicensed texts have a null licence."""
    m = matcher(files, cosine)

    @F.pandas_udf("struct<own_license string, own_cosine double, heads_file boolean, whole_file boolean>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([m.scan(t) for t in texts], columns=["own_license", "own_cosine", "heads_file", "whole_file"])

    return files.withColumn("_l", scan("text")).select(*[c for c in files.columns if c != "text"], "_l.*")


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(files: DataFrame) -> DataFrame:
    """files (path, own_license, own_cosine, heads_file, whole_file, ...) with `license` and `inherited_from`.

    A licence file (by its name, by its whole text, or with the notice in its first line) speaks for its directory; of several the one with the largest cosine, then the
    first path, does. A file without an own licence takes that of the nearest directory above it that has one (its own directory first).
    Each different directory is joined with the few that speak, by all of its ancestors; then the files are joined by their directory, so a
    large directory is one row in the search. Files with a null path keep only their own licence.
    """
    files = cut(files.withColumn("_dir", _parent(F.col("path"))))
    speaks = files.where(F.col("own_license").isNotNull() & F.col("path").isNotNull() & (F.col("whole_file") | F.col("heads_file") | F.regexp_like("path", F.lit(FILE_NAME))))
    voices = speaks.groupBy(F.col("_dir").alias("_above")).agg(F.min(F.struct((-F.col("own_cosine")).alias("c"), "path", "own_license")).alias("v")).select(
        "_above", F.col("v.own_license").alias("_license"))
    dirs = files.where("_dir is not null").select("_dir").distinct()
    parts = F.split("_dir", "/")
    above = dirs.select("_dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("_above"))
    nearest = above.distinct().join(voices, "_above").groupBy("_dir").agg(F.max(F.struct(F.length("_above").alias("n"), "_above", "_license")).alias("v"))
    nearest = cut(nearest.select("_dir", F.col("v._above").alias("_from"), F.col("v._license").alias("_license")))
    out = files.join(nearest, "_dir", "left")
    lone = F.col("own_license").isNull()
    return out.withColumn("license", F.coalesce("own_license", "_license")).withColumn("inherited_from", F.when(lone, F.col("_from"))).drop("_dir", "_from", "_license")


def as_files(docs: DataFrame) -> DataFrame:
    """The documents table as a tree: source / language / two levels of a hundred and ten documents / number."""
    dir_ = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")),
                       F.floor(F.col("doc_id") / 1000).cast("string"), (F.floor(F.col("doc_id") / 100) % 10).cast("string"))
    return docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.concat(dir_, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")


@query("op1_licenses")
def op1_licenses(spark, sf_dir):
    found = inherit(own_licenses(as_files(table(spark, sf_dir, "documents"))))
    return found.select("doc_id", "path", "own_license", F.round("own_cosine", 6).alias("own_cosine"), "license", "inherited_from")
