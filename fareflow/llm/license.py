"""License scans: sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor directory.

A text's segments (lines, paragraphs, the whole) are compared with licence templates by the cosine of TF-IDF vectors; word
frequencies come from all documents. A segment without any of a template's telling words can't reach the threshold (the
template's other words are too light), so only texts with such a word are vectorised. A file that is a licence as a whole, or
is named like one, is the licence of its directory; a file without a licence of its own takes that of its nearest ancestor
directory by a join on paths.

Defined results: a null or blank text has no licence of its own; a null path has no directory and inherits nothing; of equally
similar templates the first by name counts; of several licence files in a directory the most similar, then the first by path;
each row is judged by its own text: rows with a null or a repeated file id are scanned alike and never share a licence; an empty table stays empty; texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareflow.llm.common import table
from fareflow.scale import checkpointed

THRESHOLD = 0.8
LICENSE_NAME = r"(?i)^(licen[sc]e|copying|unlicense|notice)([.\-_].*)?$"

# Notices by which licences are commonly stated.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC0-1.0": ["Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "ISC": ["Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "Proprietary": ["All rights reserved. Unauthorized copying of this file is strictly prohibited."],
}
_TOKEN = re.compile(r"[a-z0-9]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


class Templates:
    """Unit TF-IDF vectors of the templates; a word outside of them weighs as the rarest."""

    def __init__(self, frequency: dict[str, int], documents: int, templates: dict[str, list[str]] = TEMPLATES):
        self.idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) + 1
                    for texts in templates.values() for t in texts for w in tokens(t)}
        self.other = math.log(documents + 1) + 1
        self.vectors = []
        for name in sorted(templates):
            for text in templates[name]:
                v = {w: n * self.idf[w] for w, n in Counter(tokens(text)).items()}
                norm = math.sqrt(sum(x * x for x in v.values()))
                self.vectors.append((name, {w: x / norm for w, x in v.items()}))

    def telling(self, threshold: float) -> list[str]:
        """Words of which a segment has at least one if it reaches the threshold with any template."""
        out = set()
        for _, v in self.vectors:
            rest = 1.0
            for w, x in sorted(v.items(), key=lambda i: (-i[1], i[0])):
                if rest < threshold * threshold - 1e-9:
                    break
                out.add(w)
                rest -= x * x
        return sorted(out)

    def best(self, segment: str) -> tuple[float, str | None]:
        counts = Counter(tokens(segment))
        norm = math.sqrt(sum((n * self.idf.get(w, self.other)) ** 2 for w, n in counts.items()))
        if not norm:
            return 0.0, None
        value, name = 0.0, None
        for label, v in self.vectors:
            dot = sum(x * counts[w] * self.idf[w] for w, x in v.items() if w in counts) / norm
            if dot > value + 1e-12:
                value, name = dot, label
        return value, name


def corpus_frequencies(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> tuple[dict[str, int], int]:
    """In how many documents each word of the templates stands, over all of them; a table of the templates' size."""
    vocabulary = sorted({w for texts in templates.values() for t in texts for w in tokens(t)})
    words = F.array_intersect(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"), F.array(*[F.lit(w) for w in vocabulary]))
    counted = files.select(words.alias("w")).select(F.explode_outer(F.array_union("w", F.array(F.lit(" all")))).alias("w"))
    found = {r["w"]: r["count"] for r in counted.groupBy("w").count().collect()}
    return found, found.pop(" all", 0)


def own_licenses(files: DataFrame, model: Templates, threshold: float = THRESHOLD) -> DataFrame:
    """file, path, license, similarity and whole (the text as a whole reaches the threshold) of files with one."""
    pattern = r"(?i)\b(" + "|".join(model.telling(threshold)) + r")\b"
    kind = dict(files.dtypes)["file"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        likely = re.compile(pattern)
        for b in batches:
            out = []
            for file, path, text in zip(b["file"], b["path"], b["text"], strict=True):
                whole, name = model.best(text)
                best, label = (whole, name)
                for segment in [*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text)]:
                    if likely.search(segment):
                        value, found = model.best(segment)
                        if value > best + 1e-12:
                            best, label = value, found
                if best >= threshold:
                    out.append((file, path, label, round(best, 6), whole >= threshold))
            yield pd.DataFrame(out, columns=["file", "path", "license", "similarity", "whole"])

    likely = files.where(F.col("text").rlike(pattern)).select("file", "path", "text")
    return likely.mapInPandas(rows, f"file {kind}, path string, license string, similarity double, whole boolean")


def directory_of(path):
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """file, license, similarity, how (header, file, inherited or none) and license_dir for each row of ``files``.

    ``files``: file (an id), path, text. Directories are joined, not files: each directory looks for its nearest licensed
    ancestor once.
    """
    # Each row has a key of its own, so rows with a null or a repeated file id never take each other's licence.
    files = checkpointed(files.select(F.monotonically_increasing_id().alias("__row"), "file",
                                      F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text")))
    model = Templates(*corpus_frequencies(files))
    own = checkpointed(own_licenses(files.select(F.col("__row").alias("file"), "path", "text"), model, threshold))
    named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENSE_NAME)
    licensed = own.where(F.col("path").isNotNull() & (F.col("whole") | named)).withColumn("dir", directory_of(F.col("path")))
    best = F.min_by(F.struct("license", "similarity"), F.struct((-F.col("similarity")).alias("s"), F.col("path")))
    holds = checkpointed(licensed.groupBy("dir").agg(best.alias("b")).select("dir", "b.license", "b.similarity"))
    directories = files.where(F.col("path").isNotNull()).select(directory_of(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(
        n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))
    nearest = (directories.select("dir", F.inline(up)).join(holds.withColumnRenamed("dir", "above"), "above")
               .groupBy("dir").agg(F.max_by(F.struct("above", "license", "similarity"), "depth").alias("from")))
    given = own.groupBy(F.col("file").alias("__row")).agg(F.min_by(F.struct("license", "similarity", "whole"), F.struct(
        (-F.col("similarity")).alias("s"), F.col("license"))).alias("own"))
    every = files.select("__row", "file", "path").withColumn("dir", directory_of(F.col("path")))
    joined = every.join(given, "__row", "left").join(nearest, "dir", "left")
    how = (F.when(F.col("own.whole"), "file").when(F.col("own").isNotNull(), "header")
           .when(F.col("from").isNotNull(), "inherited").otherwise("none"))
    return joined.select("file", F.coalesce("own.license", "from.license").alias("license"),
                         F.coalesce("own.similarity", "from.similarity").alias("similarity"), how.alias("how"),
                         F.when(F.col("own").isNull(), F.col("from.above")).alias("license_dir"))


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document as a file source/lang/doc_id with its licence."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs.select(F.col("doc_id").alias("file"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"),
                            "text")).withColumnRenamed("file", "doc_id")
