"""License scan: sparse TF-IDF cosine of lines and paragraphs to templates, then inheritance from ancestor directories."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.sizing import small_table
from .common import plain_text, written

#: Customary wordings of licence notices and the opening of licence files, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "MIT License Copyright (c)",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}
#: Reserved rights, a match like a licence; next to a licence in the same file they are its customary copyright line.
RESERVED = "LicenseRef-Proprietary"
TEMPLATES[RESERVED] = ("All rights reserved.", "Copyright (c). All rights reserved.")
THRESHOLD = 0.75
#: File names that hold a directory's licence.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying)([.-].*)?$"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Terms without weight (fixed values).
STOP_TERMS = "a an and are as at be by for from in is it may not of on or that the this to under with you".split()


def _terms(text: str) -> list[str]:
    return [t for t in re.findall(TERM, text.lower()) if t not in STOP_TERMS]


class Weights:
    """TF-IDF weights of the templates; a term that no template has weighs as the rarest."""

    def __init__(self, templates: Mapping[str, Sequence[str]] = TEMPLATES):
        texts = [(name, i, Counter(_terms(text))) for name, all_ in templates.items() for i, text in enumerate(all_)]
        found = Counter(term for _, _, terms in texts for term in terms)
        self.idf = {term: math.log((1 + len(texts)) / (1 + n)) + 1 for term, n in found.items()}
        self.unseen = math.log(1 + len(texts)) + 1
        self.rows = []
        for name, i, terms in texts:
            norm = math.sqrt(sum((n * self.idf[term]) ** 2 for term, n in terms.items()))
            self.rows += [(name, i, term, n * self.idf[term] / norm) for term, n in sorted(terms.items())]

    def anchors(self, threshold: float) -> list[str]:
        """Terms of which every text at or above the threshold must have one.

        Per template the weightiest terms, until those left have a norm under the threshold: a text with
        none of the anchors cannot reach it, by the Cauchy-Schwarz inequality.
        """
        chosen: set[str] = set()
        for key in {(name, i) for name, i, _, _ in self.rows}:
            own = sorted(((w, term) for name, i, term, w in self.rows if (name, i) == key), reverse=True)
            rest = sum(w * w for w, term in own if term not in chosen)
            for w, term in own:
                if rest < (threshold * 0.999) ** 2:
                    break
                if term not in chosen:
                    chosen.add(term)
                    rest -= w * w
        return sorted(chosen)


def matches(files: DataFrame, threshold: float = THRESHOLD, templates: Mapping[str, Sequence[str]] = TEMPLATES) -> DataFrame:
    """path, license, score: the best template for each path with a line or paragraph at or above the threshold.

    Whole texts are searched. Only lines and paragraphs with an anchor term are taken apart into terms; that
    loses none. Ties go to the first identifier; reserved rights count only where nothing else
    matches. Null and empty texts match nothing; rows repeated under one path count as one file with all their lines.
    """
    spark, weights = files.sparkSession, Weights(templates)
    anchors = "|".join(map(re.escape, weights.anchors(threshold)))
    loose = rf"(?i)(?<![a-z0-9])(?:{anchors})(?![a-z0-9])"
    text = plain_text()
    parts = F.concat(F.split(text, r"\n"), F.split(text, r"\n[ \t\r]*\n"))
    lines = (
        files.filter(text.rlike(loose))
        .select("path", F.explode(F.array_distinct(F.filter(parts, lambda part: part.rlike(loose)))).alias("part"))
        .select("path", F.xxhash64("part").alias("line"), F.regexp_extract_all(F.lower("part"), F.lit(TERM), F.lit(0)).alias("terms"))
        .dropDuplicates(["path", "line"])
    )
    counted = lines.select("path", "line", F.explode("terms").alias("term")).filter(~F.col("term").isin(STOP_TERMS)).groupBy("path", "line", "term").count()
    known = small_table(spark, sorted(weights.idf.items()), ["term", "idf"])
    own = F.coalesce("idf", F.lit(weights.unseen)) * F.col("count")
    weighted = counted.join(F.broadcast(known), "term", "left").select("path", "line", "term", own.alias("weight"))
    lengths = weighted.groupBy("path", "line").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    against = small_table(spark, weights.rows, ["license", "variant", "term", "share"])
    dots = (
        weighted.join(F.broadcast(against), "term")
        .groupBy("path", "line", "license", "variant")
        .agg(F.sum(F.col("weight") * F.col("share")).alias("dot"))
    )
    scored = dots.join(lengths, ["path", "line"]).select("path", "license", F.round(F.col("dot") / F.col("length"), 6).alias("score"))
    return (
        scored.filter(F.col("score") >= threshold)
        .groupBy("path")
        .agg(F.min(F.struct((F.col("license") == RESERVED).alias("last"), (-F.col("score")).alias("order"), "license")).alias("best"))
        .select("path", F.col("best.license").alias("license"), (-F.col("best.order")).alias("score"))
    )


def directory(path: Column) -> Column:
    """The directory of a path without the last slash; empty at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """All directories above a path from the nearest to the top, as an array."""
    steps = F.split(directory(path), "/")
    at = lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/")
    above = F.transform(F.sequence(F.size(steps), F.lit(1), F.lit(-1)), at)
    return F.array_distinct(F.concat(above, F.array(F.lit(""))))


def scanned(files: DataFrame, threshold: float = THRESHOLD, templates: Mapping[str, Sequence[str]] = TEMPLATES) -> DataFrame:
    """The files with own_license, own_score, inherited_license, inherited_from and license.

    A file without a licence of its own takes that of the nearest ancestor directory whose licence file matched
    (the best scoring one, then the first by path); ``license`` is null if there is none. The join is by
    directory: files are first folded to their directories, and each directory looks up its ancestors.
    A file with a null path keeps the licence of its own text and inherits nothing. Columns of the added names are replaced.
    """
    unplaced = F.concat(F.lit("\0"), F.md5(plain_text()))  # no path: the text stands for itself
    keyed = files.withColumn("__file", F.coalesce("path", unplaced))
    found = written(matches(keyed.select(F.col("__file").alias("path"), "text"), threshold, templates), "license-matches")
    name = F.regexp_extract("path", r"[^/]*$", 0)
    holders = (
        found.filter(name.rlike(LICENSE_FILE))
        .groupBy(directory(F.col("path")).alias("above"))
        .agg(F.min(F.struct((-F.col("score")).alias("order"), "path", "license")).alias("top"))
        .select("above", F.col("top.license").alias("inherited_license"))
    )
    folders = files.filter(F.col("path").isNotNull()).select(directory(F.col("path")).alias("folder")).distinct()
    nearest = (
        folders.select("folder", F.posexplode(ancestors(F.concat("folder", F.lit("/x")))).alias("steps", "above"))
        .join(holders, "above")
        .groupBy("folder")
        .agg(F.min(F.struct("steps", "above", "inherited_license")).alias("n"))
        .select("folder", F.col("n.above").alias("inherited_from"), F.col("n.inherited_license").alias("inherited_license"))
    )
    own = found.select(F.col("path").alias("__file"), F.col("license").alias("own_license"), F.col("score").alias("own_score"))
    added = ("own_license", "own_score", "inherited_from", "inherited_license", "license")
    kept = keyed.select("__file", *(c for c in files.columns if c not in added)).withColumn("__folder", directory(F.col("path")))
    nearest = nearest.withColumnRenamed("folder", "__folder")
    joined = kept.join(own, "__file", "left").join(nearest, "__folder", "left").drop("__folder", "__file")
    return joined.withColumn("license", F.coalesce("own_license", "inherited_license"))


#: Documents in a lowest folder of the tree, and lowest folders in a middle one.
IN_FOLDER = 100
IN_MIDDLE = 20


def as_files(documents: DataFrame) -> DataFrame:
    """The documents as files of a tree by source and id: doc_id, path, text.

    Every tenth is a licence file. These stand at all depths, one in four each at the top of the source, in a middle
    folder and in two of the lowest; all other files are in the lowest folders. A null id has a null path.
    """
    id_, number = F.col("doc_id"), F.col("doc_id").cast("string")
    holds = id_ % 10 == 0
    depth = F.when(holds, F.pmod(F.floor(id_ / 10), F.lit(4))).otherwise(3)
    name = F.when(holds, F.concat(F.lit("LICENSE."), number)).otherwise(F.concat(number, F.lit(".txt")))
    middle = F.when(depth > 0, F.floor(id_ / (IN_FOLDER * IN_MIDDLE)).cast("string"))
    lowest = F.when(depth > 1, F.floor(id_ / IN_FOLDER).cast("string"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), middle, lowest, name)
    return documents.select("doc_id", F.when(id_.isNotNull(), path).alias("path"), "text")
