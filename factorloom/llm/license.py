"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Units of a text are its lines, its paragraphs and the text as a whole.  A unit's cosine to a template runs over TF-IDF weights
whose document frequencies are counted over all documents (for the words of the templates; any other word has the
greatest weight, as it only lengthens a unit's vector).  A text's own license is the best unit at or
above MIN_COSINE.  A file is a license file if it is named like one or is as a whole close to a template; it speaks
for its directory.  Paths without a license of their own inherit from the nearest ancestor directory that has one: distinct
directories are expanded to their ancestors and joined by path, so a hot directory is one row.

No unit is skipped unseen: a unit without any of the telling words, chosen so that the other words cannot reach
MIN_COSINE with any template (Cauchy-Schwarz), is below the threshold by proof.

Defined results.  NULL and empty texts have no license of their own.  NULL path: no directory, nothing to inherit.  Ties: the higher
cosine, then the template name, then the path that sorts first.  Repeated rows are reported as often as they come.
Empty table: no rows.  Extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import map_rows, pick
from factorloom.session import stored

MIN_COSINE = 0.6
FILE_NAME = r"(?i)^(un)?(licen[cs]e|copying|copyright|notice)([-.][\w.-]*)?$"
WORD = re.compile(r"[^\W_]+")

#: Notices as they stand in file headers and at the head of license files.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE file in the project root for full license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def document_frequencies(docs: DataFrame, words: frozenset[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and in how many of them each template word occurs."""

    def count(texts: list) -> Iterable[tuple]:
        n = Counter()
        for text in texts:
            n.update(words.intersection(words_of(text)))
        yield None, len(texts)
        yield from n.items()

    rows = map_rows(docs.select("text"), count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row per template word
    found = {r["word"]: r["n"] for r in rows}
    return found.pop(None, 0), found


class Matcher:
    """Templates as unit vectors, and the telling words."""

    def __init__(self, total: int, frequency: dict[str, int], templates: tuple = TEMPLATES) -> None:
        self.rare = math.log(total + 1) + 1
        vocabulary = {w for _, t in templates for w in words_of(t)}
        self.idf = {w: math.log((total + 1) / (frequency.get(w, 0) + 1)) + 1 for w in vocabulary}
        self.vectors = []
        telling: set[str] = set()
        for name, text in templates:
            weights = {w: n * self.idf[w] for w, n in Counter(words_of(text)).items()}
            norm = math.sqrt(sum(x * x for x in weights.values()))
            vector = {w: x / norm for w, x in weights.items()}
            self.vectors.append((name, vector))
            left = sum(x * x for w, x in vector.items() if w not in telling)
            for w, x in sorted(vector.items(), key=lambda p: (-p[1], p[0])):
                if left < 0.99 * MIN_COSINE**2:
                    break
                if w not in telling:
                    telling.add(w)
                    left -= x * x
        self.telling = frozenset(telling)

    def tells(self, unit: str) -> bool:
        """Whether a lower-case unit has any telling word: one set lookup per word."""
        return not self.telling.isdisjoint(WORD.findall(unit))

    def best(self, unit: str) -> tuple[float, str]:
        """(cosine, template name) of the closest template."""
        counts = Counter(words_of(unit))
        norm = math.sqrt(sum((n * self.idf.get(w, self.rare)) ** 2 for w, n in counts.items()))
        if not norm:
            return 0.0, ""
        scored = [(sum(x * counts[w] * self.idf[w] for w, x in v.items() if w in counts) / norm, name) for name, v in self.vectors]
        return min(scored, key=lambda s: (-s[0], s[1]))

    def scan(self, text: str | None) -> tuple[str | None, float, float]:
        """(license, cosine of the best unit, cosine of the text as a whole)."""
        low = (text or "").lower()
        if not self.tells(low):
            return None, 0.0, 0.0
        units = [*low.split("\n"), *re.split(r"\n\s*\n", low)]
        found = [self.best(u) for u in units if self.tells(u)]
        whole = self.best(low)
        score, name = min([*found, whole], key=lambda s: (-s[0], s[1]))
        return (name, score, whole[0]) if score >= MIN_COSINE else (None, score, whole[0])


def scan_licenses(files: DataFrame) -> DataFrame:
    """(doc_id, path, text) to doc_id, path, license, cosine, origin (own, inherited, none), license_path."""
    rows = pick(files, doc_id="doc_id", path="path", text="text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    vocabulary = frozenset(w for _, t in TEMPLATES for w in words_of(t))
    total, frequency = document_frequencies(rows, vocabulary)
    matchers: list[Matcher] = []

    def run(ids: list, paths: list, texts: list) -> Iterable[tuple]:
        if not matchers:
            matchers.append(Matcher(total, frequency))
        return ((i, p, *matchers[0].scan(t)) for i, p, t in zip(ids, paths, texts))

    own = map_rows(rows, run, f"doc_id {kind}, path string, own string, cosine double, whole double")
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), "")
    own = stored(own.withColumn("dir", parent), "licenses")
    named = F.col("path").rlike("/") & F.regexp_extract("path", "[^/]*$", 0).rlike(FILE_NAME)
    is_file = F.col("own").isNotNull() & (named | F.col("path").rlike(FILE_NAME) | (F.col("whole") >= MIN_COSINE))
    best = F.min(F.struct((-F.col("cosine")).alias("minus"), "own", "path")).alias("best")
    speaks = own.where(is_file & F.col("dir").isNotNull()).groupBy("dir").agg(best)
    places = own.select("dir").where("dir is not null").distinct()
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("up")))
    stairs = places.select("dir", F.explode(above).alias("s")).select("dir", "s.depth", "s.up")
    joined = stairs.join(speaks.select(F.array_join(F.filter(F.split("dir", "/"), lambda p: p != ""), "/").alias("up"), "best"), "up")
    nearest = joined.groupBy("dir").agg(F.min(F.struct((-F.col("depth")).alias("far"), "best")).alias("n")).select("dir", "n.best")
    out = own.join(nearest.withColumnRenamed("dir", "at"), F.col("dir") == F.col("at"), "left")
    return out.select(
        "doc_id", "path", F.coalesce("own", "best.own").alias("license"), F.when(F.col("own").isNotNull(), F.col("cosine")).otherwise(-F.col("best.minus")).alias("cosine"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("best").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("own").isNotNull(), F.col("path")).otherwise(F.col("best.path")).alias("license_path"),
    )
