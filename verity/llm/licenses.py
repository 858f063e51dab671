"""License scans: cosine to templates, then inheritance along the directory tree.

1. Candidate segments of every whole text are the ``WINDOW`` words on either side
   of each licence cue, across lines; segments that touch are one. Templates are
   sparse TF-IDF vectors of words and word pairs, weighed by the share of all texts
   that hold them, so that weights do not grow with the corpus; any other term
   weighs as the template's terms do on average. A segment's cosine to a template
   is that of its best span of words that holds one of the template's terms that the
   fewest licences share; words around the span do not count. A text's licence is that of the template with the
   highest cosine, if it reaches ``THRESHOLD``, or the first known one that an SPDX
   identifier names (cosine 1).
2. A file without a licence of its own inherits that of the licence file in the
   nearest directory above it: its path is joined to all its ancestors, and the
   deepest one that has a licence file wins.

Defined results: null and empty texts have no licence of their own but inherit; very
long texts are read whole, and words round a cue are counted however far apart they stand;
a null path has no ancestors; of several licence files in one directory the one
with the highest cosine, then the smallest path, counts; repeated rows come back
as often as given; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verity.llm.shared import few_rows, written

THRESHOLD = 0.55
WINDOW = 40
RARE = 0.001

# FIXED VALUES: wording by which files and headers name public licences.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2"),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted",
                     "Licensed under the BSD 3-Clause License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.",),
    "proprietary": ("All rights reserved. No part may be reproduced without permission.",),
}

_CUE = re.compile(r"licen[cs]|copyright|public domain|creative commons|\bcc[ -]by\b|\bcc0\b|permission is hereby|all rights reserved|spdx|redistribution and use", re.I)
_SPDX = re.compile(r"SPDX-License-Identifier\W*:([^\n]*)", re.I)
_WORD = re.compile(r"[^\W_]+")


def terms(segment: str) -> Counter:
    words = _WORD.findall(segment.lower())
    return Counter([*words, *map(" ".join, zip(words, words[1:]))])


def segments(text: str) -> Iterator[str]:
    """``WINDOW`` words before and after each cue; segments that touch are one."""
    start = end = None
    for hit in _CUE.finditer(text):
        if end is None or hit.start() > end:
            if end is not None:
                yield text[start:end]
            before = deque((m.start() for m in _WORD.finditer(text, end or 0, hit.start())), maxlen=WINDOW)
            start = before[0] if len(before) == WINDOW else end or 0
        far = [m.end() for m in islice(_WORD.finditer(text, hit.start()), WINDOW)]
        end = max(end or 0, far[-1] if far else hit.end(), hit.end())
    if end is not None:
        yield text[start:end]


class Matcher:
    def __init__(self, templates: dict[str, tuple[str, ...]], texts: int, held: dict[str, int]) -> None:
        self.texts, self.held, self.names = texts, held, {name.lower(): name for name in templates}
        self.known: dict[tuple[str, ...], tuple[str | None, float]] = {}
        licences = Counter(t for some in templates.values() for t in {t for x in some for t in terms(x)})
        self.vectors = []
        for name, some in templates.items():
            for text in some:
                counts = terms(text)
                own = {t for t in counts if licences[t] == min(licences[t] for t in counts)}
                weights = {t: self.weight(t) for t in counts}
                norm = math.sqrt(sum((n * weights[t]) ** 2 for t, n in counts.items())) or 1.0
                self.vectors.append((name, weights, {t: n * weights[t] / norm for t, n in counts.items()}, own,
                                     sum(weights.values()) / max(len(weights), 1), 2 * len(_WORD.findall(text)) + 4))

    def weight(self, term: str) -> float:
        return math.log(1 + 1 / (self.held.get(term, 0) / max(self.texts, 1) + RARE))

    def span(self, words: list[str], pairs: list[str], vector: tuple, least: float) -> float:
        """The highest cosine of a span of the words that begins with a word of the
        template, if it is above ``least``; else ``least``."""
        _, weights, unit, own, other, longest = vector
        top = least
        for i, first in enumerate(words):
            if first not in unit:
                continue
            seen: dict[str, int] = {}
            dot = norm = 0.0
            mine = False
            for j in range(i, min(i + longest, len(words))):
                for term in (words[j], pairs[j - 1]) if j > i else (words[j],):
                    n, x = seen.get(term, 0), weights.get(term, other)
                    seen[term] = n + 1
                    norm += x * x * (2 * n + 1)
                    if term in unit:
                        dot += unit[term] * x
                        mine = mine or term in own
                if mine and words[j] in unit and dot > top * math.sqrt(norm) + 1e-12:
                    top = dot / math.sqrt(norm)
        return top

    def best(self, text: str) -> tuple[str | None, float]:
        top: tuple[str | None, float] = (None, 0.0)
        for hit in _SPDX.finditer(text):
            for named in re.findall(r"[A-Za-z0-9.-]+", hit.group(1)):
                name = self.names.get(re.sub(r"-(only|or-later)$", "", named.lower()))
                if name:
                    return name, 1.0
        for segment in segments(text):
            found = self.of_segment(tuple(_WORD.findall(segment.lower())))
            if found[1] > top[1] + 1e-12:
                top = found
        return top

    def of_segment(self, words: tuple[str, ...]) -> tuple[str | None, float]:
        if words in self.known:
            return self.known[words]
        pairs = list(map(" ".join, zip(words, words[1:])))
        held = {*words, *pairs}
        top: tuple[str | None, float] = (None, 0.0)
        for vector in self.vectors:
            # No span is nearer to the template than the part of it that the segment holds.
            if held.isdisjoint(vector[3]) or math.sqrt(sum(x * x for t, x in vector[2].items() if t in held)) <= top[1] + 1e-12:
                continue
            cosine = self.span(words, pairs, vector, top[1])
            if cosine > top[1] + 1e-12:
                top = vector[0], cosine
        if len(words) <= 4 * WINDOW and len(self.known) < 10_000:
            self.known[words] = top
        return top


def term_frequencies(texts: DataFrame, templates: dict[str, tuple[str, ...]]) -> tuple[int, dict[str, int]]:
    """How many texts there are, and how many hold each term of the templates
    (a table as long as the templates, whatever the corpus)."""
    wanted = {t for some in templates.values() for x in some for t in terms(x)}
    words = {w for t in wanted for w in t.split()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in few_rows(batches):
            for text in batch.column(0).to_pylist():
                found = _WORD.findall((text or "").lower())
                held = words.intersection(found)
                pairs = {f"{a} {b}" for a, b in zip(found, found[1:]) if a in held and b in held} if len(held) > 1 else set()
                counts.update((held | pairs) & wanted)
                counts[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "n"])

    rows = texts.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    held = {r["term"]: r["n"] for r in rows}
    return held.pop("", 0), held


def _parents(path: Column) -> Column:
    """All directories above a path, the deepest last; the root is the empty one."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("folder")))


def licensed(files: DataFrame, path: str = "path", text: str = "text", is_license_file: Column | None = None, carry: list[str] | None = None,
             templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per file: the columns of ``carry``, ``path``, ``license``, ``cosine``
    (of its own text), ``via`` (own, inherited or null) and ``license_path``.
    ``is_license_file`` marks the files whose licence holds for their directory."""
    templates = templates or TEMPLATES
    marked = F.col(f"`{path}`").rlike(r"(^|/)(LICEN[CS]E|COPYING|NOTICE)[^/]*$") if is_license_file is None else is_license_file
    read = files.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry or [])], F.col(f"`{path}`").alias("path"),
                        F.col(f"`{text}`").cast("string").alias("text"), F.coalesce(marked, F.lit(False)).alias("governs"))
    matcher = Matcher(templates, *term_frequencies(read.select("text"), templates))
    kept = [c for c in read.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            found = [matcher.best(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([n if s >= threshold else None for n, s in found], pa.string()),
                                              pa.array([s for _, s in found], pa.float64())], names=[*kept, "own", "cosine"])

    scanned = written(read.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema if f.name in kept], "own string, cosine double"])), "licences")
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    files_of = scanned.where("governs and own is not null and path is not null").groupBy(folder.alias("folder")).agg(
        F.min(F.struct((-F.col("cosine")).alias("order"), F.col("path").alias("license_path"), F.col("own").alias("license"))).alias("rule"))
    # Directories, not files, are joined to their ancestors: one row each.
    folders = scanned.where("own is null and path is not null").select(folder.alias("at")).distinct()
    above = folders.select("at", F.explode(_parents(F.concat("at", F.lit("/x")))).alias("up")).select("at", F.col("up.depth").alias("depth"), F.col("up.folder").alias("folder"))
    above = above.where("at <> '' or folder = ''").distinct()
    nearest = above.join(files_of, "folder").groupBy("at").agg(F.max_by("rule", "depth").alias("rule"))
    told = scanned.withColumn("at", F.when(F.col("own").isNull(), folder)).join(nearest, "at", "left")
    out = told.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry or [])], "path", F.coalesce("own", "rule.license").alias("license"), "cosine",
                      F.when(F.col("own").isNotNull(), "own").when(F.col("rule").isNotNull(), "inherited").alias("via"),
                      F.coalesce(F.when(F.col("own").isNotNull(), F.col("path")), F.col("rule.license_path")).alias("license_path"))
    return out
