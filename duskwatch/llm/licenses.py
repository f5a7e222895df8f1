"""Licence scan: sparse TF-IDF cosine of lines and whole files to templates, then inheritance along paths.

Header candidates are lines and, for headers that wrap, windows of two to four neighbouring lines. Only lines
that could reach the threshold by their share of template terms are looked at: what a template can add to the cosine is
at most the length of that share. Whole texts are compared with the full licence texts as well. Document frequencies
are counted over all lines. On request those of all terms are: the terms of candidates, few, are joined with the
frequencies; otherwise terms outside the templates have the weight of a term never seen. A file is a licence file if its
name says so or if the whole text is close to a template. One that is named so but fits nothing has the licence ``unknown``,
which goes down to its directory like any other. A file without a header of its own takes the licence of the
nearest directory above it that has a licence file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.components import settle
from duskwatch.llm.quality import NOT_NEWLINE
from duskwatch.llm.tokens import BYTE_CODE, LETTER, U64, Words, distinct, mix, slices

# Wordings and titles that state a licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("all-rights-reserved", "All rights reserved."),
]
# Names of licence files.
FILE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([._-][^/]*)?$"
#: Of these, names of files that only state attributions: one that fits no licence says nothing.
NOTICE_NAMES = r"(?i)(^|/)notice([._-][^/]*)?$"
UNKNOWN = "unknown"
#: Lines that a wrapped header may have.
WINDOW = 4
#: Cosines are rounded to these digits, so that equal fits are ties.
DIGITS = 12
_outside = ~(LETTER | (np.arange(256) >= 48) & (np.arange(256) <= 57))
#: Distinct terms that a task holds before it passes counts on.
HELD_TERMS = 500_000
#: Terms of candidates, or candidates, up to which their table is broadcast.
BROADCAST_TERMS = 1_000_000
#: Directories up to which the licence table is broadcast.
BROADCAST_ROWS = 100_000


def full_texts() -> list[tuple[str, str]]:
    """The full licence texts kept beside this module, by the name of their file."""
    folder = resources.files(__package__) / "licence_texts"
    return sorted((f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in folder.iterdir() if f.name.endswith(".txt"))


class TemplateSet:
    """Terms and unit vectors of the templates, short ones first, under given inverse document frequencies."""

    def __init__(self, templates: list[tuple[str, str]], texts: list[tuple[str, str]]):
        self.names = [t[0] for t in (*templates, *texts)]
        w = Words(pa.array([t[1] for t in (*templates, *texts)], pa.string()), _outside)
        self.terms, at = np.unique(w.hashes(), return_inverse=True)
        self.tf = np.zeros((len(self.terms), len(self.names)))
        np.add.at(self.tf, (at, w.doc), 1)
        self.short = len(templates)
        self.in_short = self.tf[:, : self.short].any(axis=1)

    def weigh(self, frequency: np.ndarray, lines: int) -> None:
        self.idf = np.log((1 + lines) / (1 + frequency)) + 1
        self.unknown = float(np.log(1.0 + lines) + 1)
        self.vectors = self.tf * self.idf[:, None]
        self.vectors /= np.linalg.norm(self.vectors, axis=0)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)


@dataclass
class Units:
    """Header candidates and whole texts of a slice: ``line`` is the first line, -1 for a whole text. ``outside``: their terms without a template as (unit, term, count)."""

    rows: int
    doc: np.ndarray
    line: np.ndarray
    dot: np.ndarray
    which: np.ndarray
    square: np.ndarray
    outside: tuple[np.ndarray, np.ndarray, np.ndarray]


def _counted(unit: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (unit, term) and how often."""
    order = np.lexsort((h, unit))
    unit, h = unit[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (unit[1:] != unit[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return unit[at], h[at], np.diff(np.append(at, len(h)))


def _possible(group: np.ndarray, term: np.ndarray, ours: np.ndarray, idf: np.ndarray, groups: int, threshold: float) -> np.ndarray:
    """Groups of tokens that could reach the threshold: no unit vector adds more than the length of the part it shares."""
    unit, t, n = _counted(group[ours], term[ours].astype(U64))
    weight = n * idf[t.astype(np.int64)]
    known = np.bincount(unit, weight * weight, groups)
    # no other term weighs less than 1
    other = np.bincount(group[~ours], minlength=groups)
    return (known > 0) & (known >= (threshold - 1e-9) * abs(threshold) * (known + other))


def _units(t: TemplateSet, column: pa.Array, threshold: float, always: np.ndarray) -> Units:
    w, lines, line = _lines(column)
    h = w.hashes()
    term = t.find(h)
    count = len(lines)
    header = _possible(line, term, (term >= 0) & t.in_short[term], t.idf, count, threshold)
    whole = np.flatnonzero(_possible(w.doc, term, term >= 0, t.idf, w.rows, threshold) | always & (np.bincount(w.doc[term >= 0], minlength=w.rows) > 0))
    begin = np.searchsorted(line, np.arange(count + 1))
    first, end = [], []
    for k in range(1, WINDOW + 1):
        at = np.arange(max(count - k + 1, 0))
        together = lines.doc[at] == lines.doc[at + k - 1] if len(at) else np.zeros(0, bool)
        for j in range(k):
            together = together & header[at + j]
        first.append(at[together])
        end.append(at[together] + k)
    first, end = np.concatenate(first), np.concatenate(end)
    low = np.concatenate([begin[first], w.first[whole]])
    size = np.concatenate([begin[end], w.first[whole + 1]]) - low
    units = len(size)
    ends = np.cumsum(size)
    token = np.repeat(low - ends + size, size) + np.arange(ends[-1] if units else 0)
    unit, words, n = _counted(np.repeat(np.arange(units), size), h[token])
    at = t.find(words)
    known = at >= 0
    ours, weight = unit[known], n[known] * t.idf[at[known]]
    dots = np.stack([np.bincount(ours, weight * v[at[known]], units) for v in t.vectors.T], 1)
    dots[: len(first), t.short :] = 0
    return Units(
        w.rows, np.concatenate([lines.doc[first], whole]), np.concatenate([first - lines.first[lines.doc[first]], np.full(len(whole), -1)]),
        dots.max(1, initial=0), dots.argmax(1) if dots.shape[1] else np.zeros(units, np.int64), np.bincount(ours, weight * weight, units),
        (unit[~known], words[~known], n[~known]),
    )


def _lines(column: pa.Array):
    w, lines = Words(column, _outside), Words(column, NOT_NEWLINE)
    return w, lines, np.searchsorted(lines.start, w.start, "right") - 1


def _frequencies(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        total, count = np.zeros(len(t.terms) + 1, np.int64), 0
        for batch in batches:
            text = batch.column("text").fill_null("")
            for low, high in slices(text):
                w, lines, line = _lines(text.slice(low, high - low))
                term = t.find(w.hashes())
                pair = np.unique(line[term >= 0] * len(t.terms) + term[term >= 0])
                total[:-1] += np.bincount(pair % len(t.terms), minlength=len(t.terms))
                count += len(lines)
        total[-1] = count
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["term", "n"])

    return run


def _match(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        names = np.array([*t.names, None], object)
        for batch in batches:
            text, named = batch.column("text").fill_null(""), batch.column("named").to_numpy(zero_copy_only=False)
            for low, high in slices(text):
                u = _units(t, text.slice(low, high - low), threshold, named[low:high])
                unit, _, n = u.outside
                cosine = np.round(u.dot / np.sqrt(np.maximum(u.square + np.bincount(unit, (n * t.unknown) ** 2, len(u.doc)), 1e-300)), DIGITS)
                out = []
                for part in (u.line >= 0, u.line < 0):
                    best, which, at = np.zeros(u.rows), np.full(u.rows, -1), np.full(u.rows, -1)
                    # of equal fits the first line, and the longest window, which stands last
                    order = np.flatnonzero(part)
                    order = order[np.lexsort((-order, u.line[order], -cosine[order], u.doc[order]))]
                    first = order[np.unique(u.doc[order], return_index=True)[1]]
                    best[u.doc[first]], which[u.doc[first]], at[u.doc[first]] = cosine[first], np.where(cosine[first] > 0, u.which[first], -1), u.line[first]
                    out.append((best, which, at))
                (head, name, at), (whole, whole_name, _) = out
                part = lambda c: batch.column(c).slice(low, high - low)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        part("id"), part("path"), pa.array(names[np.where(head >= threshold, name, -1)], pa.string()), pa.array(head), pa.array(at.astype(np.int32)),
                        pa.array(names[whole_name], pa.string()), pa.array(whole),
                    ],
                    ["id", "path", "header", "header_cosine", "header_line", "whole", "whole_cosine"],
                )

    return run


def _all_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, lines that hold it), partial sums; the number of lines under a null term."""
    terms, sums, held, count = [], [], 0, 0
    row = lambda term, n: pa.RecordBatch.from_arrays([term, pa.array(n, pa.int64())], ["term", "n"])

    def merged():
        term, at = np.unique(np.concatenate(terms), return_inverse=True)
        return term, np.bincount(at, np.concatenate(sums)).astype(np.int64)

    for batch in batches:
        text = batch.column("text").fill_null("")
        for low, high in slices(text):
            w, lines, line = _lines(text.slice(low, high - low))
            term, n = np.unique(distinct(line, w.hashes(), len(lines))[0], return_counts=True)
            terms.append(term)
            sums.append(n)
            held += len(term)
            count += len(lines)
            if held > 2 * HELD_TERMS:
                term, n = merged()
                if len(term) > HELD_TERMS:
                    yield row(pa.array(term.view(np.int64)), n)
                    term, n = term[:0], n[:0]
                terms, sums, held = [term], [n], len(term)
    if held:
        term, n = merged()
        yield row(pa.array(term.view(np.int64)), n)
    yield row(pa.nulls(1, pa.int64()), [count])


def _candidates(shared, threshold: float):
    """Per file its units that could reach the threshold, with the terms outside the templates of each new ``key``."""

    def lists(doc, rows, **columns):
        order = np.argsort(doc, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=rows))])
        flat = pa.StructArray.from_arrays([pa.array(c[order]) for c in columns.values()], list(columns))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            text, named = batch.column("text").fill_null(""), batch.column("named").to_numpy(zero_copy_only=False)
            for low, high in slices(text):
                u = _units(t, text.slice(low, high - low), threshold, named[low:high])
                unit, h, n = u.outside
                # no term weighs less than 1
                most = u.dot / np.sqrt(np.maximum(u.square + np.bincount(unit, n * n, len(u.doc)), 1))
                key = np.zeros(len(u.doc), U64)
                first = np.flatnonzero(np.diff(unit, prepend=-1))
                if len(first):
                    key[unit[first]] = mix(np.add.reduceat(mix(h + n.astype(U64) * BYTE_CODE[10]), first))
                chosen = np.flatnonzero((u.dot > 0) & (named[low:high][u.doc] & (u.line < 0) | (most >= threshold - 1e-9)))
                mine = np.isin(unit, chosen[np.unique(key[chosen], return_index=True)[1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(low, high - low), batch.column("path").slice(low, high - low),
                        lists(
                            u.doc[chosen], u.rows, line=u.line[chosen].astype(np.int32), size=chosen.astype(np.int32), key=key[chosen].view(np.int64), dot=u.dot[chosen],
                            square=u.square[chosen], which=u.which[chosen].astype(np.int32),
                        ),
                        lists(u.doc[unit[mine]], u.rows, key=key[unit[mine]].view(np.int64), term=h[mine].view(np.int64), n=n[mine].astype(np.int64)),
                    ],
                    ["id", "path", "units", "terms"],
                )

    return run


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else df


def _weighed(rows: DataFrame, t: TemplateSet, threshold: float) -> DataFrame:
    """What ``_match`` gives, under the frequencies of all terms; cosines of what cannot reach ``threshold`` are 0, but for files of a licence file's name."""
    sc = rows.sparkSession.sparkContext
    frequency = settle(rows.select("text").mapInArrow(_all_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("seen")))
    ours = dict(frequency.where(F.col("term").isNull() | F.col("term").isin(t.terms.view(np.int64).tolist())).collect())
    lines = ours.get(None, 0)
    t.weigh(np.array([ours.get(x, 0) for x in t.terms.view(np.int64).tolist()], float), lines)
    files = settle(
        rows.mapInArrow(
            _candidates(sc.broadcast(t), threshold),
            "id long, path string, units array<struct<line int, size int, key long, dot double, square double, which int>>, terms array<struct<key long, term long, n long>>",
        ).withColumn("_row", F.monotonically_increasing_id())
    )
    terms = settle(files.select(F.explode("terms").alias("x")).select("x.*").dropDuplicates(["key", "term"]))
    needed = settle(frequency.join(terms.select("term").distinct(), "term"))
    idf = F.log((1 + F.lit(lines)) / (1 + F.col("seen"))) + 1
    outside = settle(terms.join(_small(needed), "term").groupBy("key").agg(F.sum((F.col("n") * idf) ** 2).alias("rest")))
    units = files.select("_row", F.explode("units").alias("u")).select("_row", "u.*").join(_small(outside), "key", "left")
    units = units.withColumn("cosine", F.round(F.col("dot") / F.sqrt(F.col("square") + F.coalesce("rest", F.lit(0.0))), DIGITS))
    # of equal fits the first line, and the longest window, which has the highest number
    best = F.struct("cosine", (-F.col("line")).alias("back"), "size", "which")
    found = units.groupBy("_row").agg(F.max(F.when(F.col("line") >= 0, best)).alias("h"), F.max(F.when(F.col("line") < 0, best)).alias("w"))
    name = lambda which: F.element_at(F.array(*map(F.lit, t.names)), which + 1)
    header = F.coalesce("h.cosine", F.lit(0.0))
    return files.join(found, "_row", "left").select(
        "id", "path", F.when(header >= threshold, name(F.col("h.which"))).alias("header"), header.alias("header_cosine"), (-F.col("h.back")).alias("header_line"),
        F.when(F.col("w.cosine") > 0, name(F.col("w.which"))).alias("whole"), F.coalesce("w.cosine", F.lit(0.0)).alias("whole_cosine"),
    )


def scan_licenses(
    files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.7, every_term: bool = False, texts: list[tuple[str, str]] | None = None
) -> DataFrame:
    """One row per row of ``files`` (id, path, text): id, path, license, origin, cosine, line.

    ``origin`` is header (the best line or window of lines reaches ``threshold``), file (whole text, or a header in a file named like
    a licence), inherited, or null with no licence. A file named like a licence, except a notice, that has words but fits
    nothing is ``unknown``. Lines count from 0 among non-empty ones; that of a window is its first. Null and empty texts
    have no header; a null path is in no directory. Of several licence files of a directory
    the closest counts, then the first by licence and path; an unknown one only if there is no other. ``texts`` are full licence texts, compared
    with whole files only. ``every_term`` weighs terms outside the templates by their own frequency; without it they weigh as
    if never seen, which grows with the table.
    """
    sc = files.sparkSession.sparkContext
    t = TemplateSet(templates, texts or [])
    named = F.coalesce(F.col("path").rlike(FILE_NAMES), F.lit(False))
    rows = files.select("id", "path", "text", named.alias("named"))
    if every_term:
        seen = settle(_weighed(rows, t, threshold))
    else:
        counted = rows.select("text").mapInArrow(_frequencies(sc.broadcast(t)), "term long, n long").groupBy("term").agg(F.sum("n")).collect()
        total = np.zeros(len(t.terms) + 1)
        for term, n in counted:
            total[term] = n
        t.weigh(total[:-1], int(total[-1]))
        seen = settle(
            rows.mapInArrow(_match(sc.broadcast(t), threshold), "id long, path string, header string, header_cosine double, header_line int, whole string, whole_cosine double")
        )
    fits = F.col("whole_cosine") >= threshold
    blank = files.where(named & ~F.coalesce(F.regexp_like("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")), F.lit(False))).select("path").distinct().withColumn("_blank", F.lit(True))
    seen = seen.join(blank, "path", "left")
    mute = named & ~F.col("path").rlike(NOTICE_NAMES) & F.col("_blank").isNull()
    found = F.when(fits & (F.col("whole_cosine") >= F.col("header_cosine")), F.col("whole")).otherwise(F.coalesce("header", F.when(fits, F.col("whole"))))
    own = F.coalesce(found, F.when(mute, F.lit(UNKNOWN)))
    seen = seen.withColumns({"is_file": fits | named & own.isNotNull(), "own": own}).drop("_blank")
    folder = F.regexp_replace("path", r"[^/]*$", "")
    dirs = seen.where("is_file AND path IS NOT NULL").groupBy(folder.alias("dir")).agg(
        F.min_by("own", F.struct(F.col("own") == UNKNOWN, -F.greatest("whole_cosine", "header_cosine"), "own", "path")).alias("given"),
        F.max(F.greatest("whole_cosine", "header_cosine")).alias("given_cosine"),
    )
    dirs = settle(dirs)
    small = dirs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.when(i > 0, "/").otherwise("")))
    asked = seen.where("own IS NULL AND path IS NOT NULL").select("path").distinct().select("path", F.explode(F.array_distinct(above)).alias("dir"))
    near = asked.join(F.broadcast(dirs) if small else dirs, "dir").groupBy("path").agg(F.max_by(F.struct("given", "given_cosine"), F.length("dir")).alias("_near"))
    out = seen.join(near, "path", "left")
    return out.select(
        "id", "path", F.coalesce("own", "_near.given").alias("license"),
        F.when(F.col("own").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header")).when(F.col("_near").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("own").isNotNull(), F.greatest("whole_cosine", "header_cosine")).otherwise(F.col("_near.given_cosine")).alias("cosine"),
        F.when(F.col("own").isNotNull() & (F.col("header") == F.col("own")), F.col("header_line")).alias("line"),
    )
