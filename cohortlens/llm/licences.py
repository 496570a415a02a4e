"""Licences of files: TF-IDF cosine to templates, then inheritance down the directories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.stage import in_struct, staged, with_fields
from cohortlens.llm.words import ALNUM, byte_rows, hashed, words_of

# Openings, grants and notices by which licences are known.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ terms and conditions for use, reproduction, and distribution",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU General Public License Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU General Public License Version 2, June 1991",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["CC0 1.0 Universal. To the extent possible under law, the author has waived all copyright and related rights to this work."],
}

# Identifiers of an SPDX line. Its words must all be there.
SPDX = "SPDX-License-Identifier:"
for _name in TEMPLATES:
    TEMPLATES[_name].append(f"{SPDX} {_name}")

#: A block of lines, or a window of words, counts as a licence from this cosine on.
LEAST = 0.6
#: Words that a smaller share of the files holds, and words of no template, weigh as if this share did.
RAREST = 1e-4
#: Lengths of word windows as shares of a template's length, and windows compared at once.
WINDOWS, AT_ONCE = (1.0, 0.75), 1024
#: Share of a file's words in its licence block from which it is a licence file.
FILE_SHARE = 0.5
_LINE = np.arange(256) != 10


def _term_numbers(terms: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    return np.where(terms[at] == h, at, -1)


def _template_terms(templates: dict[str, list[str]], least: float) -> tuple[np.ndarray, list[str], np.ndarray, list[np.ndarray]]:
    """All terms; of each template its licence, the cosine it needs and its words' hashes."""
    names = [n for n, texts in templates.items() for _ in texts]
    needs = np.array([max(least, 1 - 1e-6) if t.startswith(SPDX) else least for texts in templates.values() for t in texts])
    rows = []
    for w in words_of(pa.array([t for texts in templates.values() for t in texts]), ALNUM, 1 << 30):
        h, bounds = hashed(w.data, w.starts, w.ends), w.bounds()
        rows = [h[a:b] for a, b in zip(bounds, bounds[1:])]
    return np.unique(np.concatenate(rows)), names, needs, rows


def _windows(at: np.ndarray, counts: np.ndarray, size: int, gains: np.ndarray, squares: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts of windows of ``size`` words inside a row that may reach ``least``, and their cosines.

    ``gains``: what a term adds to the product with each template; ``squares``: of the
    terms' weights. Of both the last row is that of a word of no template. A window is at
    least as long as its words' single weights, which bounds its cosines.
    """
    if len(at) < size:
        return
    best = gains.max(axis=1)
    product, square = (np.concatenate(([0.0], np.cumsum(x[at]))) for x in (best, squares))
    row = np.repeat(np.arange(len(counts)), counts)
    likely = row[size - 1 :] == row[: len(row) - size + 1]
    likely &= product[size:] - product[:-size] + 1e-6 >= least * np.sqrt(np.maximum(square[size:] - square[:-size], 0))
    starts = np.flatnonzero(likely)
    for k in range(0, len(starts), AT_ONCE):
        some = starts[k : k + AT_ONCE]
        words = at[some[:, None] + np.arange(size)]
        times = np.where(words >= 0, (words[:, :, None] == words[:, None, :]).sum(axis=2), 1)
        yield some, gains[words].sum(axis=1) / np.sqrt((squares[words] * times).sum(axis=1))[:, None]


def document_counts(files: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """Over all files: their number, and in how many each term of the templates occurs."""
    n = len(terms)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = 0, np.zeros(n, np.int64)
        for batch in batches:
            for w in words_of(batch.column("text"), ALNUM):
                at = _term_numbers(terms, hashed(w.data, w.starts, w.ends))
                rows = np.repeat(np.arange(len(w.counts)), w.counts)
                pairs = np.unique(rows[at >= 0] * n + at[at >= 0])
                counts += np.bincount(pairs % n, minlength=n)
                total += len(w.counts)
        yield pa.record_batch([pa.array(np.arange(-1, n)), pa.array(np.append(total, counts))], ["term", "files"])

    found = files.select("text").mapInArrow(of, "term long, files long").groupBy("term").agg(F.sum("files").alias("files"))
    by_term = {r["term"]: r["files"] for r in found.collect()}
    return by_term.get(-1, 0), np.array([by_term.get(k, 0) for k in range(n)], float)


def matched(files: DataFrame, templates: dict[str, list[str]], least: float = LEAST) -> DataFrame:
    """``files`` (path, text and others; without the text) with the best block of each file.

    A block is a line, a stretch of up to four lines that all hold words of the templates,
    or a window of about a template's length anywhere in the text, so what stands around a
    notice, a copyright say, takes nothing from it. Its TF-IDF vector over all its words is
    compared to each template's. Weights come from the share of the files that hold a term,
    at least ``RAREST``: more files of the same kind change no weight and no answer.
    ``own_licence, cosine, share``: the best template, if the cosine reaches ``least``, and
    the share of the file's words in its best stretch of lines and all windows that reach it.
    """
    terms, names, needs, rows = _template_terms(templates, least)
    total, df = document_counts(files, terms)
    idf = 1 - np.log(np.maximum(df / max(1, total), RAREST))
    other = 1 - np.log(RAREST)  # a word of no template
    vectors = np.zeros((len(rows), len(terms)))
    for k, h in enumerate(rows):
        np.add.at(vectors[k], np.searchsorted(terms, h), 1)
    vectors *= idf
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    carried = in_struct(files, [c for c in files.columns if c != "text"], text=files["text"])
    lengths: dict[int, list[int]] = {}
    for k, h in enumerate(rows):
        for size in {int(np.ceil(x * len(h))) for x in WINDOWS if needs[k] == least or x == 1}:
            lengths.setdefault(size, []).append(k)
    gains = np.vstack(((vectors * idf).T, np.zeros(len(rows))))
    squares = np.append(idf, other) ** 2

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            best = [(None, 0.0)] * batch.num_rows
            share = np.zeros(batch.num_rows)
            for w, lines in zip(words_of(column, ALNUM), words_of(column, _LINE)):
                at = _term_numbers(terms, hashed(w.data, w.starts, w.ends))
                line = np.searchsorted(lines.starts, w.starts, "right") - 1
                n_lines = len(lines.starts)
                weight = np.bincount(line, weights=np.where(at >= 0, idf[at], 0), minlength=n_lines)
                # only lines with several weighty words can reach the cosine with a template
                size = np.bincount(line, minlength=n_lines)
                known = np.bincount(line, weights=at >= 0, minlength=n_lines)
                bound = np.sqrt(known / np.maximum(size, 1))
                hot = np.flatnonzero((known >= 2) & (bound >= least) & (weight > 0))
                line_row = np.repeat(np.arange(len(lines.counts)), lines.counts)
                cut = np.searchsorted(line, np.arange(n_lines + 1))
                hot_set = set(hot.tolist())
                inside, found = np.zeros(len(at) + 1, np.int64), {}  # where blocks begin and end; the best stretch of a row
                for first in hot.tolist():
                    row = line_row[first]
                    last = first
                    while True:
                        words = at[cut[first] : cut[last + 1]]
                        v = np.bincount(words[words >= 0], minlength=len(terms)) * idf
                        norm = np.sqrt((v**2).sum() + (words < 0).sum() * other**2)
                        cos = vectors @ v / max(norm, 1e-12)
                        top = int(np.where(cos >= needs, cos, -1).argmax())
                        if cos[top] >= needs[top] and cos[top] > best[w.first + row][1] + 1e-12:
                            best[w.first + row] = (names[top], float(cos[top]))
                            found[row] = (cut[first], cut[last + 1])
                        last += 1
                        if last - first >= 4 or last not in hot_set or line_row[last] != row:
                            break
                bounds = w.bounds()
                for size, ks in lengths.items():
                    for starts, cos in _windows(at, w.counts, size, gains[:, ks], squares, least):
                        cos = np.where(cos >= needs[ks], cos, 0)
                        top = cos.argmax(axis=1)
                        cos = cos[np.arange(len(top)), top]
                        for k in np.flatnonzero(cos > 0):
                            row = int(np.searchsorted(bounds, starts[k], "right")) - 1
                            np.add.at(inside, [starts[k], starts[k] + size], [1, -1])
                            if cos[k] > best[w.first + row][1] + 1e-12:
                                best[w.first + row] = (names[ks[top[k]]], float(cos[k]))
                for a, b in found.values():
                    np.add.at(inside, [a, b], [1, -1])
                counted = np.concatenate(([0], np.cumsum(np.cumsum(inside[:-1]) > 0)))
                share[w.first : w.first + len(w.counts)] = np.diff(counted[bounds]) / np.maximum(w.counts, 1)
            yield pa.record_batch(
                [batch.column("row"), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64()), pa.array(share)],
                ["row", *new],
            )

    new = {"own_licence": T.StringType(), "cosine": T.DoubleType(), "share": T.DoubleType()}
    return carried.mapInArrow(of, with_fields(carried, "row", **new)).select("row.*", *new)


def parent(path: Column) -> Column:
    """The directory of a path; of a top directory the root, an empty string."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def ancestors(folder: Column) -> Column:
    """A directory and all above it, the root last: each with its depth."""
    parts = F.split(folder, "/")
    return F.transform(
        F.sequence(F.lit(0), F.when(folder == "", 0).otherwise(F.size(parts))),
        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("folder")),
    )


def inherited(files: DataFrame) -> DataFrame:
    """``files`` (path, own_licence, is_licence_file) with ``licence`` and ``origin``.

    Origin: ``own``, ``directory`` or ``none``. A file without a licence takes that of the
    nearest directory above it that holds a licence file; among several such files the
    licence that most of them have, then the first by name. Directories are resolved first,
    each once: its ancestors are joined to the directories that hold licence files.
    """
    rows = in_struct(
        files, files.columns, folder=parent(F.coalesce(files["path"], F.lit(""))), own_licence=files["own_licence"],
        is_licence_file=files["is_licence_file"],
    )
    votes = rows.filter("is_licence_file and own_licence is not null").groupBy("folder", "own_licence").agg(F.count("*").alias("n"))
    owned = votes.groupBy(F.col("folder").alias("owner")).agg(
        F.min_by("own_licence", F.struct(-F.col("n"), F.col("own_licence"))).alias("given")
    )
    folders = rows.select("folder").distinct()
    above = folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("a")).select("folder", F.col("a.depth").alias("depth"), F.col("a.folder").alias("owner"))
    nearest = above.join(owned, "owner").groupBy("folder").agg(F.max_by("given", "depth").alias("given"))
    own = F.col("own_licence").isNotNull()
    return rows.join(nearest, "folder", "left").select(
        "row.*",
        F.coalesce("own_licence", "given").alias("licence"),
        F.when(own, "own").when(F.col("given").isNotNull(), "directory").otherwise("none").alias("origin"),
    )


def licences(files: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST, file_share: float = FILE_SHARE) -> DataFrame:
    """``files`` (path, text, others) with ``own_licence, cosine, licence, origin`` for the text.

    A licence file is one named LICENSE, LICENCE, COPYING or NOTICE, one whose licence block
    holds ``file_share`` of its words, or one that the column ``opens_folder``, if there is
    one, marks. Null paths stand in the root, null texts have no licence. No files: no rows.
    """
    taken = ("own_licence", "cosine", "share", "licence", "origin", "is_licence_file")
    files = files.drop(*taken)
    named = F.coalesce(F.col("path"), F.lit("")).rlike("(?i)(^|/)(licen[cs]e|copying|notice)([.][^/]*)?$")
    marked = F.coalesce(F.col("opens_folder"), F.lit(False)) if "opens_folder" in files.columns else F.lit(False)
    found = matched(files, templates or TEMPLATES, least)
    found = staged(found.withColumn("is_licence_file", named | marked | (F.col("share") >= file_share)), "licences")
    return inherited(found)


def url_path(url: Column) -> Column:
    """The path of a file as its address has it: host and path, without scheme, query or fragment."""
    bare = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "[?#].*$", "")
    return F.regexp_replace(bare, "/+", "/")


def all_licences(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """``kind, id, path, own_licence, cosine, licence, origin`` of each document and page.

    A page stands in the directories of its address, and takes the licence of the nearest
    one that holds a licence file; one without an address neither gives nor takes. Documents have no path: their own licence is all there is.
    Null texts and addresses, see ``licences``; ids are carried as they are.
    """
    alone = matched(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), TEMPLATES, LEAST)
    own = F.col("own_licence")
    first = alone.select(
        F.lit("document").alias("kind"), "id", F.lit(None).cast("string").alias("path"), "own_licence", "cosine",
        own.alias("licence"), F.when(own.isNotNull(), "own").otherwise("none").alias("origin"),
    )
    apart = F.concat(F.lit("?"), F.monotonically_increasing_id().cast("string"), F.lit("/"))  # no address has a question mark now
    files = pages.select(F.col("page_id").cast("long").alias("id"), F.coalesce(url_path(F.col("url")), apart).alias("path"), F.col("html").alias("text"))
    path = F.when(~F.col("path").startswith("?"), F.col("path")).alias("path")
    second = licences(files).select(F.lit("page").alias("kind"), "id", path, "own_licence", "cosine", "licence", "origin")
    return first.unionByName(second)
