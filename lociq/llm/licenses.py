"""License scan: sparse TF-IDF cosine to templates, then inheritance along paths.

Every file is compared with licences twice, as sparse vectors over the templates'
own terms.  As a whole it is compared with full licence texts (``license_texts``).
Its headers are compared with the notices by which files state a licence: each
line by itself, and each block of neighbouring lines that consist mostly of template
terms, so a notice that is wrapped over lines is read as one.  A term's weight is
occurrences * idf, idf = ln((1 + files) / (1 + files with the term)) + 1, over all
files.  A norm counts the other words too, each occurrence as a term that no template
has, at weight 1.  A notice is found only where its naming terms are (``NOTICES``), so another
licence's sentence of the same form is not taken for it.  The best (cosine, name) at or
above ``WHOLE`` of the text, or else at or above ``THRESHOLD`` of its headers, is the
file's licence.

Nothing that can reach a threshold is left out.  Marks are terms without which a
cosine to any template is below it (``marks``); texts, lines and blocks without one
are not scored.

A file is a licence file if its whole text is close to a licence's, if it is named
as one and holds a licence header, or if that header makes up most of its words.  A
file without a licence takes that of the nearest directory above it that holds a
licence file (several: the commonest licence, then the first name).  Directories
are made distinct first, so each is joined with its ancestors once; directories of
many files, and ancestors of many directories, are joined by broadcast
(``common.spread_join``).

Only DataFrame operations run.  Each text is read once; what is broadcast is the
table of template terms.  Null and empty texts have no licence of their own but
inherit; a null path is in no directory; a very long text is scored whole.  Equal
scores go to the last name in order.  Repeated rows are judged as rows.  Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.llm.common import HOT, materialize, spread_join, tidy

# Notices by which files state their licence; + before a term that must occur.
NOTICES = {
    "0BSD": ("SPDX License Identifier +0BSD",),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU +Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "Licensed under the GNU +Affero General Public License version 3",
        "GNU +AGPL v3",
        "SPDX License Identifier +AGPL +3.0",
    ),
    "Apache-2.0": (
        "Licensed under the +Apache License, Version 2.0",
        "Licensed under the +Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX License Identifier +Apache 2.0",
    ),
    "BSD-2-Clause": ("+BSD +2 Clause License", "SPDX License Identifier +BSD +2 Clause", "Released under the Simplified +BSD License"),
    "BSD-3-Clause": (
        "Use of this source code is governed by a +BSD style license that can be found in the LICENSE file",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "+BSD +3 Clause License",
        "SPDX License Identifier +BSD +3 Clause",
    ),
    "BSL-1.0": ("Distributed under the +Boost Software License, Version 1.0", "SPDX License Identifier +BSL 1.0"),
    "CC-BY-4.0": ("This work is licensed under a Creative +Commons Attribution 4.0 International License, CC BY 4.0", "SPDX License Identifier +CC BY 4.0", "Licensed under +CC BY 4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-+NC 4.0, Creative Commons Attribution NonCommercial", "This work is licensed under a Creative Commons Attribution +NonCommercial 4.0 International License", "SPDX License Identifier CC BY +NC 4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-+SA 4.0, Creative Commons Attribution ShareAlike", "This work is licensed under a Creative Commons Attribution +ShareAlike 4.0 International License", "SPDX License Identifier CC BY +SA 4.0"),
    "CC0-1.0": ("Dedicated to the public domain under +CC0 1.0 Universal", "SPDX License Identifier +CC0 1.0"),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the +Eclipse Public License 2.0", "SPDX License Identifier +EPL 2.0"),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the +GNU +General Public License as published by the Free Software Foundation; either version +2 of the License, or (at your option) any later version",
        "Licensed under the +GNU +General Public License version +2",
        "GNU +GPL v2",
        "SPDX License Identifier +GPL +2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the +GNU +General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the +GNU +General Public License as published by the Free Software Foundation, either version +3 of the License, or (at your option) any later version",
        "GNU +GPL v3",
        "SPDX License Identifier +GPL +3.0",
    ),
    "ISC": ("Released under the +ISC License", "SPDX License Identifier +ISC"),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU +Lesser General Public License as published by the Free Software Foundation; either version +2.1 of the License, or (at your option) any later version",
        "Licensed under the GNU +Lesser General Public License version +2.1",
        "GNU +LGPL v2.1",
        "SPDX License Identifier +LGPL +2.1",
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU +Lesser General Public License as published by the Free Software Foundation, either version +3 of the License, or (at your option) any later version",
        "Licensed under the GNU +Lesser General Public License version 3",
        "GNU +LGPL v3",
        "SPDX License Identifier +LGPL +3.0",
    ),
    "MIT": ("Released under the +MIT License", "SPDX License Identifier +MIT"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the +Mozilla Public License, v. 2.0",
        "This Source Code Form is subject to the terms of the +Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "SPDX License Identifier +MPL 2.0",
    ),
    "Unlicense": ("This is free and +unencumbered software released into the public domain", "SPDX License Identifier +Unlicense"),
    "Zlib": ("Released under the +zlib License", "SPDX License Identifier +Zlib"),
}
#: Least cosine of a header to a notice, and of a whole text to a licence's text.
THRESHOLD, WHOLE = 0.5, 0.75
#: Full licence texts, one file each, named after the licence.
TEXTS = Path(__file__).parent / "license_texts"
#: Names of licence files.
NAMED = r"(?i)(^|/)([^/]*[-_.])?(licen[cs]es?|copying|copyright|unlicense)([-_][a-z0-9]+([-_.][0-9a-z]*[0-9])*)?(\.(txt|md|rst|html?|lesser))?$"
#: Words that say nothing about a licence: not terms.
STOP = ("a", "and", "are", "by", "in", "is", "of", "the", "this", "to")
_CUT = r"[^a-z0-9.]+"


def _words(text: Column) -> Column:
    """Words: lower case, letters, digits and inner dots."""
    return F.filter(F.transform(F.split(F.lower(text), _CUT), lambda w: F.btrim(w, F.lit("."))), lambda w: w != "")


def _other(words: Column, known: Column) -> Column:
    """Number of words that are neither terms nor STOP."""
    return F.size(F.filter(words, lambda w: ~w.isin(*STOP))) - F.size(known)


def counted(text: str) -> dict[str, int]:
    words = (w.strip(".") for w in re.split(_CUT, text.lower()))
    return dict(Counter(w for w in words if w and w not in STOP))


def notice_terms() -> list[tuple[str, dict[str, int], set[str]]]:
    """Licence, terms with their occurrences, and naming terms of each notice."""
    return [(name, counted(n), {next(iter(counted(w))) for w in re.findall(r"\+(\S+)", n)}) for name, notices in sorted(NOTICES.items()) for n in notices]


def full_terms() -> dict[str, dict[str, int]]:
    return {f.stem: counted(f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))}


def marks(templates: list[dict[str, int]], idf: dict[str, float], least: float) -> set[str]:
    """Terms of which a text holds one if its cosine to any template reaches ``least``.

    Without them its dot product is that with the template's remaining terms, so its
    cosine is at most their share of the template's length.  The commonest terms
    are left out first.
    """
    out = set()
    for terms in templates:
        square = {w: (n * idf[w]) ** 2 for w, n in terms.items()}
        room = (least - 1e-6) ** 2 * sum(square.values())
        for w in sorted(terms, key=lambda w: (idf[w], w)):
            if square[w] < room:
                room -= square[w]
            else:
                out.add(w)
    return out


def _scored(counts: DataFrame, templates: list[tuple[str, dict[str, int], set[str]]], idf: dict[str, float]) -> DataFrame:
    """Of counts (row, unit, word, n): (row, unit, name, dot, own2) for templates whose naming terms all occur.

    own2 is the squared length over the templates' terms.  The table of terms is a
    row for each term, with what it adds to each template that has it.
    """
    table = []
    for w in sorted({w for _, t, _ in templates for w in t}):
        adds = []
        for k, (_, terms, naming) in enumerate(templates):
            if w in terms:
                length = math.sqrt(sum((n * idf[v]) ** 2 for v, n in terms.items()))
                adds.append({"t": k, "dot": terms[w] * idf[w] ** 2 / length, "naming": int(w in naming)})
        table.append({"word": w, "idf": idf[w], "adds": adds})
    weights = counts.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(table)), "array<struct<word:string,idf:double,adds:array<struct<t:int,dot:double,naming:int>>>>")))
    names = F.array(*(F.lit(name) for name, _, _ in templates))
    needed = F.array(*(F.lit(len(naming)) for _, _, naming in templates))
    hit = counts.join(F.broadcast(weights), "word")
    own2 = hit.groupBy("row", "unit").agg(F.sum(F.pow(F.col("n") * F.col("idf"), F.lit(2.0))).alias("own2"))
    dots = hit.select("row", "unit", "n", F.explode("adds").alias("a")).groupBy("row", "unit", F.col("a.t").alias("t")).agg(F.sum(F.col("n") * F.col("a.dot")).alias("dot"), F.sum("a.naming").alias("named"))
    found = dots.filter(F.col("named") == F.element_at(needed, F.col("t") + 1)).join(own2, ["row", "unit"])
    return found.select("row", "unit", F.element_at(names, F.col("t") + 1).alias("name"), "dot", "own2")


def _reaching(scored: DataFrame, other2: str, least: float) -> DataFrame:
    """Units with the scores that reach ``least``."""
    score = F.round(F.col("dot") / F.sqrt(F.col("own2") + F.col(other2)), 6)
    return scored.withColumn("score", score).filter(F.col("score") >= least)


def _headers(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms (row, unit, word, n) and sizes (row, unit, words, other) of all headers: marked lines, and blocks with a marked line."""
    lines = lines.select("row", F.inline("lines"))
    island = F.col("line") - F.row_number().over(Window.partitionBy("row").orderBy("line"))  # one text
    dense = lines.filter("dense").withColumn("unit", F.concat(F.lit("block "), island.cast("string")))
    whole = dense.groupBy("row", "unit").agg(F.count("*").alias("n"), F.bool_or("marked").alias("hit")).filter("n > 1 and hit").select("row", "unit")
    alone = lines.filter("marked").withColumn("unit", F.concat(F.lit("line "), F.col("line").cast("string")))
    named = ["row", "unit", "known", "words", "other"]
    units = materialize(alone.select(*named).unionByName(dense.join(whole, ["row", "unit"]).select(*named)), "headers")
    counts = units.select("row", "unit", F.explode("known").alias("word")).groupBy("row", "unit", "word").agg(F.count("*").alias("n"))
    return counts, units.groupBy("row", "unit").agg(F.sum("words").alias("words"), F.sum("other").alias("other"))


@tidy
def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, path, own_license, score, is_license_file, license, inherited_from."""
    notices, full = notice_terms(), full_terms()
    texts = [(name, terms, set()) for name, terms in full.items()]
    vocabulary = sorted({w for _, t, _ in notices for w in t})
    every = sorted({w for _, t, _ in (*notices, *texts) for w in t})
    rows = files.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{path_col}`").alias("path"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # written, so that each text is cut once
    cut = rows.withColumn("words", _words(F.col("text"))).withColumn("known", F.filter("words", lambda w: w.isin(*every)))
    some = F.exists("known", lambda w: w.isin(*vocabulary))
    read = materialize(cut.select("row", "doc_id", "path", F.when(some, F.col("text")).alias("text"), "known", F.size("words").alias("n_words"), _other(F.col("words"), F.col("known")).alias("other")), "texts")
    n_files = read.count()
    df = {r["term"]: r["n"] for r in read.select(F.explode(F.array_distinct("known")).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}  # template terms only
    idf = {w: math.log((1 + n_files) / (1 + df.get(w, 0))) + 1 for w in every}

    # headers: a notice with naming terms is marked by any one of them, others by the bound
    naming = {min(need, key=lambda w: (-idf[w], w)) for _, _, need in notices if need}
    wanted = sorted(naming | marks([t for _, t, need in notices if not need], idf, THRESHOLD))

    def with_terms(x: Column) -> Column:
        return F.struct(x["line"].alias("line"), x["words"].alias("words"), F.filter(x["words"], lambda w: w.isin(*vocabulary)).alias("known"))

    def judged_line(x: Column) -> Column:
        other = _other(x["words"], x["known"])
        dense = (F.size(x["known"]) > 0) & (F.size(x["known"]) >= other)
        return F.struct(x["line"].alias("line"), x["known"].alias("known"), F.size(x["words"]).alias("words"), other.alias("other"), F.exists(x["known"], lambda w: w.isin(*wanted)).alias("marked"), dense.alias("dense"))

    hit = read.filter(F.col("text").isNotNull() & F.exists("known", lambda w: w.isin(*wanted)))
    lines = F.transform(F.split("text", "\n"), lambda x, k: F.struct(k.alias("line"), _words(x).alias("words")))
    lines = F.filter(F.transform(F.transform(lines, with_terms), judged_line), lambda x: x["marked"] | x["dense"])
    counts, sizes = _headers(materialize(hit.select("row", lines.alias("lines")).filter(F.exists("lines", lambda x: x["marked"])), "lines"))
    scored = _scored(counts, notices, idf).join(sizes, ["row", "unit"])
    best = _reaching(scored, "other", THRESHOLD).join(read.select("row", "n_words"), "row")
    own = best.groupBy("row").agg(F.max(F.struct("score", "name")).alias("best"), F.max(2 * F.col("words") > F.col("n_words")).alias("alone"))

    # whole texts; terms of notices alone are other words here
    only = [w for w in every if not any(w in t for t in full.values())]
    held = read.filter(F.exists("known", lambda w: w.isin(*sorted(marks(list(full.values()), idf, WHOLE)))))
    counts = held.select("row", F.lit("").alias("unit"), F.explode("known").alias("word")).groupBy("row", "unit", "word").agg(F.count("*").alias("n"))
    others = held.select("row", (F.col("other") + F.size(F.filter("known", lambda w: w.isin(*only)))).alias("other"))
    whole = _reaching(_scored(counts, texts, idf).join(others, "row"), "other", WHOLE).groupBy("row").agg(F.max(F.struct("score", "name")).alias("whole"))

    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    given = F.coalesce("whole", "best")
    is_file = F.col("whole").isNotNull() | F.coalesce("alone", F.lit(False)) | (F.col("best").isNotNull() & F.coalesce(F.col("path").rlike(NAMED), F.lit(False)))
    both = read.select("row", "doc_id", "path", folder.alias("dir")).join(own, "row", "left").join(whole, "row", "left")
    judged = materialize(both.select("doc_id", "path", "dir", given["name"].alias("own_license"), given["score"].alias("score"), is_file.alias("is_license_file")), "licenses")
    return _inherited(judged, n_files).withColumnRenamed("doc_id", id_col)


def _inherited(judged: DataFrame, n_files: int) -> DataFrame:
    """Rows with license and inherited_from: their own, or that of the nearest directory above with a licence file."""
    votes = judged.filter("is_license_file and dir is not null").groupBy("dir", "own_license").agg(F.count("*").alias("n"))
    holders = votes.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "own_license")).alias("v")).select(F.col("dir").alias("above"), F.col("v.own_license").alias("given"))
    folders = materialize(judged.filter("dir is not null and own_license is null").groupBy("dir").agg(F.count("*").alias("files")), "folders")
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    ups = folders.select("dir", F.explode(F.array_distinct(ups)).alias("above"))
    below = ups.groupBy("above").agg(F.count("*").alias("below"))
    holders = materialize(holders.join(below, "above"), "holders")
    n_ups = folders.agg(F.coalesce(F.sum(F.size(parts) + 1), F.lit(0)).alias("n")).first()["n"]
    nearest = spread_join(ups, holders, ["above"], F.col("below") * HOT > F.lit(n_ups), "inner").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("deep"), "above", "given")).alias("near"))
    nearest = materialize(nearest.join(folders, "dir"), "nearest")
    takes = F.col("own_license").isNull() & F.col("dir").isNotNull()
    named = ["doc_id", "path", "own_license", "score", "is_license_file"]
    taken = spread_join(judged.filter(takes), nearest, ["dir"], F.col("files") * HOT > F.lit(n_files)).select(*named, F.col("near.given").alias("license"), F.col("near.above").alias("inherited_from"))
    return judged.filter(~takes).select(*named, F.col("own_license").alias("license"), F.lit(None).cast("string").alias("inherited_from")).unionByName(taken)
