"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Each line of a text, each run of lines between blank ones (a header, a
paragraph), and the whole text are sparse TF-IDF vectors; their cosine to each
template's vector decides. Templates are headers, and the texts of licence
files whole or by paragraphs. Words that no template has count in the norm with
the greatest weight, so prose around a notice lowers it. A template may need
words that tell its licence from its neighbours (a version, Affero, NC, SA, ND)
and may bar others. A file's own licence is that of its best segment.

A licence file (by its name; or, where ``file_share`` is set, because such
segments are that share of its words) gives its directory a licence. Files
without their own take that of the nearest ancestor directory that has one, by
joins on directory paths.

Defined cases: null and empty texts have no licence of their own; a null path
has no directory and inherits nothing; of several licence files in a directory
the least path counts; repeated rows each get their result; an empty table
gives an empty result; very long texts cost time in proportion. Only the path,
id and text columns are read, whatever the others are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from math import log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import SLICE_ROWS, boolean, string, written

_WORDS = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")
_BLANK = re.compile(r"\n[\x20\x09\x0B-\x0D]*\n")
_FILE_NAME = re.compile(r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$")

_V2, _V21, _V3, _V4 = r"(version|v|gpl-?) ?\.?2(?![.][1-9])", r"2\.1", r"(version|v|gpl-?) ?\.?3", r"4\.0"
_GNU = r"affero|lesser|library general"
_WARRANTY = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_CC = "This work is licensed under a Creative Commons {} 4.0 International License."

#: Public licences: name, notice or text (fixed wording), what a segment must have, what it must not have (in lower case).
TEMPLATES: tuple[tuple[str, str, str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", r"2\.0", ""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", r"2\.0", ""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", r"2\.0", ""),
    ("MIT", "Released under the MIT License.", r"\bmit\b", ""),
    ("MIT", "The MIT License (MIT)", r"\bmit\b", ""),
    ("MIT", _MIT, "", ""),
    ("MIT", f"MIT License {_MIT} THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. {_WARRANTY}", "", ""),
    ("ISC", "Released under the ISC License.", r"\bisc\b", ""),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "", ""),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License.", "2-clause|simplified", ""),
    ("BSD-2-Clause", f"{_BSD} {_BSD_WARRANTY}", "", "neither the name"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License.", "3-clause|new|revised", ""),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "", ""),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES} {_BSD_WARRANTY}", "neither the name", ""),
    ("BSD-3-Clause", _BSD_NAMES, "neither the name", ""),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", _V2, _GNU),
    ("GPL-2.0", _GPL.format("General Public License", 2), _V2, _GNU),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _V2, _GNU),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", _V3, _GNU),
    ("GPL-3.0", _GPL.format("General Public License", 3), _V3, _GNU),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _V3, _GNU),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1.", f"lesser(.|\n)*{_V21}", ""),
    ("LGPL-2.1", _GPL.format("Lesser General Public License", 2.1), f"lesser(.|\n)*{_V21}", ""),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3.", f"lesser(.|\n)*{_V3}", ""),
    ("LGPL-3.0", _GPL.format("Lesser General Public License", 3), f"lesser(.|\n)*{_V3}", ""),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", f"affero(.|\n)*{_V3}", ""),
    ("AGPL-3.0", _GPL.format("Affero General Public License", 3), f"affero(.|\n)*{_V3}", ""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla", ""),
    ("MPL-2.0", "Mozilla Public License Version 2.0", "mozilla", ""),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", r"eclipse(.|\n)*2\.0", ""),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "", ""),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "", ""),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.", "", ""),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal.", "cc0", ""),
    *((f"CC-{code}-4.0", f"Licensed under CC {code} 4.0.", rf"\bby{need}\b(.|\n)*{_V4}", "") for code, need in (("BY", "(?!-)"), ("BY-SA", "-sa"), ("BY-NC", "-nc(?!-)"), ("BY-ND", "-nd"), ("BY-NC-SA", "-nc-sa"), ("BY-NC-ND", "-nc-nd"))),
    ("CC-BY-4.0", _CC.format("Attribution"), _V4, "alike|commercial|deriv"),
    ("CC-BY-SA-4.0", _CC.format("Attribution-ShareAlike"), f"alike(.|\n)*{_V4}", "commercial"),
    ("CC-BY-NC-4.0", _CC.format("Attribution-NonCommercial"), f"commercial(.|\n)*{_V4}", "alike|deriv"),
    ("CC-BY-ND-4.0", _CC.format("Attribution-NoDerivatives"), f"deriv(.|\n)*{_V4}", "commercial"),
    ("CC-BY-NC-SA-4.0", _CC.format("Attribution-NonCommercial-ShareAlike"), f"commercial(.|\n)*alike(.|\n)*{_V4}", ""),
    ("CC-BY-NC-ND-4.0", _CC.format("Attribution-NonCommercial-NoDerivatives"), f"commercial(.|\n)*deriv(.|\n)*{_V4}", ""),
    ("proprietary", "All rights reserved.", r"\ball\b", r"\bno\b"),
)


@dataclass(frozen=True)
class Templates:
    """file_share: from which share of a text's words in such segments on it is a licence file whatever its name; None: by name alone."""

    notices: tuple[tuple[str, str, str, str], ...] = TEMPLATES
    least_cosine: float = 0.6
    file_share: float | None = 0.5


@dataclass
class Index:
    idf: dict[str, float] = field(default_factory=dict)
    postings: dict[str, list[tuple[int, float]]] = field(default_factory=dict)
    unknown: float = 0.0


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(text)]


@cache
def index(t: Templates) -> Index:
    """The templates' unit vectors by word; made once in each Python worker."""
    sets = [words_of(n[1]) for n in t.notices]
    df: dict[str, int] = {}
    for words in sets:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    out = Index({w: 1 + log(len(sets) / n) for w, n in df.items()}, {}, 1 + log(len(sets)))
    for i, words in enumerate(sets):
        vector = {w: words.count(w) * out.idf[w] for w in set(words)}
        norm = sqrt(sum(x * x for x in vector.values()))
        for w, x in vector.items():
            out.postings.setdefault(w, []).append((i, x / norm))
    return out


def counted(words: list[str]) -> dict[str, int]:
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return counts


def nearest(counts: dict[str, int], segment: str, t: Templates) -> tuple[float, int]:
    """The best cosine of a template that the segment may be, and which (-1: none of least_cosine or more)."""
    ix = index(t)
    dots: dict[int, float] = {}
    norm = 0.0
    for w, n in counts.items():
        x = n * ix.idf.get(w, ix.unknown)
        norm += x * x
        for i, y in ix.postings.get(w, ()):
            dots[i] = dots.get(i, 0.0) + x * y
    if not dots:
        return 0.0, -1
    least = t.least_cosine * sqrt(norm) * (1 - 1e-12)
    for i in sorted((i for i, x in dots.items() if x >= least), key=lambda k: (-dots[k], k)):
        _, _, needs, bars = t.notices[i]
        low = segment.lower()
        if (not needs or re.search(needs, low)) and not (bars and re.search(bars, low)):
            return dots[i] / sqrt(norm), i
    return 0.0, -1


def own_licence(text: str, t: Templates) -> tuple[str | None, float, bool]:
    """The licence of the best segment, its cosine (0 without one), and whether such segments are the share of the text that makes a licence file."""
    best, name, noticed, total, whole = 0.0, None, 0, 0, {}

    def judged(counts: dict[str, int], segment: str) -> bool:
        nonlocal best, name
        cosine, i = nearest(counts, segment, t)
        if cosine > best:
            best, name = cosine, t.notices[i][0]
        return i >= 0

    for block in _BLANK.split(text):
        lines, hit, words_in, all_counts = block.split("\n"), 0, 0, {}
        for line in lines:
            words = words_of(line)
            counts = counted(words)
            words_in += len(words)
            if len(lines) > 1:
                for w, n in counts.items():
                    all_counts[w] = all_counts.get(w, 0) + n
            else:
                all_counts = counts
            if words and judged(counts, line):
                hit += len(words)
        if len(lines) > 1 and judged(all_counts, block):
            hit = words_in
        for w, n in all_counts.items():
            whole[w] = whole.get(w, 0) + n
        noticed, total = noticed + hit, total + words_in
    if "\n" in text and judged(whole, text):
        noticed = total
    return name, round(best, 6), t.file_share is not None and bool(noticed) and noticed >= t.file_share * total


def licences(files: DataFrame, t: Templates = Templates(), path_col: str = "path", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per file: own (its licence or null), cosine, licence_file, inherited, licence, from_dir."""
    fields = [*string("own"), T.StructField("cosine", T.DoubleType()), *boolean("licence_file")]
    schema = T.StructType([T.StructField("id", files.schema[id_col].dataType), T.StructField("path", T.StringType()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(low, SLICE_ROWS)
                rows = [own_licence(x or "", t) for x in part.column(2).to_pylist()]
                named = [bool(p and _FILE_NAME.search(p)) for p in part.column(1).to_pylist()]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.string()), (1, pa.float64()))]
                is_file = pa.array([r[0] is not None and (n or r[2]) for r, n in zip(rows, named, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns, is_file], schema.names)

    found = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    found = written(found)  # without the texts; three branches read it
    found = found.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit(""))))
    given = found.where("licence_file").groupBy("dir").agg(F.min(F.struct("path", "own"))["own"].alias("given"))
    # each directory once, with its ancestors and itself, joined to the directories that have a licence
    parts = F.split("dir", "/", -1)
    up = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    dirs = found.select("dir").where("dir is not null").distinct().select("dir", F.posexplode(F.array_distinct(up)).alias("depth", "up"))
    near = dirs.join(given.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "given")).alias("near"))
    out = found.join(near, "dir", "left")
    inherited = F.when(F.col("own").isNull(), F.col("near.given"))
    return out.select(F.col("id").alias(id_col), "own", "cosine", "licence_file", inherited.alias("inherited"), F.coalesce("own", inherited).alias("licence"), F.when(inherited.isNotNull(), F.col("near.up")).alias("from_dir"))
