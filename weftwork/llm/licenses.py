"""Operator 7, license scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A text is read as a sequence of words, so line ends, comment signs and punctuation do not matter. Wherever it has one of the
words that license notices turn on (MARKS), each template with that word is laid over the text, mark on mark, and the window
of the template's length becomes a sparse vector over words and pairs of neighbouring words, weighted by how few templates
hold them. The template of greatest cosine wins if that is LEAST or more; a template counts only where its window has the
words that tell it from its relatives (version numbers, "lesser", "nc"), and none of theirs. Notices inside long lines, wrapped
headers and whole license texts are all found so.

A file licenses its directory if its name says that it is a license file, or else if COVERED of its words or more lie in such windows.
A file without a license of its own takes that of its nearest ancestor directory: ancestors of the distinct directories are
listed and joined by path.

Nulls and edges: a null or empty text has no license of its own; a null path has no directory, so nothing to inherit or give;
ties go to the greater cosine, then the longer template, then the license name; repeated rows are scanned alike; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from weftwork.llm.common import small, written

#: Cosine from which on a window counts as a template's; share of a text's words in windows that makes it a license file.
LEAST, COVERED = 0.7, 0.5

# Licenses by identifier: the names that notices call them by, words that a window must have and must not have.
NAMES = {
    "Apache-2.0": (("Apache License, Version 2.0", "Apache 2.0 License", "Apache-2.0"), "apache 2", ""),
    "MIT": (("MIT License",), "mit", ""),
    "ISC": (("ISC License",), "isc", ""),
    "BSD-2-Clause": (("BSD 2-Clause License", "Simplified BSD License"), "bsd", "3 new 4"),
    "BSD-3-Clause": (("BSD 3-Clause License", "New BSD License"), "bsd", "2 simplified 4"),
    "GPL-2.0": (("GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0"), "2", "lesser affero 3 lgpl agpl library"),
    "GPL-3.0": (("GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0"), "3", "lesser affero 2 lgpl agpl"),
    "LGPL-2.1": (("GNU Lesser General Public License, version 2.1", "LGPL-2.1"), "2 1", "affero 3 agpl"),
    "LGPL-3.0": (("GNU Lesser General Public License, version 3", "LGPL-3.0"), "3", "affero 2 agpl"),
    "AGPL-3.0": (("GNU Affero General Public License, version 3", "AGPL-3.0"), "3", "lesser lgpl"),
    "MPL-2.0": (("Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL-2.0"), "2", "1"),
    "EPL-2.0": (("Eclipse Public License, version 2.0", "EPL-2.0"), "2", "1"),
    "BSL-1.0": (("Boost Software License, version 1.0", "BSL-1.0"), "1", "1 1"),
    "CC0-1.0": (("CC0 1.0 Universal", "CC0-1.0"), "cc0", ""),
    "CC-BY-4.0": (("CC BY 4.0", "Creative Commons Attribution 4.0 International License"), "4", "nc sa nd noncommercial sharealike noderivatives noderivs non share 3"),
    "CC-BY-SA-4.0": (("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"), "4", "nc nd noncommercial noderivatives non 3"),
    "CC-BY-NC-4.0": (("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"), "4", "sa nd sharealike noderivatives share 3"),
    "CC-BY-ND-4.0": (("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"), "4", "sa nc sharealike noncommercial share non 3"),
    "CC-BY-NC-SA-4.0": (("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"), "4", "nd noderivatives 3"),
}
# Notices that name one of these, and the standard wordings of headers and of whole short licenses. The wordings
# of the permissive licenses share parts; what tells them apart is in the words that they must and must not have.
NOTICES = ("Licensed under the {}", "Licensed under {}", "Released under the {}", "This work is licensed under the {}", "This work is licensed under a {}", "This program is distributed under the terms of the {}", "SPDX-License-Identifier: {}")
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GNU_TERMS = "under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License"
_GNU = "is free software: you can redistribute it and/or modify it " + _GNU_TERMS + ", or (at your option) any later version."
WORDINGS = (
    ("MIT", "permission hereby granted", "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "permission hereby granted", "", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _AS_IS),
    ("ISC", "permission fee", "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "redistribution", "neither", _BSD + " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"),
    ("BSD-3-Clause", "redistribution neither", "", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "apache 2", "", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("Apache-2.0", "apache 2", "", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-2.0", "2", "lesser affero 3 library", _GNU.format("", "2")),
    ("GPL-2.0", "2", "lesser affero 3 library", _GNU_TERMS.format("", "2")),
    ("GPL-3.0", "3", "lesser affero 2", _GNU.format("", "3")),
    ("GPL-3.0", "3", "lesser affero 2", _GNU_TERMS.format("", "3")),
    ("LGPL-2.1", "lesser 2 1", "affero 3", _GNU.format("Lesser ", "2.1")),
    ("LGPL-2.1", "lesser 2 1", "affero 3", _GNU_TERMS.format("Lesser ", "2.1")),
    ("LGPL-3.0", "lesser 3", "affero 2", _GNU.format("Lesser ", "3")),
    ("LGPL-3.0", "lesser 3", "affero 2", _GNU_TERMS.format("Lesser ", "3")),
    ("AGPL-3.0", "affero 3", "lesser", _GNU.format("Affero ", "3")),
    ("AGPL-3.0", "affero 3", "lesser", _GNU_TERMS.format("Affero ", "3")),
    ("GPL-2.0", "2 1991", "lesser affero", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("GPL-3.0", "3 2007", "lesser affero", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("LGPL-3.0", "lesser 3 2007", "affero", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("AGPL-3.0", "affero 3 2007", "lesser", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("MPL-2.0", "mozilla 2", "", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSL-1.0", "permission boost", "", "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("Unlicense", "free unencumbered", "", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "warranty freely", "", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
)
MARKS = ("license", "licence", "licensed", "licenced", "released", "distributed", "spdx", "redistribution", "redistribute", "permission", "unencumbered")
#: A text is looked at if it holds a mark, whatever the case and whatever stands beside it.
_ANY = "|".join(MARKS)
#: Names of license files.
FILES = r"(?i)(^|/)(un)?licen[sc]es?([._-][^/]*)?$|(^|/)copying([._-][^/]*)?$"
_WORD = re.compile("(?<![a-z0-9])v(?=[0-9])|[a-z0-9]+")


def split(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def terms(words: list[str]) -> Counter:
    """Words and pairs of neighbouring words with their times."""
    return Counter(words) + Counter(zip(words, words[1:]))


@lru_cache(maxsize=1)
def templates() -> list[tuple[str, list[str], frozenset, frozenset]]:
    """(license, words, must, must not) of all notices and wordings."""
    out = {}
    for license_, (names, must, never) in NAMES.items():
        for name in names:
            for notice in NOTICES:
                out[tuple(split(notice.format(name)))] = license_, must, never
        out[tuple(split(NOTICES[-1].format(license_)))] = license_, must, never
    for license_, must, never, text in WORDINGS:
        out[tuple(split(text))] = license_, must, never
    return [(name, list(w), frozenset(must.split()), frozenset(never.split()) - set(must.split())) for w, (name, must, never) in out.items()]


@lru_cache(maxsize=1)
def weights() -> tuple[dict, float, list[dict]]:
    """(inverse document frequency of each term over the templates, that of other terms, unit vector of each template)."""
    counts = [terms(w) for _, w, _, _ in templates()]
    n, held = len(counts), Counter(t for c in counts for t in c)
    idf = {t: math.log((n + 1) / (k + 1)) + 1 for t, k in held.items()}
    vectors = []
    for c in counts:
        v = {t: (1 + math.log(k)) * idf[t] for t, k in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / size for t, x in v.items()})
    return idf, math.log(n + 1) + 1, vectors


@lru_cache(maxsize=1)
def by_mark() -> dict[str, list[tuple[int, int]]]:
    """(template, offset) of each mark word."""
    out: dict[str, list[tuple[int, int]]] = {}
    for i, (_, words, _, _) in enumerate(templates()):
        for offset, w in enumerate(words):
            if w in MARKS:
                out.setdefault(w, []).append((i, offset))
    return out


@lru_cache(maxsize=50_000)
def cosine(window: tuple[str, ...], template: int) -> float:
    """Cosine of a window's vector to a template's; 0 where the window lacks what tells the template, or has what tells others."""
    _, _, must, never = templates()[template]
    held = set(window)
    if not must <= held or never & held:
        return 0.0
    idf, other, vectors = weights()
    v = {t: (1 + math.log(k)) * idf.get(t, other) for t, k in terms(list(window)).items()}
    return round(sum(x * vectors[template].get(t, 0.0) for t, x in v.items()) / math.sqrt(sum(x * x for x in v.values())), 9)


def best(text: str) -> tuple[str | None, float | None, float]:
    """(license, similarity, share of the text's words that lie in windows of the threshold) of one text."""
    words = split(text)
    held = set(words)
    found, spans = None, []
    known = templates()
    able = [must <= held for _, _, must, _ in known]
    for mark, places in by_mark().items():
        if mark not in held:
            continue
        for at in (i for i, w in enumerate(words) if w == mark):
            for template, offset in places:
                name, pattern, _, _ = known[template]
                start = at - offset
                if not able[template]:
                    continue
                start, end = max(start, 0), start + len(pattern)
                window = tuple(words[start:end])
                similarity = cosine(window, template)
                if similarity >= LEAST:
                    spans.append((start, start + len(window)))
                    rank = (similarity, len(pattern), name)
                    found = rank if found is None else max(found, rank)
    covered, upto = 0, 0
    for a, b in sorted(set(spans)):
        covered += max(0, b - max(a, upto))
        upto = max(upto, b)
    return (found[2], found[0], covered / len(words)) if found else (None, None, 0.0)


@arrow_udf(T.StructType([T.StructField("license", T.StringType()), T.StructField("similarity", T.DoubleType()), T.StructField("covered", T.DoubleType())]))
def license_udf(texts: pa.Array) -> pa.Array:
    """The license of each whole text; equal texts of a batch are read once."""
    known = pa.compute.dictionary_encode(pa.compute.fill_null(texts, ""))
    maybe = pa.compute.match_substring_regex(known.dictionary, _ANY, ignore_case=True).to_pylist()
    rows = [best(t) if m else (None, None, 0.0) for t, m in zip(known.dictionary.to_pylist(), maybe)]
    kinds = (pa.string(), pa.float64(), pa.float64())
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(3)], ["license", "similarity", "covered"]).take(known.indices)


def directory(path: Column) -> Column:
    """All of a path before its last slash; null for none."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", ""))


def scan(files: DataFrame) -> DataFrame:
    """files (id, path, text) with license, how (own, inherited or none), similarity and from_path, a row for each; text goes."""
    keep = [c for c in files.columns if c != "text"]
    own = files.select(*keep, directory(F.col("path")).alias("_dir"), license_udf("text").alias("_own"))
    own = written(own, "license-own")
    named = F.col("path").rlike(FILES)
    gives = named | (F.col("_own.covered") >= COVERED)
    given = own.filter(F.col("_own.license").isNotNull() & F.col("_dir").isNotNull() & gives)
    given = given.groupBy("_dir").agg(F.max(F.struct(named.alias("named"), "_own.similarity", "_own.license", "path")).alias("_given")).withColumnRenamed("_dir", "_at")
    dirs = own.select("_dir").filter("_dir is not null").distinct()
    parts = F.split("_dir", "/")
    above = dirs.select("_dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("_at")))).alias("a")).select("_dir", "a.*")
    near = written(above.join(given, "_at").groupBy(F.col("_dir").alias("_in")).agg(F.max_by("_given", "depth").alias("_given")), "license-dirs")
    out = own.join(small(near), F.col("_dir") == F.col("_in"), "left")
    mine, theirs = F.col("_own.license").isNotNull(), F.col("_given").isNotNull()
    how = F.when(mine, "own").when(theirs, "inherited").otherwise("none")
    value = lambda field: F.when(mine, F.col(f"_own.{field}")).otherwise(F.col(f"_given.{field}"))
    return out.select(*keep, value("license").alias("license"), how.alias("how"), value("similarity").alias("similarity"), F.when(mine, F.col("path")).otherwise(F.col("_given.path")).alias("from_path"))


def documents_as_files(docs: DataFrame) -> DataFrame:
    """documents as a tree of files, source/thousand/hundred/doc_id: a layout for a table that has no paths."""
    path = F.concat_ws("/", F.lit("documents"), F.coalesce("source", F.lit("unknown")), F.concat(F.lit("k"), F.floor(F.col("doc_id") / 1000)), F.concat(F.lit("c"), F.floor(F.col("doc_id") / 100)), F.col("doc_id"))
    return docs.select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")


def pages_as_files(pages: DataFrame) -> DataFrame:
    """pages as the files of their addresses, host/directories/name, with the text between the tags."""
    path = F.regexp_replace(F.regexp_replace("url", "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "[?#].*$", "")
    return pages.select(F.lit("pages").alias("kind"), F.col("page_id").alias("id"), path.alias("path"), F.regexp_replace("html", "(?s)<[^>]*>", " ").alias("text"))


def scan_documents(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """A license, where there is one, for each document and page."""
    return scan(documents_as_files(docs).unionByName(pages_as_files(pages)))
