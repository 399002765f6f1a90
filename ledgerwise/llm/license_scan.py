"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by path.

Native DataFrame code only. A file's segments are its lines, its comments (runs of neighbouring comment
lines, delimited comments) and, if its name is that of a licence file, also its whole text. With corpus_idf
every term has the document frequency it has over all files; without, only the templates' terms do and
all others weigh as one that no file has. A segment can only reach the least cosine with a template
if it has one of the template's heaviest terms (those without which the rest is too light), so only files
and lines with such a term are taken apart; none that can match is left out.
A file without a licence of its own gets that of the licence file in its nearest directory above.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written

#: (licence, notice). Common short notices in public use.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
]
#: SPDX identifiers, and names as notices give them. Fixed values.
IDS = (
    "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 "
    "GPL-1.0-only GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later "
    "MIT MIT-0 MPL-1.1 MPL-2.0 PSF-2.0 Unlicense WTFPL Zlib").split()
NAMES = [
    ("AGPL-3.0", "GNU Affero General Public License, version 3"), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("BSL-1.0", "Boost Software License, Version 1.0"), ("EPL-2.0", "Eclipse Public License, version 2.0"), ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"), ("ISC", "ISC License"), ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"), ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("MIT", "MIT License"), ("MPL-2.0", "Mozilla Public License, version 2.0"), ("Unlicense", "Unlicense"), ("Zlib", "zlib License"),
]
PARTS = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
TEMPLATES += [(x.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {x}") for x in IDS]
TEMPLATES += [(x, f"{how} the {name}") for x, name in NAMES for how in ("Licensed under", "This work is licensed under", "Released under")]
TEMPLATES += [(f"CC-{x}-{v}", text) for v in ("4.0", "3.0") for x in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for text in (
    f"SPDX-License-Identifier: CC-{x}-{v}", f"Licensed under CC {x} {v}",
    f"This work is licensed under a Creative Commons {'-'.join(PARTS[p] for p in x.split('-'))} {v} International License")]
TEMPLATES += [
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: (licence, header). The headers that the licences' own appendices give. For comments and whole files.
_GNU = "This {0} is free software{3} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation{4} either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. You should have received a copy of the GNU {1} along with this {0}. If not, see http://www.gnu.org/licenses/."
HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-2.0", _GNU.format("program", "General Public License", "2", ";", ";")),
    ("GPL-3.0", _GNU.format("program", "General Public License", "3", ":", ",")),
    ("LGPL-2.1", _GNU.format("library", "Lesser General Public License", "2.1", ";", ";")),
    ("LGPL-3.0", _GNU.format("program", "Lesser General Public License", "3", ":", ",")),
    ("AGPL-3.0", _GNU.format("program", "Affero General Public License", "3", ":", ",")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]
#: The numbers of a template of fewer terms must be in what matches it, so one version isn't taken for another.
NUMBERED = 150
#: Terms of the heads of licence texts that are templates, too.
HEADS = (50, 150)
#: A line of a comment, and comments between delimiters.
COMMENT_LINE = r"[ \t]*+(?://|/\*|\*|#|--|;|%|<!--)"
COMMENT = r'(?s)/\*.*?\*/|<!--.*?-->|""".*?"""'
#: Beginnings and ends of delimited comments that differ.
DELIMITERS = (("/*", "*/"), ("<!--", "-->"))
#: A term is common if one of so many files has it; a corpus has at most so many times a file's terms of these.
COMMON = 1000
#: Weights of templates (a row for each term of each) and common terms are broadcast up to so many rows, and beyond joined by a shuffle.
MOST_WEIGHTS = 200_000
LICENSE_FILE = r"(?i)^(license|licence|copying)([.-][a-z0-9.]+)?$"
LEAST = 0.7


def _words(text: Column) -> Column:
    """Runs of ASCII letters and digits, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+"), "")


def _closed(text: Column) -> Column:
    """The text with blanks in place of beginnings of comments that have no end, so that no search for one runs to the text's end."""
    for begin, end in DELIMITERS:
        rest = F.substring_index(text, end, -1)  # behind the last end
        text = F.concat(F.left(text, F.length(text) - F.length(rest)), F.replace(rest, F.lit(begin), F.lit(" " * len(begin))))
    return text


def terms_of(text: str) -> list[str]:
    import re

    return [x for x in re.split("[^a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the headers, the files in `licenses` and their heads, for comments and whole files."""
    files = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(Path(__file__).with_name("licenses").glob("*.txt"))]
    heads = [(name, " ".join(terms_of(text)[:n])) for name, text in files for n in HEADS if len(terms_of(text)) > 2 * n]
    return HEADERS + files + heads


def numbers(text: str) -> int:
    """How many numbers a match must have: the distinct ones of a short template."""
    terms = terms_of(text)
    return len({t for t in terms if t.isdigit()}) if len(terms) < NUMBERED else 0


def template_weights(templates: Iterable[tuple[str, str]], idf: dict[str, float], least: float) -> tuple[list[tuple[str, int, str, float]], set[str]]:
    """((licence, template number, term, weight in a unit vector) ..., the terms that a match must have one of)."""
    rows, needed = [], set()
    for n, (name, text) in enumerate(templates):
        terms = terms_of(text)
        weight = {t: terms.count(t) * idf[t] for t in set(terms)}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        left = 1.0
        for t, w in sorted(weight.items(), key=lambda x: (-x[1], x[0])):
            if left >= least * least * (1 - 1e-9):
                needed.add(t)
            left -= (w / norm) ** 2
            rows.append((name, n, t, w / norm))
    return rows, needed


def scan(files: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", texts: list[tuple[str, str]] | None = None, corpus_idf: bool = False, comments: bool = False) -> DataFrame:
    """files(id, path, text) -> (doc_id, path, license, score, how, from_path), a row for each row.

    how: `own` (a line of the file, or a licence file itself), `inherited` (from_path is the licence file)
    or null. score: cosine with the best template, at `least` or more; ties go to the first licence by
    name. A match has all numbers of a template of fewer than NUMBERED terms. Of several licence files in one directory the best score counts, then the smaller path. A null
    or empty text has no licence of its own; a null path inherits nothing. Rows with the same path and
    text get the same result; no files give no rows; other columns, whatever their names, are ignored. Lines and
    texts of any length are read whole.
    texts: long templates, compared with whole licence files and comments, not with single lines.
    corpus_idf: document frequencies of all terms, not of the templates' alone. comments: a file's comments
    are segments, each run of comment lines, each part of one between empty lines, and each delimited comment.
    """
    spark = files.sparkSession
    templates = TEMPLATES if templates is None else templates
    texts = texts or []
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tag", F.xxhash64("text"))
    known = sorted({t for _, text in [*templates, *texts] for t in terms_of(text)})
    total, counts = files.count(), dict.fromkeys(known, 0)
    if corpus_idf:
        held = written(rows.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n")), "counts")
        ours = held.where(F.col("term").isin(known)).collect()  # at most a row for each template term
    else:
        hold = F.array_intersect(_words(F.col("text")), F.array(*map(F.lit, known)).cast("array<string>"))
        ours = rows.select(F.explode(hold).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()  # as above
    counts |= {r["term"]: r["n"] for r in ours}
    idf = {t: math.log((1 + total) / (1 + n)) + 1 for t, n in counts.items()}
    other = math.log(1 + total) + 1
    weights, needed = template_weights(templates, idf, least)
    long, needed_long = template_weights(texts, idf, least)
    least_numbers = [numbers(text) for _, text in [*templates, *texts]]
    weights = [(*w, False) for w in weights] + [(name, n + len(templates), t, part, True) for name, n, t, part in long]
    weights = [(*w, least_numbers[w[1]], bool(least_numbers[w[1]]) and w[2].isdigit()) for w in weights]
    must, must_long = (F.array(*map(F.lit, sorted(x))).cast("array<string>") for x in (needed, needed | needed_long))

    # segments that may match: (path, tag, line), line 0 is the whole text of a licence file, a line below 0 a comment
    is_file = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE), F.lit(False))
    hint = rf"(?i)(?<![a-z0-9])({'|'.join(sorted(needed)) or '(?!)'})(?![a-z0-9])"
    lines = rows.where(F.col("text").rlike(hint)).select("path", "tag", F.posexplode(F.split("text", "\r?\n|\r")).alias("pos", "segment")).select("path", "tag", (F.col("pos") + 1).alias("line"), "segment")
    lines = lines.withColumn("words", _words(F.col("segment"))).where(F.arrays_overlap("words", must))
    whole = rows.where(is_file).select("path", "tag", F.lit(0).alias("line"), F.col("text").alias("segment"))
    if comments:
        some = rows.where(F.col("text").rlike(rf'(?m)^{COMMENT_LINE}|/\*|<!--|"""'))
        runs = F.split("text", rf"(?m)^(?!{COMMENT_LINE}).*$")
        parts = F.split("text", rf"(?m)^(?!{COMMENT_LINE}.*[A-Za-z0-9]).*$")
        every = F.array_distinct(F.concat(runs, parts, F.regexp_extract_all(_closed(F.col("text")), F.lit(COMMENT), F.lit(0))))
        some = some.select("path", "tag", F.posexplode(every).alias("pos", "segment")).select("path", "tag", (-1 - F.col("pos")).alias("line"), "segment")
        whole = whole.unionByName(some)
    whole = whole.withColumn("words", _words(F.col("segment"))).where(F.arrays_overlap("words", must_long))
    segments = lines.unionByName(whole)
    key = ["path", "tag", "line"]
    terms = segments.select(*key, F.explode("words").alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    if corpus_idf:
        # common terms, of which there are few, are broadcast: each may be in a large part of the segments
        found, common = written(terms, "segments"), held.where(F.col("n") * COMMON >= total)
        common, terms = (F.broadcast(common) if common.count() <= MOST_WEIGHTS else common), found
        rest = terms.join(common.select("term"), "term", "left_anti").join(held.where(F.col("n") * COMMON < total), "term", "left")
        terms = terms.join(common, "term").unionByName(rest)
        weight = F.log((F.lit(1) + total) / (1 + F.coalesce("n", F.lit(0)))) + 1
    else:
        terms = terms.join(F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double")), "term", "left")
        weight = F.coalesce("idf", F.lit(other))
    terms = written(terms.select(*key, "term", (F.col("tf") * weight).alias("w")), "terms")
    norms = terms.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    few = len(weights) <= MOST_WEIGHTS
    weights = spark.createDataFrame(weights, "license string, template int, term string, part double, long boolean, numbers int, number boolean")
    dots = terms.join(F.broadcast(weights) if few else weights, "term").where("line <= 0 OR NOT long").groupBy(*key, "license", "template").agg(
        F.sum(F.col("w") * F.col("part")).alias("dot"), F.count_if("number").alias("held"), F.max("numbers").alias("numbers")).where("held = numbers")
    same = [dots[c].eqNullSafe(norms[c]) for c in key]
    scored = dots.join(norms, same[0] & same[1] & same[2]).select(dots["path"], dots["tag"], "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= least)
    own = scored.groupBy("path", "tag").agg(F.max("score").alias("score"), F.min_by("license", F.struct((-F.col("score")).alias("s"), "license")).alias("license"))
    own = written(own, "own")
    dropped(terms, *((held, found) if corpus_idf else ()))

    # the licence of each directory, then of the nearest one above or at each directory that has files
    folder = F.when(F.col("path").isNotNull(), F.regexp_replace("path", "[^/]*$", ""))
    of_folder = own.where(is_file).withColumn("folder", folder).groupBy("folder").agg(F.min_by(F.struct("license", "score", "path"), F.struct((-F.col("score")).alias("s"), "path")).alias("up"))
    of_folder = written(of_folder, "folders")
    folders = rows.select(folder.alias("folder")).where("folder IS NOT NULL").distinct()
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))
    above = folders.select("folder", F.explode(F.array_distinct(above)).alias("over"))
    found = above.join(of_folder.withColumnRenamed("folder", "o"), F.col("over") == F.col("o")).groupBy("folder").agg(F.max_by("up", F.length("over")).alias("up"))
    found = written(found.withColumnRenamed("folder", "f"), "inherited")
    dropped(of_folder)
    out = rows.select("doc_id", "path", "tag", folder.alias("folder"))
    own = own.select(F.col("path").alias("p"), F.col("tag").alias("t"), F.col("license").alias("own"), F.col("score").alias("own_score"))
    out = out.join(own, out["path"].eqNullSafe(own["p"]) & (out["tag"] == own["t"]), "left").join(found, F.col("folder") == F.col("f"), "left")
    has = F.col("own").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("own", "up.license").alias("license"), F.when(has, F.col("own_score")).otherwise(F.col("up.score")).alias("score"),
        F.when(has, "own").when(F.col("up").isNotNull(), "inherited").alias("how"), F.when(~has, F.col("up.path")).alias("from_path"))
