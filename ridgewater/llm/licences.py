"""Licences of files: TF-IDF cosine of statements, headers and whole texts to templates, then inheritance from directories.

Every line of a text that speaks of a licence is a statement, in headers and licence files alike, and is compared with
short statements. The header (a leading comment, or else the first paragraph) and the whole text of a file with legal
words are compared with notices and full licence texts. Terms are the lower-cased letter and digit runs; their weights are
(1 + ln tf) * idf, with idf counted over the templates of that kind, so what a file gets does not depend on the other
files of the input; terms of no template weigh as the rarest. A file's own licence is the template with the highest
cosine to its header or text, if that reaches ``like_text``, else to any of its statements, if that reaches ``like`` (a
bare reservation of rights after all others; ties: the template first in alphabetical order). A licence file is a file named like one
(LICENSE, COPYING, NOTICE, with any ending) or one at least half of whose words stand in matching parts; it speaks
for its directory (several: the licence most of them have, then the first in alphabetical order). A file without an own
licence takes that of the nearest directory above it, found by joining all its ancestors with the directories that
have one; ties cannot occur, since ancestors differ in depth.

Templates are few and are broadcast with their weights; everything that follows the data is joined by keys. Built-in
functions only. Null or empty paths lie in no directory; null and empty texts have no statement; files that repeat a
path are files of their own. No rows in, no rows out.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgewater.llm.words import WORD
from ridgewater.session import stage

LIKE = 0.5
LIKE_TEXT = 0.8
SPEAKS = r"(?i)licen[sc]|copyright|spdx|creative\s+commons|all\s+rights\s+reserved|public\s+domain|\bcc\s+by\b"
NAMED = r"(?i)(?:^|/)(?:licen[sc]e|copying|copyright|notice|unlicense)[^/]*$"
LEGAL = SPEAKS + r"|permission\s+(?:is\s+hereby|to\s+use)|redistribution\s+and\s+use|free\s+software|unencumbered"
COMMENT = r"""^\s*(?:$|#|//|/\*|\*|--|;|%)"""
RESERVED = "Proprietary"
HEADER, WHOLE = -1, -2
HEADER_TERMS = "[a-z0-9]+"

# Short statements by which public licences are known.
TEMPLATES = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy under the MIT License."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


_FREE = (
    "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the "
    "Free Software Foundation{3} either version {4} of the License, or (at your option) any later version. This {0} is "
    "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2} for more details. You should have received a copy "
    "of the GNU {2} along with this {0}."
)
# What public licences ask to be put at the top of files.
NOTICES = [
    ("AGPL-3.0", _FREE.format("program", ":", "Affero General Public License", ",", "3")),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
    "implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", _FREE.format("program", ";", "General Public License", ";", "2")),
    ("GPL-3.0", _FREE.format("program", ":", "General Public License", ",", "3")),
    ("LGPL-2.1", _FREE.format("library", ";", "Lesser General Public License", ";", "2.1")),
    ("LGPL-3.0", _FREE.format("library", ":", "Lesser General Public License", ",", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
    "this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
# The clause that the Affero licence has beyond the general one, whose other terms it shares.
_REMOTE = (
    "Remote Network Interaction. Notwithstanding any other provision of this License, if you modify the Program, your modified version must "
    "prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity "
    "to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through "
    "some standard or customary means of facilitating copying of software."
)


def licence_texts() -> list[tuple[str, str]]:
    """Notices and full texts; read by the driver from beside this module."""
    folder = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licence_texts")
    texts = []
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8") as file:
            texts.append((name.removesuffix(".txt"), file.read()))
    general = dict(texts)["GPL-3.0"]
    affero = re.sub("(?i)GNU General Public License", "GNU Affero General Public License", general)
    return NOTICES + texts + [("AGPL-3.0", affero + _REMOTE)]


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(HEADER_TERMS), F.lit(0))


def template_weights(templates: list[tuple[str, str]]) -> tuple[dict[str, float], float, list[tuple[int, str, str, float]]]:
    """idf of the templates' terms, idf of other terms, and (template, licence, term, weight in a vector of length 1)."""
    bags = [Counter(re.findall(HEADER_TERMS, text.lower())) for _, text in templates]
    held = Counter(term for bag in bags for term in bag)
    idf = {term: math.log((1 + len(templates)) / (1 + n)) + 1 for term, n in held.items()}
    parts = []
    for i, ((licence, _), bag) in enumerate(zip(templates, bags)):
        weights = {term: (1 + math.log(n)) * idf[term] for term, n in bag.items()}
        long = math.sqrt(sum(w * w for w in weights.values()))
        parts += [(i, licence, term, w / long) for term, w in weights.items()]
    return idf, math.log(1 + len(templates)) + 1, parts


def statements(files: DataFrame) -> DataFrame:
    """row, place, line and n_words of each line that speaks of a licence."""
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"\r\n|[\n\x0b\x0c\r]"), lambda x: x.rlike(SPEAKS))
    # Most texts have none; they are passed over by one search.
    some = files.filter(F.col("text").rlike(SPEAKS))
    found = some.select("row", F.posexplode(lines).alias("place", "line"))
    return found.withColumn("n_words", F.size(F.regexp_extract_all("line", F.lit(WORD), F.lit(0))).cast("long"))


def texts_and_headers(files: DataFrame) -> DataFrame:
    """row, place (WHOLE or HEADER), line and n_words of each text with legal words and of its header, if that is less."""
    some = files.filter(F.col("text").rlike(LEGAL)).select("row", F.col("text"), F.split("text", r"\r\n|[\n\x0b\x0c\r]").alias("lines"))
    some = some.withColumn("starts", F.ltrim("text"))
    ends = F.array_position(F.transform("lines", lambda x: x.rlike(COMMENT)), False).cast("int")
    commented = F.array_join(F.slice("lines", F.lit(1), F.when(ends > 0, ends - 1).otherwise(F.size("lines"))), "\n")
    paragraph = F.get(F.split("starts", r"(?:\r\n|[\n\r])[ \t]*(?:\r\n|[\n\r])", 2), F.lit(0))
    header = F.when(F.col("starts").startswith("/*"), F.substring_index("starts", "*/", 1))
    header = header.when(F.col("starts").startswith("<!--"), F.substring_index("starts", "-->", 1))
    header = header.when(F.col("starts").startswith('"""'), F.substring_index("starts", '"""', 2))
    header = header.when(F.get("lines", F.lit(0)).rlike(COMMENT) & (F.trim(commented) != ""), commented).otherwise(paragraph)
    some = some.select("row", "text", header.alias("header"))
    some = some.select("row", F.col("text"), F.when(F.length(F.trim("header")) < F.length(F.trim("text")), F.col("header")).alias("header"))
    parts = F.map_from_arrays(F.array(F.lit(WHOLE), F.lit(HEADER)), F.array("text", "header"))
    found = some.select("row", F.explode(parts).alias("place", "line")).filter(F.col("line").rlike(LEGAL))
    return found.withColumn("n_words", F.size(F.regexp_extract_all("line", F.lit(WORD), F.lit(0))).cast("long"))


def matched(found: DataFrame, templates: list[tuple[str, str]], like: float = LIKE) -> DataFrame:
    """row, place, n_words, licence, cosine of the statements that match a template."""
    spark = found.sparkSession
    idf, rarest, parts = template_weights(templates)
    known = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))
    theirs = F.broadcast(spark.createDataFrame(parts, "template int, licence string, term string, part double"))
    bags = found.select("row", "place", F.explode(_terms(F.col("line"))).alias("term")).groupBy("row", "place", "term").agg(F.count(F.lit(1)).alias("tf"))
    weight = (1 + F.log("tf")) * F.coalesce("idf", F.lit(rarest))
    ours = stage(bags.join(known, "term", "left").select("row", "place", "term", weight.alias("weight")), "weights")
    ours_long = ours.groupBy("row", "place").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("long"))
    dots = ours.join(theirs, "term").groupBy("row", "place", "template", "licence").agg(F.sum(F.col("weight") * F.col("part")).alias("dot"))
    cosines = dots.join(ours_long, ["row", "place"]).withColumn("cosine", F.col("dot") / F.col("long"))
    # Rounded so that the order of sums does not decide ties.
    order = F.struct(-F.round("cosine", 9), F.col("licence").alias("licence"), F.col("cosine").alias("cosine"))
    best = cosines.groupBy("row", "place").agg(F.min(order).alias("best"))
    best = best.select("row", "place", F.col("best.licence").alias("licence"), F.round("best.cosine", 6).alias("cosine"))
    return best.filter(F.col("cosine") >= like).join(found.select("row", "place", "n_words"), ["row", "place"])


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: p != "")
    depth = F.size(parts) - 1
    upward = F.when(depth > 0, F.sequence(depth, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.transform(upward, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan(
    files: DataFrame,
    id_col: str,
    path: Column,
    text_col: str = "text",
    templates: list[tuple[str, str]] | None = None,
    like: float = LIKE,
    texts: list[tuple[str, str]] | None = None,
    like_text: float = LIKE_TEXT,
) -> DataFrame:
    """id, path, own_licence, cosine, is_licence_file, licence, licence_from (the directory, or the path itself)."""
    templates = TEMPLATES if templates is None else templates
    texts = licence_texts() if texts is None else texts
    rows = files.select(F.col(id_col).alias("id"), path.alias("path"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    narrow = stage(rows.select("row", "id", "path"), "paths")
    lines = matched(stage(statements(rows), "statements"), templates, like)
    wholes = matched(stage(texts_and_headers(rows), "texts"), texts, like_text)
    hits = stage(lines.unionByName(wholes), "matched")
    # Headers and whole texts say more than a line, and a line that grants something more than one that reserves all.
    after = F.when(F.col("place") < 0, 0).when(F.col("licence") != RESERVED, 1).otherwise(2)
    order = F.struct(after, -F.col("cosine"), F.col("licence").alias("licence"), F.col("cosine").alias("cosine"))
    in_lines = F.coalesce(F.sum(F.when(F.col("place") >= 0, F.col("n_words"))), F.lit(0))
    in_texts = F.coalesce(F.max(F.when(F.col("place") < 0, F.col("n_words"))), F.lit(0))
    own = hits.groupBy("row").agg(F.min(order).alias("best"), F.greatest(in_lines, in_texts).alias("stated"))
    # Word counts are needed of the files with a match only.
    sizes = rows.join(own.select(F.col("row").alias("__row")), F.col("row") == F.col("__row"), "left_semi")
    sizes = sizes.select("row", F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long").alias("size"))
    own = own.join(sizes, "row").select(
        "row", F.col("best.licence").alias("own_licence"), F.col("best.cosine").alias("cosine"), (F.col("stated") * 2 >= F.col("size")).alias("mostly")
    )
    known = stage(narrow.join(own, "row", "left"), "own")
    is_file = F.col("own_licence").isNotNull() & (F.coalesce(F.col("path").rlike(NAMED), F.lit(False)) | F.coalesce("mostly", F.lit(False)))
    known = known.withColumn("is_licence_file", is_file)
    above = F.get(ancestors(F.col("path")), F.lit(0))
    votes = known.filter("is_licence_file").groupBy(above.alias("directory"), "own_licence").agg(F.count(F.lit(1)).alias("n"))
    votes = votes.filter("directory is not null").groupBy("directory").agg(F.min(F.struct(-F.col("n"), F.col("own_licence").alias("licence"))).alias("best"))
    votes = stage(votes.select("directory", F.col("best.licence").alias("licence")), "directories")

    # Directories are few beside files: inherit once per directory, then join each file with its own.
    homes = known.filter("own_licence is null").select(above.alias("home")).filter("home is not null").distinct()
    steps = homes.select("home", F.posexplode(F.concat(F.array("home"), ancestors(F.col("home")))).alias("step", "directory"))
    nearest = steps.join(votes, "directory").groupBy("home").agg(F.min(F.struct("step", "directory", "licence")).alias("near"))
    nearest = nearest.select("home", F.col("near.directory").alias("from_directory"), F.col("near.licence").alias("inherited"))
    out = known.withColumn("home", F.when(F.col("own_licence").isNull(), above)).join(nearest, "home", "left")
    return out.select(
        "id",
        "path",
        "own_licence",
        "cosine",
        "is_licence_file",
        F.coalesce("own_licence", "inherited").alias("licence"),
        F.when(F.col("own_licence").isNotNull(), F.col("path")).otherwise(F.col("from_directory")).alias("licence_from"),
    )
