"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

Units are pieces of a text of any length:

- short: a line, and a line joined with the next one (wrapped headers), compared with the notices, templates of one sentence;
Texts that speak of licences, which all templates do, give longer units too:

- blocks: what lies between lines without words, and runs of comment lines or of other lines, in one line or many, up to LONG words, if they speak of licences;
- windows: around each word that is rare among the templates, as many words as the template has, placed as in the template. They find a header with code right after it, a body inside a page-long paragraph and any part of a licence file.

Blocks and windows are compared with all templates, standard headers, openings and titles of long licences and bodies of short ones among them. Comment marks don't matter, as only words count. Words are runs of
a-z (A-Z folded) or numbers with points, without function words. A unit's vector has tf x idf for the templates' words and, for each other distinct word, the idf of an unseen word once; idf is taken over the
templates, a fixed table, so a score does not depend on what else is in the corpus. The best template with a cosine of at least `threshold` wins; ties go to the first name.

Prefix filter: a short unit without any of a notice's heaviest words, those beyond which the rest has a norm below the threshold, cannot
reach it; so one pattern over the text finds all short units that can match, without loss. All of this is one projection. Left to windows alone are blocks of more than LONG words; there, an altered text that keeps
none of a template's three rarest words is not found.

Inheritance: each directory takes the best licence of its licence files; each directory in use looks up its ancestors, itself first; files
without a licence of their own join their directory's. Joins see one row per directory on their small side, so a directory of any
size only lengthens the other one, which Spark can split.

Nulls: a null text has no units; a null path belongs to no directory, gets nothing and gives nothing. Empty texts have no licence of their own.
Repeated rows give repeated results. Extra columns are ignored."""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (licence, statement) pairs, the usual wording of notices (fixed values).
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the simplified BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the revised BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the Eclipse Public License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Templates that lines are compared with; those below are for longer units.
NOTICES = len(TEMPLATES)
#: Bodies of short licences, standard headers and openings of long ones (fixed values).
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_END = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details. You should have received a copy of the GNU {} along with this program. If not, see https://www.gnu.org/licenses/."
_COPYING = "GNU {} Version {}, {} Copyright (C) {} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_GNU = {"GPL-2.0": ("General Public License", "2", "June 1991", "1989, 1991"), "GPL-3.0": ("General Public License", "3", "29 June 2007", "2007"), "LGPL-2.1": ("Lesser General Public License", "2.1", "February 1999", "1991, 1999"), "LGPL-3.0": ("Lesser General Public License", "3", "29 June 2007", "2007"), "AGPL-3.0": ("Affero General Public License", "3", "19 November 2007", "2007")}
TEMPLATES += [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_THIRD + _BSD_END),
    ("ISC", _ISC),
    ("MIT", _GRANT + " " + _MIT_END),
    ("MIT", _GRANT),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", _UNLICENSE),
    *[(k, _FREE.split(" This program is distributed")[0].format(name, version)) for k, (name, version, _, _) in _GNU.items()],
    *[(k, _FREE.format(name, version, name, name)) for k, (name, version, _, _) in _GNU.items()],
    *[(k, _COPYING.format(name, version, day, years)) for k, (name, version, day, years) in _GNU.items()],
]
TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LICENSE_FILE = r"^(licen[cs]e|copying|unlicense)([.-][a-z0-9.]+)?$"
#: Words of the templates that any text may hold (fixed values); the prefix filter does without them where it can.
COMMON = frozenset(
    "available code copy deal form free made materials person program source subject terms version work all along also anyone agreed along appear applicable associated author authors basis be business c claim charge code compiled "
    "conditions contributes dealings defined details derived distribute distributed do document domain each entity everyone february files following from general have http https if inc including individual international it its january june later legal "
    "may mean more no non notice november obtaining on one option or other out owns part permitted provided public published purpose receive received revised right rights see subject that these use used v was were whether at can caused means name names through should www will it as an so way such above direct either even list met particular special useful hope action connection performance sections included which whom with your you".split()
)
THRESHOLD = 0.8
#: Between two blocks: a line without words.
GAP = r"\n[ \t*#/;-]*\n"
#: How a comment line starts: a block changes where lines of one kind follow those of the other.
COMMENT = r"^[ \t]*(//|#|/?\*|--|;|%|<!--|rem |dnl )"
#: Words that a text must hold one of for its blocks and windows to be units (fixed values); a template with none of them adds its own, see speaking().
SPEAKS = "license licensed licenses licence copyright warranty warranties redistribution redistributions redistribute".split()

#: Function words, which count neither in templates nor in texts (fixed values).
STOP = "a and any are by for in into is of the this to under without".split()
_TF = [Counter(t for t in re.findall(TERM, text.lower()) if t not in STOP) for _, text in TEMPLATES]
_DF = Counter(t for c in _TF for t in c)
IDF = {t: math.log((1 + len(TEMPLATES)) / (1 + n)) + 1 for t, n in sorted(_DF.items())}
UNSEEN = math.log(1 + len(TEMPLATES)) + 1
#: For each template the weight of each of its words in a unit's dot product: tf x idf of the template over its norm, times idf.
WEIGHTS = [{t: n * IDF[t] ** 2 / math.sqrt(sum((k * IDF[u]) ** 2 for u, k in c.items())) for t, n in sorted(c.items())} for c in _TF]


#: Words of the longest block that is compared whole: twice the longest template.
LONG = 2 * max(sum(c.values()) for c in _TF)


def anchors(threshold: float = THRESHOLD) -> list[str]:
    """The words of which a short unit must hold one to reach the threshold with any notice."""
    out = set()
    for c in _TF[:NOTICES]:
        mass = sorted((t not in COMMON and not t[0].isdigit(), (k * IDF[t]) ** 2, t) for t, k in c.items())
        total, rest = sum(m for _, m, _ in mass), 0.0
        for _, m, t in mass:  # numbers, common and light words first: they stay out as long as they alone fall short
            rest += m
            if rest >= (threshold - 1e-6) ** 2 * total:
                out.add(t)
    return sorted(out)


def rarest(c: Counter, each: int = 3) -> list[str]:
    return sorted((t for t in c if not t[0].isdigit()), key=lambda t: (t in COMMON, -IDF[t], t))[:each]


def speaking() -> list[str]:
    """SPEAKS and the rarest words of each template that holds none of them."""
    return sorted(set(SPEAKS).union(*(rarest(c) for c in _TF[NOTICES:] if not set(SPEAKS) & set(c))))


def window_anchors(each: int = 3) -> dict[str, list[tuple[int, int]]]:
    """Word to (its place in a template, the template's length) for the rarest words of each template that isn't a notice; places and lengths count words, from 0."""
    out: dict[str, set[tuple[int, int]]] = {}
    for c, (_, text) in zip(_TF[NOTICES:], TEMPLATES[NOTICES:], strict=True):
        words = [t for t in re.findall(TERM, text.lower()) if t not in STOP]
        for t in rarest(c, each):
            out.setdefault(t, set()).add((words.index(t), len(words)))
    return {t: sorted(v) for t, v in sorted(out.items())}


def folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def best_templates(units: Column, count: int = len(TEMPLATES)) -> Column:
    """For each unit (array of words) the struct (score, turn = -template index) of its best template; scores are rounded to 6 digits, so that equal
    vectors tie. A word is looked up once, for its weights in all templates. Each step is a transform of the one before, so nothing is evaluated twice."""
    rows = {t: [IDF[t], *(w.get(t, 0.0) for w in WEIGHTS[:count])] for t in IDF}
    table = F.from_json(F.lit(json.dumps(rows)), "map<string,array<double>>")
    known = F.transform(units, lambda ws: F.struct(F.filter(ws, lambda w: F.map_contains_key(table, w)).alias("own"), F.size(F.array_distinct(ws)).alias("distinct")))
    terms = F.transform(known, lambda u: F.struct(u["own"].alias("own"), F.array_distinct(u["own"]).alias("terms"), u["distinct"].alias("distinct")))
    counts = F.transform(terms, lambda u: F.struct(F.transform(u["terms"], lambda t: F.struct(F.element_at(table, t).alias("w"), F.size(F.filter(u["own"], lambda w: w == t)).cast("double").alias("n"))).alias("tf"), (u["distinct"] - F.size(u["terms"])).alias("unseen")))
    zeros = F.array_repeat(F.lit(0.0), count + 1)
    # the first sum is that of squares, for the norm; the others are dot products
    sums = F.transform(counts, lambda u: F.aggregate(u["tf"], zeros, lambda s, e: F.zip_with(s, F.transform(e["w"], lambda w, i: F.when(i == 0, F.pow(e["n"] * w, F.lit(2.0))).otherwise(e["n"] * w)), lambda x, y: x + y), lambda s: F.struct(F.sqrt(F.get(s, 0) + u["unseen"] * F.lit(UNSEEN**2)).alias("norm"), F.slice(s, 2, count).alias("dots"))))
    return F.transform(sums, lambda u: F.array_max(F.transform(u["dots"], lambda x, i: F.struct(F.when(u["norm"] > 0, F.round(x / u["norm"], 6)).otherwise(F.lit(0.0)).alias("score"), (-i).alias("turn")))))


def holds(words: list[str]) -> str:
    return rf"(?<![a-z0-9])(?:{'|'.join(map(re.escape, words))})(?![a-z0-9])"


def own_licenses(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds own_license, score, turn (the template, for ties) and n_headers to rows with a text."""
    split = lambda unit: F.filter(F.regexp_extract_all(folded(unit), F.lit(f"({TERM})"), F.lit(1)), lambda w: ~w.isin(STOP))
    mark, long_mark = holds(anchors(threshold)), holds(speaking())
    none = F.array().cast("array<string>")
    # a unit is looked at only if it holds an anchor; a text without one has no units
    pairs = F.when(F.size("_lines") < 2, none).otherwise(F.transform(F.sequence(F.lit(0), F.size("_lines") - 2), lambda i: F.concat_ws("\n", F.get("_lines", i), F.get("_lines", i + 1))))
    d = files.withColumn("_low", folded(F.col("text")))
    d = d.withColumn("_any", F.coalesce(F.regexp_like("_low", F.lit(mark)), F.lit(False))).withColumn("_speaks", F.coalesce(F.regexp_like("_low", F.lit(long_mark)), F.lit(False)))
    d = d.withColumn("_lines", F.when(F.col("_any") | F.col("_speaks"), F.split("_low", "\n")).otherwise(none))
    short = F.when(F.col("_any"), F.filter(F.concat("_lines", pairs), lambda x: F.regexp_like(x, F.lit(mark)))).otherwise(none)
    comment = lambda x: F.regexp_like(x, F.lit(COMMENT))
    parted = F.array_join(F.transform("_lines", lambda x, i: F.when((i > 0) & (comment(x) != comment(F.get("_lines", i - 1))), F.concat(F.lit("\n"), x)).otherwise(x)), "\n")
    blocks = F.when(F.col("_speaks"), F.filter(F.array_union(F.split("_low", GAP), F.split(parted, GAP)), lambda x: F.regexp_like(x, F.lit(long_mark)))).otherwise(none)
    d = d.withColumn("_short", F.transform(short, split)).withColumn("_blocks", F.filter(F.transform(blocks, split), lambda ws: F.size(ws) <= LONG))
    # windows: for each place of an anchor, the words that lie as the template's do around it
    at = F.from_json(F.lit(json.dumps({t: [{"o": o, "n": n} for o, n in v] for t, v in window_anchors().items()})), "map<string,array<struct<o:int,n:int>>>")
    d = d.withColumn("_words", F.when(F.col("_speaks"), split(F.col("text"))).otherwise(none))
    places = F.flatten(F.filter(F.transform("_words", lambda w, p: F.transform(F.try_element_at(at, w), lambda x: F.struct(F.greatest(p - x["o"], F.lit(0)).alias("from"), x["n"].alias("n")))), lambda x: x.isNotNull()))
    d = d.withColumn("_at", F.array_distinct(places)).withColumn("_windows", F.transform("_at", lambda x: F.slice("_words", x["from"] + 1, x["n"])))
    d = d.withColumn("_best", F.concat(best_templates(F.col("_short"), NOTICES), best_templates(F.concat("_blocks", "_windows")))).withColumn("_hits", F.filter("_best", lambda b: b["score"] >= threshold))
    top = F.array_max("_hits")
    names = F.array(*[F.lit(n) for n, _ in TEMPLATES])
    out = d.withColumn("own_license", F.when(top.isNotNull(), F.element_at(names, (1 - top["turn"]).cast("int")))).withColumn("score", F.coalesce(top["score"], F.lit(0.0))).withColumn("turn", top["turn"]).withColumn("n_headers", F.size("_hits").cast("long"))
    return out.drop("_low", "_any", "_speaks", "_lines", "_short", "_blocks", "_words", "_at", "_windows", "_best", "_hits")


def scan_licenses(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, own_license, score (cosine of the best header, 0 without one), n_headers (units at or over the threshold), license (own or
    inherited), license_from ('own', the directory it comes from, or null)."""
    f = files.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{path_col}`").alias("path"))
    f = f.withColumn("dir", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit("")))
    f = f.withColumn("is_file", F.coalesce(F.regexp_like(folded(F.substring_index("path", "/", -1)), F.lit(LICENSE_FILE)), F.lit(False)))
    found = own_licenses(f, threshold).drop("text")
    # licence files alone, a small part of all files, are scored a second time here
    notices = own_licenses(f.where("is_file and dir is not null"), threshold)
    best = F.max(F.when(F.col("own_license").isNotNull(), F.struct("score", "turn", F.col("own_license").alias("license"))))
    given = notices.groupBy(F.col("dir").alias("up")).agg(best.alias("best")).where("best is not null").select("up", "best.license")
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dirs = f.select("dir").where("dir is not null").distinct()
    near = dirs.select("dir", F.posexplode(ups).alias("depth", "up")).join(given, "up").groupBy("dir").agg(F.max_by(F.struct("license", "up"), "depth").alias("near"))
    out = found.join(near, "dir", "left")
    return out.select("doc_id", "path", "own_license", "score", "n_headers", F.coalesce("own_license", "near.license").alias("license"), F.when(F.col("own_license").isNotNull(), "own").otherwise(F.col("near.up")).alias("license_from"))


def with_paths(docs: DataFrame) -> DataFrame:
    """documents has no paths: a document lies at <source>/<thousand>/<hundred>/<id>.txt, and the one with an even hundred's id is that directory's LICENSE."""
    name = F.when(F.col("doc_id") % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", "text", F.concat_ws("/", F.coalesce("source", F.lit("-")), F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string"), name).alias("path"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(with_paths(table(spark, sf_dir, "documents")))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


SQL = f"""
WITH tw(i, t, w) AS (VALUES {_values([(i, t, w) for i, ws in enumerate(WEIGHTS) for t, w in ws.items()])}),
idf(t, v) AS (VALUES {_values(list(IDF.items()))}),
names(i, n) AS (VALUES {_values([(i, n) for i, (n, _) in enumerate(TEMPLATES)])}),
f AS (SELECT doc_id, text, coalesce(source, '-') || '/' || (doc_id // 1000) || '/' || (doc_id // 100) AS dir, doc_id % 100 = 0 AS is_file FROM documents),
l AS (SELECT doc_id, text, string_split(translate(text, '{UPPER}', '{LOWER}'), chr(10)) AS l FROM f),
b AS (SELECT doc_id, list_distinct(list_concat(string_split_regex(array_to_string(l, chr(10)), '{GAP}'), string_split_regex(array_to_string(list_transform(l, lambda x, i: CASE WHEN i > 1 AND regexp_matches(x, '{COMMENT}') <> regexp_matches(l[i - 1], '{COMMENT}') THEN chr(10) || x ELSE x END), chr(10)), '{GAP}'))) AS b FROM l),
un AS (SELECT doc_id, unnest(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || chr(10) || l[i + 1]))) AS u, false AS long FROM l UNION ALL SELECT doc_id, u, true FROM (SELECT doc_id, unnest(b) AS u FROM b) WHERE regexp_matches(u, '(^|[^a-z0-9])({"|".join(speaking())})([^a-z0-9]|$)')),
un1 AS (SELECT doc_id, long, list_filter(regexp_extract_all(u, '{TERM}'), lambda w: w NOT IN ({", ".join(map(repr, STOP))})) AS ws FROM un),
spots(t, o, n) AS (VALUES {_values([(t, o, n) for t, v in window_anchors().items() for o, n in v])}),
dw AS (SELECT doc_id, list_filter(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}'), lambda w: w NOT IN ({", ".join(map(repr, STOP))})) AS ws FROM f WHERE regexp_matches(translate(text, '{UPPER}', '{LOWER}'), '(^|[^a-z0-9])({"|".join(speaking())})([^a-z0-9]|$)')),
wp AS (SELECT DISTINCT doc_id, greatest(p - o, 0) AS s, n FROM (SELECT doc_id, unnest(ws) AS t, unnest(range(len(ws))) AS p FROM dw) JOIN spots USING (t)),
un2 AS (SELECT row_number() OVER () AS k, * FROM (SELECT doc_id, long, ws FROM un1 WHERE NOT long OR len(ws) <= {LONG} UNION ALL SELECT doc_id, true, ws[s + 1:s + n] FROM wp JOIN dw USING (doc_id))),
un3 AS (SELECT k, doc_id, long, unnest(ws) AS t FROM un2),
tf AS (SELECT k, doc_id, long, t, count(*) AS n FROM un3 GROUP BY ALL),
nrm AS (SELECT k, doc_id, sqrt(sum(CASE WHEN v IS NULL THEN {UNSEEN!r} ** 2 ELSE (n * v) ** 2 END)) AS nrm FROM tf LEFT JOIN idf USING (t) GROUP BY ALL),
sc AS (SELECT doc_id, k, i, round(sum(n * w) / nrm, 6) AS s FROM tf JOIN tw USING (t) JOIN nrm USING (k, doc_id) WHERE long OR i < {NOTICES} GROUP BY doc_id, k, i, nrm),
hits AS (SELECT doc_id, k, max(s) AS s, first(i ORDER BY s DESC, i) AS i FROM sc GROUP BY ALL HAVING max(s) >= {THRESHOLD}),
o AS (SELECT doc_id, max(s) AS score, first(i ORDER BY s DESC, i) AS i, count(*) AS n FROM hits GROUP BY ALL),
own2 AS (SELECT doc_id, dir, is_file, i, coalesce(o.n, 0) AS n_headers, coalesce(score, 0.0) AS score, names.n AS lic FROM f LEFT JOIN o USING (doc_id) LEFT JOIN names USING (i)),
g AS (SELECT dir AS up, first(lic ORDER BY score DESC, i) AS lic FROM own2 WHERE is_file AND lic IS NOT NULL GROUP BY dir),
d AS (SELECT DISTINCT dir FROM f),
a AS (SELECT dir, unnest(list_transform(range(1, len(string_split(dir, '/')) + 1), lambda n: array_to_string(string_split(dir, '/')[1:n], '/'))) AS up FROM d),
nr AS (SELECT dir, arg_max(lic, length(up)) AS lic, arg_max(up, length(up)) AS up FROM a JOIN g USING (up) GROUP BY dir)
SELECT doc_id, dir || '/' || CASE WHEN doc_id % 100 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS path, own2.lic AS own_license, score, n_headers, coalesce(own2.lic, nr.lic) AS license,
  CASE WHEN own2.lic IS NOT NULL THEN 'own' ELSE nr.up END AS license_from FROM own2 LEFT JOIN nr USING (dir)
"""
