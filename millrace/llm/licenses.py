"""Licence texts and notices in documents, by digests of a canonical form.

Canonical form: lower case; statements of whose copyright it is are dropped from the lines that they
begin, up to where the line goes on with a licence's words; equivalent spellings become one; every
run of other characters than a-z and 0-9 becomes one space. Three units are looked up: a document's
whole text; each of its lines; and, for known texts of LONG words or more, a span of the text from
the begin of any line on, as a licence stands above code or within other text. A unit is a finding
when the digest of its canonical form is that of a known text. Everything is a DataFrame
expression; the only joins are with the table of known texts, which is a constant of this module
and so of fixed size: a span is only made where a line begins with a known text's first words.

Nulls and empty texts have no findings. Rows that repeat add up under their doc_id; a null doc_id
is a key of its own. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import tables

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

{0} Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

{1} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
{2}
THIS SOFTWARE IS PROVIDED BY THE {3} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {4} BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND
ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN
ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_NAMES = """
{0} Neither the name of {1} nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""

_GNU_HEADER = """This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General
Public License as published by the Free Software Foundation{3} version {4} of the License, or (at your option) any later
version.

This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2}General Public License for more details."""
_GNU_END = """

You should have received a copy of the GNU {1}General Public License along with this {0}. If not, see
<https://www.gnu.org/licenses/>."""

_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

#: Licences whose texts are files of license_texts.
FILES = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0"]


def _full_texts() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Full texts and standard headers, in the forms in which they are commonly given; and those of
    them that have no title or reservation of rights in front."""
    short = [("MIT", "MIT License", _MIT), ("MIT", "The MIT License (MIT)", _MIT), ("MIT", "The MIT License", _MIT), ("ISC", "ISC License", _ISC), ("ISC", "The ISC License", _ISC)]
    for marks in (("1.", "2.", "3."), ("*", "*", "*")):
        for all_, any_ in (("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDER OR CONTRIBUTORS"), ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT OWNER OR CONTRIBUTORS"), ("AUTHOR AND CONTRIBUTORS", "AUTHOR OR CONTRIBUTORS"), ("REGENTS AND CONTRIBUTORS", "REGENTS OR CONTRIBUTORS")):
            names = [_BSD_NAMES.format(marks[2], n) for n in ("the copyright holder", "the copyright owner", "the author", "the University", "the <organization>", "[project]")]
            short += [("BSD-2-Clause", title, _BSD.format(*marks[:2], "", all_, any_)) for title in ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD License")]
            short += [("BSD-3-Clause", title, _BSD.format(*marks[:2], n, all_, any_)) for title in ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD License") for n in names]
    out = [(i, head + t) for i, title, t in short for head in ("", title + "\n\n", "All rights reserved.\n\n", title + "\n\nAll rights reserved.\n\n")]
    begun = len(out)
    for name in FILES:
        text = resources.files(__package__).joinpath("license_texts", name + ".txt").read_text("utf-8")
        out.append((name, text))
        for end in ("How to Apply These Terms to Your New", "APPENDIX: How to apply"):  # often left out
            if end in text.replace("\n", " "):
                out.append((name, re.split(end.replace(" ", r"\s+"), text, maxsplit=1)[0]))
    apache = out[[i for i, _ in out].index("Apache-2.0")][1]
    header = apache[apache.rindex("Licensed under the Apache License") :]
    out += [("Apache-2.0", header), ("MPL-2.0", _MPL_HEADER)]
    for i, kind, version in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3")):
        for thing in ("program", "library", "software", "file"):
            for colon, comma in ((":", ", either"), (";", "; either")):
                main = _GNU_HEADER.format(thing, colon, kind, comma, version)
                out += [(i, main), (i, main + _GNU_END.format(thing, kind))]
    bare = [*dict.fromkeys((i, t) for i, _, t in short), *out[begun:]]
    # A line may break within "v. 2.0", which no spelling reaches over.
    for i, t in [x for x in out if "v. 2.0" in x[1]]:
        first, *rest = t.split("v. 2.0")
        out += [(i, first + "".join(v + r for v, r in zip(vs, rest, strict=True))) for vs in itertools.product(("v. 2.0", "v.\n2.0"), repeat=len(rest)) if "v.\n2.0" in vs]
    return out, bare


_FULL, _BARE = _full_texts()

# Known licence texts and the notices that stand for a licence.
KNOWN = [
    *_FULL,
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
]

# Spellings that licences use for the same word, as regular expressions on lower case.
SPELLINGS = [
    ("licenc", "licens"),
    ("sub-licens", "sublicens"),
    ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("http://", "https://"),
    (" & ", " and "),
    ("and/or", "and or"),
    (r"\bv(\.|ersion)? ?([0-9])", "version $2"),
]

#: What follows 'copyright', or '(c)', where a line of a licence begins with it but names no owner.
_NO_OWNER = """notice notices holder holders owner owners law laws license licenses licence licences and or of in on is as to for
act interest interests right rights treaty protection protections disclaimer statement statements ownership infringement
permission permissions policy information the~software the~program the~library the~work you under if any claim claims
including resulting doctrines are""".split()


def _other_than(phrases: list[str], inside: bool = True) -> str:
    """A pattern of the rest of a word that is none of these; without lookahead, which DuckDB hasn't."""
    firsts: dict[str, list[str]] = {}
    for p in phrases:
        firsts.setdefault(p[:1], []).append(p[1:])
    ends = "" in firsts
    heads = "".join(sorted(c for c in firsts if c and c != " "))
    ways = [rf"[^\W_{heads}]", r"[^\x00-\x7f]"] + [c + _other_than(rest, c != " ") for c, rest in sorted(firsts.items()) if c]
    if not ends and inside:
        ways.append(r"[^a-z0-9\s]" if " " in firsts else r"\b")
    return "(?:" + "|".join(ways) + ")"


def _owner(phrases: list[str]) -> str:
    """A pattern of the begin of a name: a word that is none of these."""
    firsts: dict[str, list[str]] = {}
    for p in phrases:
        firsts.setdefault(p[0], []).append(p[1:].replace("~", " "))
    heads = "".join(sorted(firsts))
    return "(?:" + "|".join([rf"[^\W_{heads}]", r"[^\x00-\x7f]", *(c + _other_than(rest) for c, rest in sorted(firsts.items()))]) + ")"


_OWNER = _owner(_NO_OWNER)
# How a line goes on after such a statement.
_GOES_ON = ["licensed", "all rights reserved", "released under", "permission is", "permission to", "redistribution and", "distributed under", "use of this", "spdx", "this program", "this library", "this software", "this file", "this work", "this project", "this source"]
_COPYRIGHT = rf"(^|\n)[^a-z0-9\n]*(?:copyright(?:[ \t:]+|[ \t:]*[<\[{{]){_OWNER}|copyright[^a-z0-9\n]*(?:\(c\)|©|[0-9])|\(c\)[^a-z0-9\n]*[12][0-9][0-9][0-9]|©)(?:[^\n]*?[^a-z0-9\n]((?:{'|'.join(_GOES_ON)})[^\n]*)|[^\n]*)"
#: '(c)' and nothing but a name, told from a list's third entry by its capitals; before lower-casing.
_NAME_ONLY = r"(^|\n)[^A-Za-z0-9\n]*\([cC]\)(?:[ \t]+[A-Z][\w.'&,-]*)+[ \t]*(\r?\n|$)"
#: Words of known texts that are looked for as spans, and words that a span's first line begins with.
LONG, HEAD = 20, 3


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.regexp_replace(text, _NAME_ONLY, "$1$2")), _COPYRIGHT, "$1$2")
    for spelling, one in SPELLINGS:
        out = F.regexp_replace(out, spelling, one) if "\\" in spelling else F.replace(out, F.lit(spelling), F.lit(one))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def known_digests(spark: SparkSession) -> DataFrame:
    """license_id, bare (a text to find spans of), digest, head (first words), n_words and n_chars of each
    known text."""
    given = [(i, t, False) for i, t in KNOWN] + [(i, t, True) for i, t in _BARE]
    known = spark.createDataFrame(given, "license_id string, known string, bare boolean").select("license_id", canonical(F.col("known")).alias("c"), "bare").groupBy("license_id", "c").agg(F.max("bare").alias("bare"))
    return known.select("license_id", "bare", F.sha2("c", 256).alias("digest"), F.substring_index("c", " ", HEAD).alias("head"), F.size(F.split("c", " ")).alias("n_words"), F.length("c").alias("n_chars"))


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, license_id, unit ('text', 'line' or 'span'), n_units: units with that licence's digest."""
    known = known_digests(docs.sparkSession).cache()
    longest = max(len(t) for _, t in KNOWN)
    lines = F.transform(F.split("text", "\n"), canonical)
    made = docs.filter(F.col("text").isNotNull()).select("doc_id", F.filter(lines, lambda c: c != "").alias("lines"))
    # No rule of the canonical form reaches over a line break, so a text's is that of its lines.
    units = F.concat(F.array(F.struct(F.lit("text").alias("unit"), F.array_join("lines", " ").alias("c"))), F.transform("lines", lambda c: F.struct(F.lit("line").alias("unit"), c.alias("c"))))
    heads = [r["head"] for r in known.filter(F.col("bare") & (F.col("n_words") >= LONG)).select("head").distinct().collect()]  # of a constant table
    starts = F.filter(F.transform("lines", lambda c, i: F.struct(F.lit("span").alias("unit"), F.substring_index(c, " ", HEAD).alias("c"), i.alias("i"))), lambda x: x["c"].isin(heads))
    # A text of n words is in n lines at most.
    most = max(len(t.split()) for _, t in KNOWN)
    spans = F.transform(starts, lambda x: F.struct(x["unit"].alias("unit"), x["c"].alias("c"), F.slice("lines", x["i"] + 1, most).alias("rest")))
    none = F.lit(None).cast("array<string>")
    every = F.concat(F.transform(units, lambda u: F.struct(u["unit"].alias("unit"), u["c"].alias("c"), none.alias("rest"))), spans)
    normal = made.select("doc_id", F.explode(every).alias("u")).select("doc_id", "u.unit", "u.c", "u.rest").filter((F.length("c") > 0) & (F.length("c") <= longest))
    exact = F.broadcast(known.select("license_id", F.col("digest").alias("key"), F.lit(None).cast("array<struct<digest:string,n_words:int,n_chars:int>>").alias("texts")))
    by_head = known.filter(F.col("bare") & (F.col("n_words") >= LONG)).groupBy("license_id", F.col("head").alias("key")).agg(F.collect_list(F.struct("digest", "n_words", "n_chars")).alias("texts"))
    keyed = normal.withColumn("key", F.when(F.col("unit") == "span", F.col("c")).otherwise(F.sha2("c", 256)))
    hits = keyed.join(F.broadcast(exact.unionByName(by_head)), "key")

    def begins(t):
        c = F.array_join(F.slice("rest", 1, t["n_words"]), " ")
        return (F.sha2(F.substring(c, F.lit(1), t["n_chars"]), 256) == t["digest"]) & F.substring(c, t["n_chars"] + 1, F.lit(1)).isin("", " ")

    return hits.filter((F.col("unit") != "span") | F.exists("texts", begins)).groupBy("doc_id", "license_id", "unit").agg(F.count(F.lit(1)).alias("n_units"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(tables.table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql_canonical(text: str) -> str:
    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    out = f"regexp_replace({text}, {quote(_NAME_ONLY)}, {quote(chr(92) + '1' + chr(92) + '2')}, 'g')"
    out = f"regexp_replace(lower({out}), {quote(_COPYRIGHT)}, {quote(chr(92) + '1' + chr(92) + '2')}, 'g')"
    for spelling, one in SPELLINGS:
        if "\\" in spelling:
            out = f"regexp_replace({out}, {quote(spelling)}, {quote(one.replace('$2', chr(92) + '2'))}, 'g')"
        else:
            out = f"replace({out}, {quote(spelling)}, {quote(one)})"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"


def oracle() -> str:
    values, bare = (", ".join(f"('{i}', '{t.replace(chr(39), chr(39) * 2)}')" for i, t in x) for x in (KNOWN, _BARE))
    return f"""
WITH known AS (SELECT DISTINCT license_id, {_sql_canonical("t")} AS c FROM (VALUES {values}) AS k(license_id, t)),
long AS (SELECT license_id, c, len(string_split(c, ' ')) AS n, array_to_string(string_split(c, ' ')[1:{HEAD}], ' ') AS head
  FROM (SELECT DISTINCT license_id, {_sql_canonical("t")} AS c FROM (VALUES {bare}) AS k(license_id, t)) WHERE len(string_split(c, ' ')) >= {LONG}),
units AS (
  SELECT doc_id, 'text' AS unit, text AS t FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, 'line' AS unit, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL
), normal AS (SELECT doc_id, unit, {_sql_canonical("t")} AS c FROM units),
cut AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS ts FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT r, doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM cut),
lines AS (SELECT r, doc_id, i, c FROM (SELECT r, doc_id, i, {_sql_canonical("t")} AS c FROM numbered) WHERE c <> ''),
kept AS (SELECT r, doc_id, list(c ORDER BY i) AS ls FROM lines GROUP BY r, doc_id),
starts AS (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM kept),
spans AS (
  SELECT DISTINCT r, doc_id, i, license_id
  FROM (SELECT *, array_to_string(string_split(ls[i], ' ')[1:{HEAD}], ' ') AS head FROM starts) JOIN long USING (head)
  WHERE starts_with(array_to_string(ls[i : i + n - 1], ' ') || ' ', c || ' ')
)
SELECT doc_id, license_id, unit, count(*) AS n_units FROM normal JOIN known USING (c) WHERE c <> '' GROUP BY ALL
UNION ALL
SELECT doc_id, license_id, 'span' AS unit, count(*) AS n_units FROM spans GROUP BY ALL
"""
