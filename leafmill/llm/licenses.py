"""Licence scans by canonical digest.

Text is canonical when case, punctuation, spacing, copyright lines and variant spellings no longer tell it apart
(the ideas of the public SPDX matching guidelines): each line is lower-cased, lines that only claim copyright go,
equivalent words are unified, everything but letters and digits becomes a space, and runs of spaces one. The
digest is the SHA-256 of that. A document is looked up as a whole, and each of its lines on its own, by hash
join with the digests of known texts; only whole texts and whole lines match, never parts of a line.

Defined results: null and empty texts match nothing; a line or text that is empty once canonical matches nothing;
several equal lines give a row each; rows that repeat a doc_id are scanned each; a null doc_id is left out.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known texts up to this many are broadcast; beyond, Spark joins by shuffle.
SMALL = 20_000

#: (pattern, replacement) after lower-casing, in this order; the same in Java and RE2.
RULES = [
    (r"(?:^|\n)[ \t]*(?:copyright|\(c\)|©)[^\n]*", "\n"),
    (r"licence", "license"),
    (r"sub-licens", "sublicens"),
    (r"non-commercial", "noncommercial"),
    (r"organisation", "organization"),
    (r"authoris", "authoriz"),
    (r"favour", "favor"),
    (r"behaviour", "behavior"),
    (r"per cent", "percent"),
    (r"https://", "http://"),
    (r"neither the names? of [^.;]{1,200}? nor the names of (?:its|their) contributors", "neither the name of the holder nor the names of its contributors"),
    (r"(?:the regents|the copyright (?:holders?|owners?)|the authors?) (?:and|or) contributors", "the holders and contributors"),
    (r"[^a-z0-9]+", " "),
]

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: (licence, text); the digests of longer licences are in licenses.tsv.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "MIT License\n\nCopyright (c) <year> <holder>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC),
    *[(name, head + text) for name, title, text in (("BSD-2-Clause", "BSD 2-Clause License\n\n", _BSD + _BSD_END), ("BSD-3-Clause", "BSD 3-Clause License\n\n", _BSD + _BSD3 + _BSD_END), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n", _BSL), ("Zlib", "zlib License\n\n", _ZLIB)) for head in ("", title)],
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("proprietary", "All rights reserved."),
]


def long_digests() -> list[tuple[str, str, str]]:
    """(licence, digest of the canonical text, a word of it) of the long licences: a text each with and without what follows its terms."""
    rows = (Path(__file__).with_name("licenses.tsv")).read_text(encoding="utf-8").splitlines()
    return [tuple(r.split("\t")) for r in rows if r and not r.startswith("#")]


def canonical(text: Column) -> Column:
    """Canonical form of a text or line; null gives ''."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for pattern, new in RULES:
        t = F.regexp_replace(t, F.lit(pattern), F.lit(new)) if set(pattern) & set("[(?\\") else F.replace(t, F.lit(pattern), F.lit(new))
    return F.trim(t)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def _raw_forms(word: str) -> set[str]:
    """All lower-case strings that the literal rules can turn into ``word``, and itself."""
    out, new = set(), {word}
    while new:
        out |= new
        new = {w[:i] + a + w[i + len(b) :] for w in new for a, b in RULES if not set(a) & set("[(?\\") for i in range(len(w)) if b and w.startswith(b, i)} - out
    return out


def anchors(texts: list[str], also: tuple[str, ...] = ()) -> str:
    """A pattern that the lower-cased text has wherever its canonical form is one of ``texts``: words that together occur in all of them, and the words ``also``.

    Words are never joined by the rules, so a word of a canonical text stands in the text in one of its raw forms. Long words are
    preferred, as they are rare elsewhere.
    """
    chosen = sorted(set(also))
    left = [t for t in (set(t.split()) for t in texts if t) if not t & set(chosen)]
    while left:
        words = sorted({w for t in left for w in t})
        best = max(words, key=lambda w: (len(w) >= 6, sum(w in t for t in left), len(w), w))
        chosen.append(best)
        left = [t for t in left if best not in t]
    return "|".join(re.escape(f) for w in chosen for f in sorted(_raw_forms(w)))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id, canonical); of several licences with one digest the first by name."""
    d = spark.createDataFrame(known or KNOWN, "license_id string, text string")
    return d.where(canonical(F.col("text")) != "").groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"), F.min(canonical(F.col("text"))).alias("canonical"))


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, part, line, license_id): part 'text' with line -1, or part 'line' with the line's number from 0."""
    spark = docs.sparkSession
    table = known_digests(spark, known)
    texts = [r["canonical"] for r in table.select("canonical").toLocalIterator()]  # known texts are a parameter
    more = long_digests() if known is None else []
    if not texts:
        return docs.sparkSession.createDataFrame([], "doc_id long, part string, line int, license_id string")
    known_ = table.select("digest", "license_id")
    if more:
        known_ = known_.unionByName(spark.createDataFrame([(d, i) for i, d, _ in more], "digest string, license_id string"))
    known_ = F.broadcast(known_) if len(texts) + len(more) <= SMALL else known_
    given = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lines = F.split("text", "\n")
    whole = F.array(F.struct(F.lit(-1).alias("line"), F.col("text").alias("s")))
    each = F.when(F.size(lines) > 1, F.transform(lines, lambda s, i: F.struct(i.alias("line"), s.alias("s")))).otherwise(F.array().cast("array<struct<line:int,s:string>>"))
    # what lacks all anchors can match nothing, so its canonical form is not made
    may = F.regexp_like(F.lower("p.s"), F.lit(anchors(texts, tuple(w for *_, w in more))))
    parts = given.select("doc_id", F.explode(F.concat(whole, each)).alias("p")).where(may)
    found = parts.select("doc_id", F.col("p.line").alias("line"), digest(F.col("p.s")).alias("digest")).join(known_, "digest")
    return found.select("doc_id", F.when(F.col("line") < 0, "text").otherwise("line").alias("part"), "line", "license_id")


def oracle() -> str:
    """The same in SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(t: str) -> str:
        t = f"lower(coalesce({t}, ''))"
        for pattern, new in RULES:
            p = q(pattern).replace("\n", "\\n")
            t = f"regexp_replace({t}, {p}, {'chr(10)' if new == chr(10) else q(new)}, 'g')" if set(pattern) & set("[(?\\") else f"replace({t}, {q(pattern)}, {q(new)})"
        return f"trim({t})"

    more = ", ".join(f"('{d}', '{i}')" for i, d, _ in long_digests())
    known = ", ".join(f"({q(a)}, {q(b).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))})" for a, b in KNOWN)
    return f"""
    with known as (select sha256({canon('t')}) as d, min(l) as license_id from (values {known}) k(l, t) where {canon('t')} <> '' group by 1
      union all select * from (values {more}) m(d, l)),
    lines as (
      select doc_id, unnest(string_split(text, chr(10))) as s, unnest(range(len(string_split(text, chr(10))))) as line
      from documents where doc_id is not null and text is not null and contains(text, chr(10))),
    parts as (
      select doc_id, 'text' as part, -1 as line, text as s from documents where doc_id is not null
      union all select doc_id, 'line', line, s from lines)
    select p.doc_id, p.part, cast(p.line as int) as line, k.license_id
    from (select doc_id, part, line, {canon('s')} as c from parts) p join known k on sha256(p.c) = k.d where p.c <> ''"""
