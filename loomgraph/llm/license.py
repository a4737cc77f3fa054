"""License scans: canonical digests of entire texts, hash-joined to digests of known licences.

Canonical form: lower case, copyright lines dropped, punctuation to blanks, equivalent spellings
unified, blanks collapsed.  Units are the entire text and, for notices inside documents, each of
its lines.  SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as equal (word -> canonical word).
EQUIVALENT = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sublicence": "sublicense", "holder": "owner", "holders": "owners",
    "organisation": "organization", "organisations": "organizations", "authorise": "authorize", "authorised": "authorized", "favour": "favor", "whilst": "while",
    "wilful": "willful", "acknowledgement": "acknowledgment", "recognise": "recognize", "judgement": "judgment", "fulfil": "fulfill",
    "analogue": "analog", "artefact": "artifact", "catalogue": "catalog", "centre": "center", "initialise": "initialize", "modelled": "modeled", "practise": "practice", "programme": "program", "realise": "realize",
}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

_MIT0 = _MIT.replace(", subject to the following conditions:", ".").replace("\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "")
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <{}://unlicense.org{}>"""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_GNU_HEADER = """This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."""
_GNU = [("GPL-3.0", "program", "General Public License", "3"), ("AGPL-3.0", "program", "Affero General Public License", "3"), ("LGPL-3.0", "library", "Lesser General Public License", "3"), ("LGPL-2.1", "library", "Lesser General Public License", "2.1")]

#: (licence, kind, text): licence texts with and without a title, and one-line notices.
KNOWN = [
    ("MIT", "text", _MIT), ("MIT", "text", "MIT License\n" + _MIT), ("MIT", "text", "The MIT License (MIT)\n" + _MIT),
    ("ISC", "text", _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")), ("ISC", "text", "ISC License\n" + _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")),
    ("0BSD", "text", _ISC.format("")), ("0BSD", "text", "BSD Zero Clause License\n" + _ISC.format("")),
    ("BSD-2-Clause", "text", _BSD.format("")), ("BSD-2-Clause", "text", "BSD 2-Clause License\n" + _BSD.format("")),
    ("BSD-3-Clause", "text", _BSD.format(_BSD3)), ("BSD-3-Clause", "text", "BSD 3-Clause License\n" + _BSD.format(_BSD3)),
    ("Zlib", "text", _ZLIB), ("Zlib", "text", "zlib License\n" + _ZLIB),
    ("MIT-0", "text", _MIT0), ("MIT-0", "text", "MIT No Attribution\n" + _MIT0),
    *[("Unlicense", "text", _UNLICENSE.format(scheme, end)) for scheme in ("http", "https") for end in ("", "/")],
    ("BSL-1.0", "text", _BOOST), ("BSL-1.0", "text", "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BOOST),
    ("MPL-2.0", "notice", _MPL_HEADER), ("MPL-2.0", "notice", _MPL_HEADER.replace("https", "http")),
    *[(k, "notice", text) for k, what, name, version in _GNU for whole in (_GNU_HEADER.format(what=what, name=name, version=version),) for text in (whole, whole.split("\n")[0])],
    *[(k, "notice", f"{verb} {the}{name}") for k, names in (("MIT", ("MIT License",)), ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License")), ("GPL-3.0", ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3")), ("GPL-2.0", ("GNU General Public License, version 2", "GPLv2")), ("BSD-3-Clause", ("BSD 3-Clause License",)), ("MPL-2.0", ("Mozilla Public License, version 2.0",)), ("CC-BY-4.0", ("CC BY 4.0",)), ("CC-BY-SA-4.0", ("CC BY-SA 4.0",)), ("CC-BY-NC-4.0", ("CC BY-NC 4.0",)), ("CC0-1.0", ("CC0 1.0",))) for name in names for verb in ("Released under", "Licensed under", "This work is licensed under", "Distributed under") for the in ("", "the ")],
    *[(k, "notice", f"SPDX-License-Identifier: {k}") for k in ("MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC0-1.0")],
]

#: Lines that only state a copyright or reserve rights, and what parts words within a line.
COPYRIGHT_LINE = r"(^|\n)[^\S\n]*(?:[#*/;-]+[^\S\n]*)?(?:copyright|\(c\)|©|all rights reserved)[^\n]*"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
_ANY = " (?:" + "|".join(EQUIVALENT) + ") "


def canonical_lines(text: Column) -> Column:
    """Canonical words of every line, two blanks between words and one at the ends of lines."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "$1")
    # two blanks between words, so that neighbouring words do not share one in the replacements
    t = F.concat(F.lit(" "), F.replace(F.regexp_replace(t, PUNCTUATION, "  "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    unified = t
    for a, b in EQUIVALENT.items():
        unified = F.replace(unified, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.when(F.rlike(t, F.lit(_ANY)), unified).otherwise(t)


def canonical(text: Column) -> Column:
    """The canonical form of an entire text; null stays null, punctuation only becomes ''."""
    return F.trim(F.regexp_replace(canonical_lines(text), "[ \n]+", " "))


def canonical_sql(text: str, lines: bool = False) -> str:
    """The same in SQL of another engine with RE2 patterns and regexp_replace(…, 'g')."""
    t = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', '\\1', 'g')"
    t = f"' ' || replace(regexp_replace({t}, '{PUNCTUATION}', '  ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
    for a, b in EQUIVALENT.items():
        t = f"replace({t}, ' {a} ', ' {b} ')"
    return t if lines else f"trim(regexp_replace({t}, '[ \\n]+', ' ', 'g'))"


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(digest, license, kind), one row for each digest; of equal digests the first entry counts."""
    rows = [(i, *x) for i, x in enumerate(KNOWN if known is None else known)]
    df = spark.createDataFrame(rows, "i int, license string, kind string, text string")
    return df.groupBy(digest(F.col("text")).alias("digest")).agg(F.min_by("license", "i").alias("license"), F.min_by("kind", "i").alias("kind"))


def license_scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 100_000) -> DataFrame:
    """One row (unit 'text', line 0) for each document's entire text, and one (unit 'line') for
    each line of it, counted from 1, that is a known licence or notice.

    Columns: id, unit, line, digest, license (null where unknown).  Null texts have a null digest
    and no licence; empty texts and blank lines never match.  The table of known digests is
    broadcast only while it has at most ``broadcast_rows`` rows (counted first); a larger one is
    shuffled, and Spark splits skewed keys.  Repeated rows give repeated results.
    """
    small = known.limit(broadcast_rows + 1).count() <= broadcast_rows
    empty = F.sha2(F.lit(""), 256)
    known = known.where(F.col("digest") != empty).select(F.col("digest").alias("_digest"), "license")
    known = F.broadcast(known) if small else known
    rows = docs.select(F.col(id_col).alias("id"), canonical_lines(F.col(text_col)).alias("text"))
    unit = lambda kind, text: F.struct(F.lit(kind).alias("unit"), F.trim(F.regexp_replace(text, "[ \n]+", " ")).alias("text"))
    lines = F.when(F.contains("text", F.lit("\n")), F.transform(F.split("text", "\n"), lambda x: unit("line", x))).otherwise(F.array().cast("array<struct<unit:string,text:string>>"))
    rows = rows.select("id", F.posexplode(F.concat(F.array(unit("text", F.col("text"))), F.coalesce(lines, F.array().cast("array<struct<unit:string,text:string>>")))).alias("line", "u"))
    rows = rows.select(F.col("id").alias(id_col), "u.unit", F.col("line").cast("long").alias("line"), F.sha2("u.text", 256).alias("digest"))
    found = rows.join(known, F.col("digest") == F.col("_digest"), "left").drop("_digest")
    return found.where((F.col("unit") == "text") | F.col("license").isNotNull())


def oracle(known: list[tuple[str, str, str]] | None = None) -> str:
    """The SQL whose rows license_scan has over ``documents``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quote(k)}, {quote(t)})" for i, (k, _, t) in enumerate(KNOWN if known is None else known))
    return f"""
WITH known AS (
  SELECT digest, arg_min(license, i) AS license
  FROM (SELECT i, license, sha256({canonical_sql("text")}) AS digest FROM (VALUES {values}) AS v(i, license, text))
  WHERE digest <> sha256('') GROUP BY digest),
lines AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text
  FROM (SELECT doc_id, string_split({canonical_sql("text", True)}, chr(10)) AS l FROM documents WHERE contains(text, chr(10))))
SELECT doc_id, 'text' AS unit, CAST(0 AS BIGINT) AS line, d.digest, license
FROM (SELECT doc_id, sha256({canonical_sql("text")}) AS digest FROM documents) d LEFT JOIN known USING (digest)
UNION ALL
SELECT doc_id, 'line' AS unit, CAST(line AS BIGINT) AS line, l.digest, license
FROM (SELECT doc_id, line, sha256(trim(regexp_replace(text, '[ \\n]+', ' ', 'g'))) AS digest FROM lines) l JOIN known USING (digest)
"""
