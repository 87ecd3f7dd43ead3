"""Licence scan by canonical digests, with DataFrame operations only.

A text is brought to a canonical form: lower case, copyright lines and "all rights reserved" gone, equivalent spellings
made one, and everything but letters and digits cut away. The digest of the whole canonical text is joined with a
table of digests of known licence texts and notices. Equal digests mean the same licence, however it was wrapped,
quoted, punctuated or attributed. A document's lines are looked up the same way, so that a notice that stands on a
line of its own inside a longer document is reported too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, as pairs of a pattern and what stands for it; in order.
SPELLINGS = (
    (r"https?: ", " "),
    (r"licen[cs]e", "license"),
    (r"licen[cs]ed", "licensed"),
    (r"sub-?licen[cs]e", "sublicense"),
    (r"&(amp;)?", " and "),
    (r"non-commercial", "noncommercial"),
    (r"copyright holders?", "copyright holder"),
    (r"copyright owners?", "copyright holder"),
    (r"per cent", "percent"),
    (r"version ([0-9])", "v$1"),
    (r"acknowledgement", "acknowledgment"),
    (r"merchantibility", "merchantability"),
    (r"organisation", "organization"),
)
#: A line that names who holds the rights; and the phrase that often follows.
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(copyright[: ]*(\(c\)|©|[0-9<\[{])|\(c\)|©)[^\n]*$"
#: Blanks and the marks that comments and quotes put at lines' starts.
MARKS = r"[ \t\r\n*#>/;]+"
RIGHTS = r"all rights reserved\.?"

# Known texts and notices. Words in them that vary with the holder are on copyright lines, which go.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL3_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "The MIT License\n\n" + _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAME + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_NAME + _BSD_TAIL),
    ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", _GPL3_NOTICE),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
)
#: Longer lines than every known text are not looked up.
_LONGEST = max(len(t) for _, t in KNOWN)


def canonical(text: Column) -> Column:
    """The canonical form; null has the empty one."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, COPYRIGHT, " "), MARKS, " "), RIGHTS, " ")
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_replace(out, r"[^a-z0-9ß-ɏ]+", "")


def digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """license, digest: made by the same expressions as documents' digests are."""
    return spark.createDataFrame(list(known), "license string, text string").select("license", F.md5(canonical(F.col("text"))).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def scanned(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """doc_id, license, n_notices, notices for every row of docs(doc_id, text).

    ``license`` is the known licence that the entire text is, or null; ``n_notices`` counts the lines that are one
    alone, and ``notices`` lists their licences, each once, in order, joined by commas. A null or empty text has
    neither. Rows stand alone, so ties, repeated rows and null ids need no care; other columns are not looked at.

    The table of digests is as long as ``known``, so it is broadcast. Only lines that hold a word of licences are
    brought to the canonical form.
    """
    spark = docs.sparkSession
    table = digests(spark, known)
    rows = docs.select("doc_id", "text").withColumn("digest", F.md5(canonical(F.col("text"))))
    entire = rows.join(F.broadcast(table), "digest", "left")
    # digests of known texts as one constant of a known size: a line's is looked up in it
    held = {r["digest"]: r["license"] for r in table.collect()}
    names = F.create_map(*[F.lit(x) for pair in held.items() for x in pair])
    lines = F.filter(F.split("text", "\n"), lambda x: (F.length(x) <= _LONGEST) & F.rlike(F.lower(x), F.lit("licen[cs]|permission|redistribution|this software")))
    found = F.filter(F.transform(lines, lambda x: F.try_element_at(names, F.md5(canonical(x)))), lambda x: x.isNotNull())
    found = F.coalesce(found, F.array().cast("array<string>"))
    return entire.withColumn("found", found).select("doc_id", "license", F.size("found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"))


def oracle(known: tuple[tuple[str, str], ...] = KNOWN) -> str:
    """The same rows in DuckDB's SQL."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        out = f"lower(coalesce({x}, ''))"
        out = f"regexp_replace(regexp_replace(regexp_replace({out}, {quoted(COPYRIGHT)}, ' ', 'g'), {quoted(MARKS)}, ' ', 'g'), {quoted(RIGHTS)}, ' ', 'g')"
        for pattern, to in SPELLINGS:
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(to.replace('$1', chr(92) + '1'))}, 'g')"
        return f"regexp_replace({out}, '[^a-z0-9\\x{{df}}-\\x{{24f}}]+', '', 'g')"

    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in known)
    return f"""
WITH known AS (SELECT md5({form('t')}) AS digest, min(n) AS license FROM (VALUES {values}) v(n, t) GROUP BY 1),
numbered AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
entire AS (SELECT k, doc_id, license FROM numbered LEFT JOIN known ON md5({form('text')}) = digest),
lines AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM numbered),
found AS (SELECT k, license FROM lines JOIN known ON md5({form('line')}) = digest
  WHERE length(line) <= {_LONGEST} AND regexp_matches(lower(line), 'licen[cs]|permission|redistribution|this software')),
counted AS (SELECT k, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM found GROUP BY k)
SELECT doc_id, license, CAST(coalesce(n, 0) AS BIGINT) AS n_notices, coalesce(notices, '') AS notices FROM entire LEFT JOIN counted USING (k)
"""
