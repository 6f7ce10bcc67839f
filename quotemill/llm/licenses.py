"""Operator 8: known licences, by the digest of a canonical form of entire texts. Built-in functions only.

A text is brought to its canonical form: lower case, without copyright lines, without signs other than letters
and digits, equivalent spellings made one, single spaces. Its SHA-256 is looked up, by a hash join, among those
of the known licences. The texts looked up are each whole document; each line of it and each run of up to LINE_RUN
lines, as a notice is often one line or a few; and each run of as many paragraphs as a known licence has, so that a
licence within a document is found however its lines are wrapped. Nothing is matched in part.

The known texts are a table of the caller's, or those below. It is broadcast by Spark if it is small.

Null text: no texts, no licences. Empty texts and lines are never looked up; of equal texts in one document one is. A
very long text is one row, with a digest for each of its lines and runs. Of licences of one text the first by name is
told. Rows with one doc_id: one result each. Null doc_id stays null. Empty input: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of a text that begin so, with the sign or a year, are its copyright lines; others may be wrapped.
COPYRIGHT_LINE = r"(?im)^[ \t]*(?:(?:portions )?copyright\b[ \t]*(?:\(c\)|©|[^\n]*\d{4})|\(c\)|©)[^\n]*$"
#: Spellings that count as the same, whole words, in this order.
EQUIVALENT = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licencing", "licensing"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("judgement", "judgment"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("acknowledgement", "acknowledgment"),
    ("version 2 0", "version 2"),
    ("https", "http"),
]
#: Lines of the longest run of lines that is looked up.
LINE_RUN = 3
#: The usual notices and whole licences of a page or less, by SPDX id.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
     "https://www.boost.org/LICENSE_1_0.txt)"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\n"
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
        "\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n\n"
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions "
        "and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list "
        "of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
        "\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions "
        "and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list "
        "of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
        "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE "
        "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the "
        "original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source "
        "distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors "
        "of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication "
        "for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be "
        "an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
        "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer "
        "to <https://unlicense.org>",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
        "\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
        "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", "
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING "
        "FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
]


def _spelt(words: Column) -> Column:
    """words stand between two spaces each, so that equal ones in a row share none."""
    for old, new in EQUIVALENT:
        words = F.replace(words, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new} "))
    return F.replace(F.btrim(words), F.lit("  "), F.lit(" "))


def _lines(text: Column) -> Column:
    """Each line's words, a space before and after each; of a line without words, nothing."""
    words = F.regexp_replace(F.lower(F.regexp_replace(text, COPYRIGHT_LINE, "")), r"[^\p{L}\p{N}\n]+", "  ")
    lines = F.transform(F.split(words, "\n", -1), lambda x: F.btrim(x))
    return F.transform(lines, lambda x: F.when(x == "", "").otherwise(F.concat(F.lit(" "), x, F.lit(" "))))


def _paragraphs(lines: Column) -> Column:
    """The canonical forms of the runs of lines between empty ones."""
    parts = F.split(F.array_join(lines, "\n"), "\n{2,}", -1)
    return F.filter(F.transform(parts, lambda x: _spelt(F.replace(x, F.lit("\n"), F.lit("")))), lambda x: x != "")


def _runs(parts: Column, n: int, between: str) -> Column:
    starts = F.when(F.size(parts) >= n, F.sequence(F.lit(1), F.size(parts) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(parts, i, n), between))


def canonical(text: Column) -> Column:
    """The form of a whole text that is digested: those of its paragraphs, one after another."""
    return F.array_join(_paragraphs(_lines(text)), " ")


def scanned(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, n_texts, n_hits (texts of the document that are licences), licenses (ids in order, by comma),
    whole_document (id, if all of it is one). known: license_id, known (a text); if not given, KNOWN."""
    if known is None:
        known = docs.sparkSession.createDataFrame(KNOWN, "license_id string, known string")
    # as many as licences have paragraphs: a few numbers
    sizes = [r.n for r in known.select(F.size(_paragraphs(_lines(F.col("known")))).alias("n")).distinct().orderBy("n").collect() if r.n > 0]
    digests = known.groupBy(F.sha2(canonical(F.col("known")), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), _lines(F.coalesce("text", F.lit(""))).alias("lines"))
    rows = rows.select("doc_id", "row", _paragraphs(F.col("lines")).alias("paragraphs"), F.filter("lines", lambda x: x != "").alias("lines"))
    runs = F.concat("lines", *[_runs(F.col("lines"), n, "") for n in range(2, LINE_RUN + 1)])
    parts = F.concat(F.transform(runs, _spelt), *[_runs(F.col("paragraphs"), n, " ") for n in sizes])
    units = F.filter(F.array_union(F.array(F.array_join("paragraphs", " ")), parts), lambda x: x != "")
    units = rows.select("row", "doc_id", F.posexplode_outer(units).alias("k", "unit"))
    hits = units.select("row", "doc_id", "k", F.sha2("unit", 256).alias("digest")).join(digests, "digest", "left")
    # a document's texts are in one task, so most of the sum is done before the shuffle
    return (
        hits.groupBy("row", "doc_id")
        .agg(
            F.count("digest").alias("n_texts"),
            F.count("license_id").alias("n_hits"),
            F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("licenses"),
            F.max(F.when(F.col("k") == 0, F.col("license_id"))).alias("whole_document"),
        )
        .drop("row")
    )


def _oracle_spelt(x: str) -> str:
    for old, new in EQUIVALENT:
        x = f"replace({x}, ' {old.replace(' ', '  ')} ', ' {new} ')"
    return f"replace(trim({x}), '  ', ' ')"


def _oracle_forms(source: str, text: str) -> str:
    """source with `lines` and `paragraphs`, as _lines (those with words) and _paragraphs give them."""
    pattern = COPYRIGHT_LINE.replace("(?im)", "")
    words = f"regexp_replace(lower(regexp_replace({text}, '{pattern}', '', 'gim')), '[^\\p{{L}}\\p{{N}}\\n]+', '  ', 'g')"
    lines = f"list_transform(string_split({words}, chr(10)), lambda x: CASE WHEN trim(x) = '' THEN '' ELSE ' ' || trim(x) || ' ' END)"
    parts = "string_split_regex(array_to_string(every, chr(10)), '\\n{2,}')"
    return f"""SELECT *, list_filter(every, lambda x: x <> '') AS lines,
       list_filter(list_transform({parts}, lambda x: {_oracle_spelt("replace(x, chr(10), '')")}), lambda x: x <> '') AS paragraphs
  FROM (SELECT *, {lines} AS every FROM {source})"""


def _oracle_runs(parts: str, n: str, between: str) -> str:
    return f"list_transform(range(1, len({parts}) - {n} + 2), lambda i: array_to_string({parts}[i : i + {n} - 1], '{between}'))"


def oracle() -> str:
    known = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    lines = " || ".join(["lines"] + [_oracle_runs("lines", str(n), "") for n in range(2, LINE_RUN + 1)])
    return f"""
WITH listed AS ({_oracle_forms(f"(VALUES {known}) AS k(license_id, known)", "known")}
), known AS (
  SELECT array_to_string(paragraphs, ' ') AS form, min(license_id) AS license_id FROM listed GROUP BY 1
), sizes AS (
  SELECT list(DISTINCT len(paragraphs)) AS sizes FROM listed
), formed AS ({_oracle_forms("(SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents)", "text")}
), units AS (
  SELECT doc_id, row, array_to_string(paragraphs, ' ') AS whole, unnest(list_distinct(list_filter([array_to_string(paragraphs, ' ')]
    || list_transform({lines}, lambda x: {_oracle_spelt("x")})
    || flatten(list_transform(sizes, lambda n: {_oracle_runs("paragraphs", "n", " ")})), lambda x: x <> ''))) AS form
  FROM formed, sizes
), found AS (
  SELECT row, count(*) AS n_texts, count(license_id) AS n_hits, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS licenses,
         max(CASE WHEN whole = u.form THEN license_id END) AS whole_document
  FROM units u LEFT JOIN known k ON k.form = u.form GROUP BY row
)
SELECT doc_id, coalesce(n_texts, 0) AS n_texts, coalesce(n_hits, 0) AS n_hits, coalesce(licenses, '') AS licenses, whole_document
FROM formed f LEFT JOIN found d ON d.row = f.row
"""
