"""Licence scan: whole texts and whole lines whose canonical digest is that of a known licence text.

Canonical form: lower case, copyright lines dropped, equivalent spellings made one, everything
but letters and digits dropped. Null and empty texts match nothing; a table without rows gives
none. Rows that repeat both doc_id and text get the same result each. Columns other than doc_id
and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pennant.llm.common import written

# Licence texts and notices as their stewards publish them, by SPDX id.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
KNOWN = [
    ("MIT", "MIT License\n\n" + _MIT_GRANT),
    ("MIT", _MIT_GRANT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT-0", "SPDX-License-Identifier: MIT-0"),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", _ISC_GRANT + ".\n\n" + _ISC_WARRANTY),
    ("0BSD", "SPDX-License-Identifier: 0BSD"),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_WARRANTY),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_WARRANTY),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_NAMES + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_WARRANTY),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-or-later", _GPL_NOTICE),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
]

#: Digests of the canonical form of full texts, by licence.
FULL_TEXTS = [
    ("Apache-2.0", "6143bef1d1029e4b1164eb0883da072914e5829c61c7fe5315220d8aab1a5ee6"),
    ("Apache-2.0", "8fc89300d6144d798e99174525314a7abbea202e511feb0823b819c3612a6376"),
    ("Apache-2.0", "b09e48379efb3bf53c5c950d904ebea346e7e8f0320a4d6db6406eebdc0fe1e9"),
    ("Artistic-1.0-Perl", "a39214726c05f47d077916b533faf652733fc2d88e8e742a45d26457427c43fe"),
    ("CC0-1.0", "a1c5451395262a9c57097cf8ed1be6259bce24f74691c20b350916c920658336"),
    ("GFDL-1.2", "091d3d8b9fecc67ae1858f4c2d21c09ef1757c90b3919f795c6e8ff6e83f8019"),
    ("GFDL-1.3", "02c039ff6013ec01dc618dc26d1a2106e605e7a23bdcda805cc1b3543d57ba83"),
    ("GPL-1.0", "0fd74e6f24738ca0c19c7a9868b74d7ce88749df0e6c8637712f9464fa5bf2aa"),
    ("GPL-1.0", "652eeefe4542a613bbc824b2d3125883eeb0dba3f1a7500aaf53e3f42c7a7609"),
    ("GPL-1.0", "bcb38aa2b8a0b1776101ad89387d706cf24c12d638b887588720591a839339e0"),
    ("GPL-2.0", "8522c85260f2761e626c297e5181d805cd00fe055ef16ca2338d518921154343"),
    ("GPL-2.0", "a74f1eeb28b124d61f4b41d1dfdae0bbf57f0626948953dde2fcf7105aed65f5"),
    ("GPL-2.0", "f9fc899c93bd744c70a0e48c2bc663cb904023ebd364b4db06be4be809ef7119"),
    ("GPL-3.0", "6cb36c69867724c4fbfe3314d04fae28caef34f601a4ec822ab1aab1637f447d"),
    ("GPL-3.0", "dbb87851cec14256d7e26c612cdea702c7f05f5ed1dad90ff6b95d629115d12f"),
    ("GPL-3.0", "f1c58b3b6ae9cddab1a787a6f5d9a6d65b0f1b47d5d7e0bef0ec522397af3f00"),
    ("LGPL-2.0", "29707cf9e35d2c823e79cc5767a98cd6b33ca3b39982078cfb16747790f527f6"),
    ("LGPL-2.0", "4644167a2d957416bb15900d695d3797b4df4f8f93d2849e937cfd165c201f93"),
    ("LGPL-2.0", "f6926cbd839519a95b12d33aa21195ad0f478c6048c208e041d66218f3dbac0a"),
    ("LGPL-2.1", "2e855bfe5e2bed583db38779f30970fccea0c62ee2775519c3e95de135207c40"),
    ("LGPL-2.1", "4cb0a757d858efdedd252d4a0eb87fd9361ad812c440caa7de4f81c9767a0988"),
    ("LGPL-2.1", "9399a25c7bf3d1056abba0b7bd3666aa103743270f45e1eff943cf42f74c2e3f"),
    ("LGPL-3.0", "9da940a5cdd0ef8c6da67bf24cbe851115f32bfcb87aa56b7dec93a85f943e6d"),
    ("MPL-1.1", "94ff42a0ae3e7e9c907d3cfdddf16d991c10dc22cc8214498902fd03bdc34847"),
    ("MPL-2.0", "38012e6a06af79770946c2e6f2ab20888eaeaa97943326ae9bf6a7a7bacc9a61"),
    ("Unlicense", "bb28cc84551e602fa595813d0910e669c92cf2465e9b1bdc916144ab8bc37666"),
    ("Zlib", "4b10349609035ef9f81921ed02147e8589fc2deeba3fe691baa68eea03c86563"),
]

#: Spellings that mean the same in a licence text (pattern, replacement), on lower case.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("https://", "http://"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
    ("favour", "favor"),
]
#: Lines that only name who holds the copyright, behind comment signs too (Java's syntax).
HOLDER_LINE = r"(?m)^[ \t#*/;%!<>|\"'-]*(?:copyright|\(c\)|©)[ \t:]*(?:(?:\(c\)|©|[0-9]{4}|holder:).*|(?!.*(?:licen[cs]e|notice|holder|owner|law|statement|disclaimer|permission))(?=.*\b(?:19|20)[0-9]{2}\b).*+|[\[{<(]*(?:yyyy|year)\b.*)$"
NAMED_LINE = r"(?m)^[ \t#*/;%!<>|\"'-]*(?:Copyright|COPYRIGHT|©)(?:[ \t]*\([cC]\))?(?!.*(?i:licen[cs]e|notice|holder|owner|law|statement|disclaimer|permission|grant))(?:[ \t,]+(?:\p{Lu}[\p{L}.'&-]*|and|by|the|of))++[ \t]*$"
RIGHTS_LINE = r"(?m)^[ \t#*/;%!<>|\"'-]*all rights reserved\.?[ \t]*$"
#: Each text of KNOWN and FULL_TEXTS has one of these, so only lines with one are looked up in the built-in table.
LINE_MARK = "(?i)licen[cs]e|permission|redistribut"


def canonical(text: Column) -> Column:
    """Letters and digits of the text in canonical form; '' for null."""
    t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), NAMED_LINE, ""))
    t = F.regexp_replace(F.regexp_replace(t, HOLDER_LINE, ""), RIGHTS_LINE, "")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, r"[^\p{L}\p{Nd}]+", "")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_licenses(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """known (a digest), license for (license, text) pairs, or of KNOWN and FULL_TEXTS; one row per digest."""
    rows = spark.createDataFrame(known or KNOWN, "license string, text string").select("license", digest(F.col("text")).alias("known"))
    if not known:
        rows = rows.unionByName(spark.createDataFrame(FULL_TEXTS, "license string, known string"))
    return rows.groupBy("known").agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, license (of the whole text, or null), n_notices, notices for each row of docs.

    notices lists license:line (lines counted from 1), in the order of the lines, of the lines
    that are wholly a known text. The digest table is joined by hash, broadcast only if Spark's
    size estimate allows it.
    """
    spark = docs.sparkSession
    mark = LINE_MARK if known is None else ""
    known = written(known if known is not None else known_licenses(spark))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\r?\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    marked = F.transform(F.filter(lines, lambda x: x["text"].rlike(mark)), lambda x: F.struct(x["line"], digest(x["text"]).alias("digest")))
    rows = written(docs.select("doc_id", F.xxhash64("text").alias("h"), digest(F.col("text")).alias("whole"), marked.alias("lines")))
    found = rows.select("doc_id", "h", F.explode("lines").alias("l")).distinct().join(known, F.col("l.digest") == F.col("known"))
    found = found.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("l.line", "license"))).alias("n"))
    found = found.select(F.col("doc_id").alias("d"), F.col("h").alias("dh"), "n")
    out = rows.select("doc_id", "h", "whole").join(known, F.col("whole") == F.col("known"), "left")
    out = out.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("dh")), "left")
    notices = F.array_join(F.transform("n", lambda x: F.concat(x["license"], F.lit(":"), x["line"].cast("string"))), ",")
    return out.select("doc_id", "license", F.coalesce(F.size("n"), F.lit(0)).cast("long").alias("n_notices"), F.coalesce(notices, F.lit("")).alias("notices"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The line patterns' parts for SQL, whose expressions have no lookahead.
_SIGNS = "^[ \\t#*/;%!<>|\"'-]*"
_HOLDS = _SIGNS + r"(copyright|\(c\)|©)[ \t:]*"
_NAMES = _SIGNS + r"(Copyright|COPYRIGHT|©)([ \t]*\([cC]\))?([ \t,]+(\p{Lu}[\p{L}.'&-]*|and|by|the|of))+[ \t]*$"
_BANNED = "licen[cs]e|notice|holder|owner|law|statement|disclaimer|permission"


def _dropped_sql(line: str) -> str:
    """Whether one of the line patterns drops a line."""
    match = lambda text, pattern: f"regexp_matches({text}, {_quoted(pattern)})"
    low = f"lower({line})"
    dated = f"({match(low, _HOLDS)} AND NOT {match(low, _BANNED)} AND {match(low, r'\b(19|20)[0-9]{2}\b')})"
    holder = f"({match(low, _HOLDS + r'(\(c\)|©|[0-9]{4}|holder:)')} OR {dated} OR {match(low, _HOLDS + r'[\[{<(]*(yyyy|year)\b')})"
    named = f"({match(line, _NAMES)} AND NOT {match(low, _BANNED + '|grant')})"
    return f"({holder} OR {named} OR {match(low, _SIGNS + r'all rights reserved\.?[ \t]*$')})"


def _canonical_sql(text: str) -> str:
    t = f"lower(array_to_string(list_filter(string_split(replace(coalesce({text}, ''), chr(13) || chr(10), chr(10)), chr(10)), lambda x: NOT {_dropped_sql('x')}), chr(10)))"
    for a, b in SPELLINGS:
        t = f"replace({t}, {_quoted(a)}, {_quoted(b)})"
    return f"regexp_replace({t}, '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')"


SQL = f"""
WITH k AS (
  SELECT digest, min(l) AS license FROM (
    SELECT sha256({_canonical_sql("t")}) AS digest, l FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in KNOWN)}) AS v(l, t)
    UNION ALL SELECT digest, l FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in FULL_TEXTS)}) AS w(l, digest)) GROUP BY 1),
d AS (SELECT doc_id, text, string_split_regex(coalesce(text, ''), '\\r?\\n') AS lines FROM documents),
e AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS line, unnest(lines) AS t FROM d),
n AS (
  SELECT e.doc_id, count(*) AS n, string_agg(k.license || ':' || e.line, ',' ORDER BY e.line) AS notices
  FROM (SELECT * FROM e WHERE regexp_matches(t, {_quoted(LINE_MARK)})) e JOIN k ON sha256({_canonical_sql("e.t")}) = k.digest GROUP BY 1)
SELECT d.doc_id, k.license, coalesce(n.n, 0) AS n_notices, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN k ON sha256({_canonical_sql("d.text")}) = k.digest LEFT JOIN n ON d.doc_id = n.doc_id
"""
