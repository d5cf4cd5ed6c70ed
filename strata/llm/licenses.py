"""Licence scans by canonical digests, in DataFrame operations only.

A text is brought to a canonical form (case, punctuation, copyright lines and
equivalent spellings no longer matter) and its SHA-256 is looked up among the
digests of known licences by a hash join. The same is done for every line, as
notices often stand alone in a longer text. A line is hashed only if some known
notice has its canonical length; that check drops no match.

Defined results: null and empty texts match nothing and have the digest of the
empty text; very long texts are canonised whole; repeated rows give one result row each; ties (several licences) are
listed by name; an empty table gives no rows; further columns pass unseen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import fresh

# Notices and short licence texts as their publishers word them.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
FULL_TEXTS = {
    "MIT": (
        "MIT License\n\nCopyright (c) <year> <copyright holders>\n\n"
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "ISC License\n\nCopyright (c) <year> <owner>\n\n"
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": (
        "BSD 2-Clause License\n\nCopyright (c) <year>, <owner>\n\n"
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
        + _BSD_WARRANTY
    ),
    "BSD-3-Clause": (
        "BSD 3-Clause License\n\nCopyright (c) <year>, <owner>\n\n"
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
        + _BSD_WARRANTY
    ),
    "0BSD": (
        "BSD Zero Clause License\n\nCopyright (C) <year> by <owner>\n\n"
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "zlib License\n\nCopyright (c) <year> <owner>\n\n"
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required.\n\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n"
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Boost Software License - Version 1.0 - August 17th, 2003\n\n"
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, "
        "display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\n"
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or "
        "in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.\n\n"
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of "
        "the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under "
        "copyright law.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.\n\n"
        "For more information, please refer to <https://unlicense.org/>"
    ),
    "MIT-0": (
        "MIT No Attribution\n\nCopyright <year> <owner>\n\n"
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0": (
        "Copyright <year> <owner>\n\n"
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n"
        "    http://www.apache.org/licenses/LICENSE-2.0\n\n"
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}
#: Spellings taken as equal: British or joined forms and their counterparts, on text already in lower case.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "sub license": "sublicense", "organisation": "organization", "favour": "favor", "honour": "honor",
    "merchantibility": "merchantability", "non infringement": "noninfringement", "non commercial": "noncommercial", "per cent": "percent", "copyright owner": "copyright holder",
}
#: Those of two words, which a line end may part; they are mapped once more in whole texts.
PHRASES = {k: v for k, v in SPELLINGS.items() if " " in k}
#: A line of this form names an owner or a year; it differs in every copy of a licence and is left out. Lines of running
#: text that happen to begin with the word (copyright holders, copyright notice) stay.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright *(\(c\)|©|[0-9<\[{:]|by )|all rights reserved|\(c\) |©)[^\n]*"
#: Licences up to which the digests are looked up by a broadcast hash join.
CATALOG_BROADCAST = 100_000


def with_lines(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the non-empty canonical lines of ``text`` as an array column ``out``.

    Lower case; copyright lines removed; every run of other characters than ASCII
    letters, digits and line ends one space; equivalent spellings mapped. The later
    replacements run only where a plain search finds something to replace.
    """
    x = F.col(out)
    df = df.withColumn(out, F.regexp_replace(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"\r\n?", "\n"))
    owner = F.contains(x, F.lit("copyright")) | F.contains(x, F.lit("rights reserved")) | F.contains(x, F.lit("(c) ")) | F.contains(x, F.lit("©"))
    df = df.withColumn(out, F.when(owner, F.regexp_replace(x, COPYRIGHT_LINE, "$1")).otherwise(x))
    df = df.withColumn(out, F.regexp_replace(x, r"[^a-z0-9\n]+", " "))
    mapped = x
    for one, other in SPELLINGS.items():
        mapped = F.regexp_replace(mapped, rf"\b{one}\b", other)
    df = df.withColumn(out, F.when(x.rlike("|".join(SPELLINGS)), mapped).otherwise(x))
    return df.withColumn(out, F.filter(F.transform(F.split(x, "\n"), lambda line: F.trim(line)), lambda line: line != ""))


def whole(lines: str) -> Column:
    """The canonical form of a whole text from its canonical lines."""
    x = F.array_join(lines, " ")
    mapped = x
    for one, other in PHRASES.items():
        mapped = F.regexp_replace(mapped, rf"\b{one}\b", other)
    return F.when(x.rlike("|".join(PHRASES)), mapped).otherwise(x)


def catalog(spark: SparkSession, notices: dict[str, list[str]] = NOTICES, texts: dict[str, str] = FULL_TEXTS) -> DataFrame:
    """(license_id, kind, digest, n_chars) of known texts; ``kind`` is text or line. Any table of this form can be used instead."""
    rows = [(k, "line", x) for k, v in notices.items() for x in v] + [(k, "text", x) for k, x in texts.items()] + [(k, "text", x) for k, v in notices.items() for x in v]
    known = spark.createDataFrame(rows, "license_id string, kind string, body string")
    known = with_lines(known, "body", "lines").withColumn("canonical", whole("lines"))
    return known.select("license_id", "kind", F.sha2("canonical", 256).alias("digest"), F.length("canonical").alias("n_chars")).distinct()


def catalog_of_files(spark: SparkSession, folder: str) -> DataFrame:
    """A catalogue of whole licence texts read from files; a file's name without its suffix is the licence's id."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[A-Za-z]+)?$", 1)
    known = with_lines(spark.read.text(folder, wholetext=True).select(name.alias("license_id"), F.col("value").alias("body")), "body", "lines").withColumn("canonical", whole("lines"))
    return known.select("license_id", F.lit("text").alias("kind"), F.sha2("canonical", 256).alias("digest"), F.length("canonical").alias("n_chars")).distinct()


def scan(documents: DataFrame, known: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``documents``: its canonical digest, the licence its whole text is, and the licences of its lines.

    The known digests are a hash table on every executor if there are at most
    ``CATALOG_BROADCAST``, which is counted; else the join is shuffled. Lines that
    can't match are gone before the join, so only matches and one row per document
    meet in the one shuffle, and these are combined map-side.
    """
    row = fresh(documents, "row_id")
    lengths = [r[0] for r in known.where("kind = 'line'").select("n_chars").distinct().collect()]  # at most the longest notice's length
    lines = with_lines(documents.select(F.monotonically_increasing_id().alias(row), F.col(key), F.col(text).alias("whole_text")), "whole_text", "lines")
    able = F.filter("lines", lambda line: F.length(line).isin(lengths)) if lengths else F.array().cast("array<string>")
    units = lines.select(
        row, key, F.sha2(whole("lines"), 256).alias("text_digest"), able.alias("able"),
    ).select(
        row, key, "text_digest",
        F.explode(F.concat(
            F.array(F.struct(F.lit("text").alias("kind"), F.col("text_digest").alias("digest"))),
            F.transform(F.array_distinct("able"), lambda line: F.struct(F.lit("line").alias("kind"), F.sha2(line, 256).alias("digest"))),
        )).alias("unit"),
    ).select(row, key, "text_digest", F.col("unit.kind").alias("kind"), F.col("unit.digest").alias("digest"))
    side = known.select("license_id", "kind", "digest")
    found = units.join(F.broadcast(side) if known.count() <= CATALOG_BROADCAST else side, ["kind", "digest"], "left")
    return found.groupBy(row, key, "text_digest").agg(
        F.min(F.when(F.col("kind") == "text", F.col("license_id"))).alias("text_license"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("kind") == "line", F.col("license_id")))), ",").alias("line_licenses"),
    ).drop(row)


def oracle(notices: dict[str, list[str]] = NOTICES, texts: dict[str, str] = FULL_TEXTS) -> str:
    """The same scan of ``documents`` as DuckDB SQL."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def lines(x: str) -> str:
        x = f"regexp_replace(lower(coalesce({x}, '')), '\\r\\n?', chr(10), 'g')"
        x = f"regexp_replace({x}, {quoted(COPYRIGHT_LINE)}, '\\1', 'g')"
        x = f"regexp_replace({x}, '[^a-z0-9\\n]+', ' ', 'g')"
        for one, other in SPELLINGS.items():
            x = f"regexp_replace({x}, '\\b{one}\\b', '{other}', 'g')"
        return f"list_filter(list_transform(string_split({x}, chr(10)), lambda s: trim(s)), lambda s: s <> '')"

    def joined(x: str) -> str:
        x = f"array_to_string({x}, ' ')"
        for one, other in PHRASES.items():
            x = f"regexp_replace({x}, '\\b{one}\\b', '{other}', 'g')"
        return x

    rows = [(k, "line", x) for k, v in notices.items() for x in v] + [(k, "text", x) for k, x in texts.items()] + [(k, "text", x) for k, v in notices.items() for x in v]
    values = ", ".join(f"({quoted(k)}, {quoted(kind)}, {quoted(x)})" for k, kind, x in rows)
    return f"""
WITH known AS (SELECT DISTINCT license_id, kind, sha256({joined(lines('body'))}) AS digest FROM (VALUES {values}) v(license_id, kind, body)),
docs AS (SELECT doc_id, {lines('text')} AS ls FROM documents),
whole AS (SELECT doc_id, sha256({joined('ls')}) AS text_digest FROM docs),
line_hits AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids
  FROM (SELECT doc_id, unnest(ls) AS line FROM docs) l JOIN known k ON k.kind = 'line' AND k.digest = sha256(l.line) GROUP BY doc_id)
SELECT w.doc_id, w.text_digest, (SELECT min(license_id) FROM known k WHERE k.kind = 'text' AND k.digest = w.text_digest) AS text_license, coalesce(h.ids, '') AS line_licenses
FROM whole w LEFT JOIN line_hits h ON h.doc_id = w.doc_id"""
