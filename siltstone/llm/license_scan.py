"""Operator 1, license scans: canonical digests joined to known licences.

A text is reduced to its canonical form: lower case, copyright lines dropped,
equivalent spellings unified, everything but letters and digits turned into
single spaces.  The digest of a whole text, and of each of its lines that can be
a known notice, is joined to the digests of the known texts by hash.  Known texts
are given in full or as the digests of their canonical forms.

Edge cases: null, empty and letterless texts have the canonical form '' and match
nothing; texts and lines of any length are looked at; repeated rows get the same
result; a null id is kept; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, let, text_or_empty

#: Known texts up to which their digests are broadcast.
MAX_KNOWN = 10_000

#: Spellings that licence comparison guidelines treat as the same word.
EQUIVALENT = [
    ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"), ("authorisation", "authorization"), ("authorised", "authorized"), ("centre", "center"), ("favour", "favor"),
    ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"), ("labour", "labor"), ("modernise", "modernize"),
    ("non commercial", "noncommercial"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("programme", "program"),
    ("recognise", "recognize"), ("utilisation", "utilization"), ("utilise", "utilize"), ("whilst", "while"), ("wilful", "willful"), ("copyright holder", "copyright owner"),
]

#: One spelling of licence and all its inflections.
STEM = ("licenc", "licens")

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

NO_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_3 = BSD_2 + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
#: The same conditions with stars or dashes for numbers.
BARE_2, BARE_3 = (re.sub(r"(?m)^[0-9]\. ", "* ", x) for x in (BSD_2, BSD_3))
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
"""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
"""
AUTHOR_DISCLAIMS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""

#: Known texts: whole licences and the one-line notices that stand for them.
KNOWN = [
    ("MIT", MIT), ("MIT", "MIT License\n" + MIT), ("MIT", "The MIT License (MIT)\n" + MIT), ("MIT", "The MIT License\n" + MIT),
    ("BSD-2-Clause", BSD_2 + NO_WARRANTY), ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD_2 + NO_WARRANTY), ("BSD-2-Clause", BARE_2 + NO_WARRANTY), ("BSD-2-Clause", "BSD 2-Clause License\n" + BARE_2 + NO_WARRANTY),
    ("BSD-3-Clause", BSD_3 + NO_WARRANTY), ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD_3 + NO_WARRANTY), ("BSD-3-Clause", BARE_3 + NO_WARRANTY), ("BSD-3-Clause", "BSD 3-Clause License\n" + BARE_3 + NO_WARRANTY),
    ("ISC", ISC + AUTHOR_DISCLAIMS), ("ISC", "ISC License\n" + ISC + AUTHOR_DISCLAIMS), ("0BSD", ZERO_BSD + AUTHOR_DISCLAIMS), ("0BSD", "BSD Zero Clause License\n" + ZERO_BSD + AUTHOR_DISCLAIMS),
    ("Unlicense", UNLICENSE + "For more information, please refer to <http://unlicense.org/>"), ("Unlicense", UNLICENSE + "For more information, please refer to <https://unlicense.org>"), ("Unlicense", UNLICENSE),
    ("Zlib", ZLIB), ("Zlib", "zlib License\n" + ZLIB),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License v3.0."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
]

#: Digests of the canonical forms of licences too long to spell out, as their authors publish them.
DIGESTS = [
    ("Apache-2.0", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Artistic-1.0-Perl", "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "8446e2329e3fe2b35501056164a645d74fef33dc1b8a2a132629bf1935fa72e7"),
    ("GFDL-1.3", "961b6d8afa12e353079f8676ad28084c800a46123e76f7f4f7e7f81df82289dc"),
    ("GPL-1.0", "691c5a59863a4f1ed3f91fa6fd4c6471ed3e828c8ee38170ccfe2c1d1e6fb431"),
    ("GPL-2.0", "fb4ca1962bc4276bb42faf67dd5ed8057ed5a176bbf1a26a1237ae6d4e6b963f"),
    ("GPL-3.0", "fc55792d8f2bd541465fa1dfbf3fdabf9cf2eabb21b8b9166c2a8c1dab44f696"),
    ("LGPL-2.0", "1862ecc2c3c5e3b9e88481e95603c88e089c43e9d5702b2ec01391491b606a9e"),
    ("LGPL-2.1", "ac0856eb11aebb30c08445444c942c1ddcde9d0a0447c9ed2b8a19ab7d51eba5"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "27d164b52dfaff4b5a631cd4eebfbb7683fe882e3057f2f2e01d54692688d985"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]

#: Every known text holds one of these.
MARKS = r"(?i)licen[cs]e|permission|permitted|spdx|\bcc0?\b|copyright|redistribut|warrant"

COPYRIGHT_LINE = r"(?m)^[^\n]*(?:copyright +(?:\(c\)|[0-9])|\(c\) +[0-9]|©|all rights reserved)[^\n]*$"


def canonical(text: Column) -> Column:
    """Lower case without copyright lines, punctuation and variant spellings; words joined by one space."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    out = F.replace(out, F.lit(STEM[0]), F.lit(STEM[1]))
    for variant, common in EQUIVALENT:
        out = F.replace(out, F.lit(f" {variant} "), F.lit(f" {common} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null if that is empty."""
    return let(canonical(text), lambda c: F.when(c != "", F.sha2(c, 256)))


def known_table(spark: SparkSession, known: list[tuple[str, str]], digests: list[tuple[str, str]]) -> DataFrame:
    """(digest, name): one row for each known digest; of two names the first in order."""
    texts = spark.createDataFrame(known, "name string, body string").select(digest(F.col("body")).alias("digest"), "name")
    table = texts.unionByName(spark.createDataFrame(digests, "name string, digest string")).where("digest is not null")
    return table.groupBy("digest").agg(F.min("name").alias("name"))


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, id_col: str = "doc_id", text_col: str = "text", digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """doc_id, license of the whole text (null: none), line_licenses (sorted, joined by a comma), n_license_lines.

    The digests of texts and lines are joined to those of the known texts; up to
    MAX_KNOWN of them the known side is broadcast, beyond that it is shuffled.
    """
    small = len(known) + len(digests) <= MAX_KNOWN
    table = known_table(docs.sparkSession, known, digests)
    table = F.broadcast(table) if small else table
    text = text_or_empty(text_col)
    # Length says nothing: canonical forms drop copyright lines and punctuation.  Every known text names a licence or a mark.
    plain = digests is DIGESTS and all(re.search(MARKS, body) for _, body in known)
    marked = (lambda x: x.rlike(MARKS)) if plain else (lambda x: F.lit(True))
    lines = F.filter(F.transform(F.filter(F.split(text, "\n"), marked), digest), lambda x: x.isNotNull())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(marked(text), F.struct(digest(text).alias("whole"), lines.alias("lines"))).alias("f"))
    rows = keep(rows.select("doc_id", "f.whole", "f.lines", F.sha2(F.array_join("f.lines", ","), 256).alias("key")))
    # Rows that repeat an id are told apart by their lines; equal ones count once.
    places = rows.where(F.size("lines") > 0).select("doc_id", "key", F.posexplode("lines").alias("place", "digest"))
    found = places.join(table, "digest").select("doc_id", "key", "place", "name").distinct().groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    found = found.agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("line_licenses"), F.count(F.lit(1)).alias("n_license_lines"))
    named = rows.join(table.withColumnsRenamed({"digest": "whole", "name": "license"}), "whole", "left")
    out = named.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    return out.select("doc_id", "license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_canonical(x: str) -> str:
    out = f"regexp_replace(lower({x}), '{COPYRIGHT_LINE}', '', 'g')"
    out = f"' ' || trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    out = f"replace({out}, '{STEM[0]}', '{STEM[1]}')"
    for variant, common in EQUIVALENT:
        out = f"replace({out}, ' {variant} ', ' {common} ')"
    return f"trim({out})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP1_SQL = f"""
WITH known(license, body) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in KNOWN)}),
k AS (SELECT h, min(license) AS license FROM (
  SELECT sha256({_sql_canonical("body")}) AS h, license FROM known UNION ALL SELECT * FROM (VALUES {", ".join(f"({_quoted(b)}, {_quoted(a)})" for a, b in DIGESTS)})) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
f AS (
  SELECT doc_id, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS line_licenses, count(*) AS n_license_lines
  FROM (SELECT doc_id, {_sql_canonical("line")} AS c FROM l) JOIN k ON sha256(c) = k.h WHERE c <> '' GROUP BY doc_id
), w AS (SELECT doc_id, {_sql_canonical("coalesce(text, '')")} AS c FROM documents)
SELECT w.doc_id, k.license, coalesce(f.line_licenses, '') AS line_licenses, coalesce(f.n_license_lines, 0)::BIGINT AS n_license_lines
FROM w LEFT JOIN k ON sha256(w.c) = k.h AND w.c <> '' LEFT JOIN f ON w.doc_id = f.doc_id
"""
