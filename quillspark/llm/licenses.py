"""Operator 8, licence scans: canonical digest lookup, in DataFrame functions alone.

A text is brought to a canonical form line by line: lower case, copyright lines left out, words (runs of letters or
digits) joined by one blank, equivalent spellings made one. The canonical lines, joined, give the digest of the
entire text; each line gives one of its own. Both kinds are hash-joined to the digests of known licence texts and
notices: the table here and what the caller adds, broadcast while it is counted to be small.

Canonical forms are made once a document; the join then runs over 16-byte digests. Copies of a line in a text count
once each in n_notices. Null and empty texts have the digest of the empty string, which is no licence. Repeated rows
and rows without doc_id keep one row each. A digest that several licences share names the first of them by name. A very
long text is cut into its lines in its own row; only digests leave it. Extra columns are not read; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import few, table, written

# Licence texts and notices as published, and spellings that their matching guidelines hold equal.
_PERMIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: (licence, text): entire texts.
TEXTS = (
    ("MIT", _PERMIT),
    ("MIT", "MIT License\n" + _PERMIT),
    ("MIT", "The MIT License (MIT)\n" + _PERMIT),
    ("ISC", _ISC + "\n" + _ISC_END),
    ("ISC", "ISC License\n" + _ISC + "\n" + _ISC_END),
    ("BSD-2-Clause", _BSD + "\n" + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD + "\n" + _BSD_END),
    ("BSD-3-Clause", _BSD + "\n" + _BSD_3 + "\n" + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD + "\n" + _BSD_3 + "\n" + _BSD_END),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Apache-2.0", _APACHE),
)
#: (licence, line): notices of one line.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
#: (licence, digest): canonical digests of long licence texts, wrapped as published; the SQL doesn't know them.
DIGESTS = (
    ("Apache-2.0", "9768e9ac0a2ddb298695e7c2ca9bfa36"),
    ("Apache-2.0", "db4fae888ce4068810986a16e5953e7a"),  # without the appendix
    ("GPL-1.0", "e64afbb3eb9ed9907294af675f791aba"),
    ("GPL-1.0", "dbf3c47f5a8f127e58d08cabc1ebb916"),  # without the appendix
    ("GPL-2.0", "e374d0b43c25aed1a2b28951fe92a546"),
    ("GPL-2.0", "cbb3451938de95cbb302d3c10690ede8"),  # without the appendix
    ("GPL-3.0", "3d166aeeeb2ec1fea896f0a01f69dc5c"),
    ("GPL-3.0", "911c13fc9d0f569481e5c351a7c4f103"),  # without the appendix
    ("LGPL-2.0", "7d054715126defc8a18808a6934f14a4"),
    ("LGPL-2.0", "1389f4e6c9257fffaaa58a4ba72e4209"),  # without the appendix
    ("LGPL-2.1", "519c5306e9399a753b0e3b10cc3f1fbd"),
    ("LGPL-2.1", "ea4739ccf5314c5f636f979cc03259e2"),  # without the appendix
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-1.1", "5ceeca1c675fb218d9d7a541deb0cd2a"),
    ("MPL-2.0", "35fb4d2625087f7fd780039aa7b4ebb2"),
    ("CC0-1.0", "48fee373d5abaf94bbae926793a16535"),
    ("GFDL-1.2", "fd920ddc37a3d7e8c50763b83c95353c"),
    ("GFDL-1.3", "69253b6f159e4a07012cc5d95badaa85"),
    ("Artistic-1.0-Perl", "6f45651e3e829ff0f6d4fc9f04384095"),
)
#: (licence, line): more notices of one line; the SQL doesn't know them.
MORE_NOTICES = tuple(
    (name, line)
    for name, title, spdx in (
        ("Apache-2.0", "Apache License, Version 2.0", ()),
        ("Apache-2.0", "Apache License 2.0", ()),
        ("MIT", "MIT License", ()),
        ("ISC", "ISC License", ("ISC",)),
        ("Zlib", "zlib License", ("Zlib",)),
        ("BSD-2-Clause", "BSD 2-Clause License", ("BSD-2-Clause",)),
        ("BSD-3-Clause", "BSD 3-Clause License", ("BSD-3-Clause",)),
        ("GPL-2.0", "GNU General Public License, version 2", ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later")),
        ("GPL-3.0", "GNU General Public License, version 3", ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later")),
        ("LGPL-2.1", "GNU Lesser General Public License, version 2.1", ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later")),
        ("LGPL-3.0", "GNU Lesser General Public License, version 3", ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later")),
        ("MPL-2.0", "Mozilla Public License, version 2.0", ("MPL-2.0",)),
        ("CC0-1.0", "CC0 1.0 Universal License", ("CC0-1.0",)),
        ("CC-BY-4.0", "CC BY 4.0 License", ("CC-BY-4.0",)),
        ("CC-BY-SA-4.0", "CC BY-SA 4.0 License", ("CC-BY-SA-4.0",)),
        ("CC-BY-NC-4.0", "CC BY-NC 4.0 License", ("CC-BY-NC-4.0",)),
    )
    for line in (*[f"{how} under the {title}." for how in ("Licensed", "Released", "Distributed", "This work is licensed")], *[f"SPDX-License-Identifier: {x}" for x in spdx])
)
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "centre": "center",
    "favour": "favor",
    "fulfil": "fulfill",
    "https": "http",
    "judgement": "judgment",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "offence": "offense",
    "organisation": "organization",
    "owner": "holder",
    "owners": "holders",
    "practise": "practice",
    "programme": "program",
    "recognise": "recognize",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}
#: A line that begins so names the holder of a copyright, whoever it is.
COPYRIGHT = r"^[^a-z0-9(©]*(copyright|\(c\)|©|all rights reserved)"


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line; copyright lines and lines without words become empty."""
    # spellings of one length are few, so a word is first looked at by its length
    longest = max(map(len, SPELLINGS))
    spell = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    word = lambda w: F.when((F.length(w) >= 5) & (F.length(w) <= longest), F.coalesce(F.element_at(spell, w), w)).otherwise(w)

    def canonical(line: Column) -> Column:
        words = F.filter(F.split(line, r"[^\p{L}\p{N}]+"), lambda w: w != "")
        return F.when(line.rlike(COPYRIGHT), F.lit("")).otherwise(F.array_join(F.transform(words, word), " "))

    return F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n", -1), canonical)


def digest(x: Column) -> Column:
    return F.unhex(F.md5(x))


def known(spark: SparkSession) -> DataFrame:
    """(unit, licence, digest): unit is text or line."""
    rows = [("text", *x) for x in TEXTS] + [("line", *x) for x in NOTICES + MORE_NOTICES]
    lines = F.filter(canonical_lines(F.col("text")), lambda x: x != "")
    made = spark.createDataFrame(rows, "unit string, license string, text string").select("unit", "license", digest(F.array_join(lines, " ")).alias("digest"))
    fixed = spark.createDataFrame(list(DIGESTS), "license string, digest string").select(F.lit("text").alias("unit"), "license", F.unhex("digest").alias("digest"))
    return made.unionByName(fixed).distinct()


def known_texts(licences: DataFrame) -> DataFrame:
    """(unit, license, digest) of a table (license, text) of entire licences, to be given to ``scan``; null and empty texts are none."""
    lines = F.filter(canonical_lines(F.col("text")), lambda x: x != "")
    return licences.where(F.size(lines) > 0).select(F.lit("text").alias("unit"), "license", digest(F.array_join(lines, " ")).alias("digest")).distinct()


def scan(docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """doc_id, text_digest, license (of the entire text, or null), notices (licences of its lines) and n_notices.

    ``more``: licences beside the table here, as by ``known_texts``. A text that several names have goes by the first.
    """
    lines = F.filter(canonical_lines(F.col("text")), lambda x: x != "")
    canonical = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lines.alias("lines"))
    digests = written(canonical.select("doc_id", digest(F.array_join("lines", " ")).alias("text_digest"), F.transform("lines", digest).alias("line_digests")), "licence-digests")
    names = known(docs.sparkSession)
    if more is not None:
        names = names.unionByName(more.select("unit", "license", "digest"))
    names = few(names.groupBy("unit", "digest").agg(F.min("license").alias("license")), "licence-names")
    of_lines = digests.select("doc_id", "text_digest", F.explode("line_digests").alias("digest")).join(names.where("unit = 'line'"), "digest")
    # a text is known by doc_id and digest; its copies have the same notices
    noticed = of_lines.groupBy("doc_id", "text_digest", "license").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id", "text_digest").agg(F.array_join(F.array_sort(F.collect_list("license")), ",").alias("notices"), F.sum("n").alias("n"))
    copies = digests.groupBy("doc_id", "text_digest").agg(F.count(F.lit(1)).alias("copies"))
    texts = copies.join(names.where("unit = 'text'").select(F.col("digest").alias("text_digest"), "license"), "text_digest", "left")
    same = texts.doc_id.eqNullSafe(noticed.doc_id) & (texts.text_digest == noticed.text_digest)
    found = texts.join(noticed, same, "left").select(texts.doc_id, F.lower(F.hex(texts.text_digest)).alias("text_digest"), "license", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce((F.col("n") / F.col("copies")).cast("long"), F.lit(0).cast("long")).alias("n_notices"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_"))
    return found.drop("_")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql(rows: tuple[tuple[str, str], ...]) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quote(a)}, {quote(b)})" for a, b in rows)


_CANON = f"""list_filter(list_transform(string_split(lower(coalesce(text, '')), chr(10)), lambda l:
    CASE WHEN regexp_matches(l, '{COPYRIGHT}') THEN '' ELSE array_to_string(list_transform(
        list_filter(regexp_split_to_array(l, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''),
        lambda w: coalesce(MAP {{{", ".join(f"'{a}': '{b}'" for a, b in SPELLINGS.items())}}}[w], w)), ' ') END), lambda x: x <> '')"""

ORACLE_SQL = f"""
WITH known AS (
    SELECT unit, min(license) AS license, digest FROM (
        SELECT unit, license, md5(array_to_string({_CANON}, ' ')) AS digest FROM (
            SELECT 'text' AS unit, license, text FROM (VALUES {_sql(TEXTS)}) t(license, text)
            UNION ALL SELECT 'line', license, text FROM (VALUES {_sql(NOTICES + MORE_NOTICES)}) t(license, text))
        UNION ALL SELECT 'text', license, digest FROM (VALUES {_sql(DIGESTS)}) t(license, digest)) GROUP BY unit, digest),
canon AS (SELECT row_number() OVER () AS r, doc_id, {_CANON} AS lines FROM documents),
hits AS (
    SELECT r, license, count(*) AS n FROM (SELECT r, md5(unnest(lines)) AS digest FROM canon) JOIN (SELECT * FROM known WHERE unit = 'line') USING (digest) GROUP BY ALL),
noticed AS (SELECT r, string_agg(license, ',' ORDER BY license) AS notices, sum(n)::BIGINT AS n FROM hits GROUP BY r)
SELECT doc_id, md5(array_to_string(lines, ' ')) AS text_digest, k.license AS license, coalesce(notices, '') AS notices, coalesce(n, 0)::BIGINT AS n_notices
FROM canon LEFT JOIN noticed USING (r) LEFT JOIN (SELECT * FROM known WHERE unit = 'text') k ON k.digest = md5(array_to_string(lines, ' '))
"""
