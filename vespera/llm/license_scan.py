"""License scans by canonical digests, in DataFrame functions.

A text is made canonical (case, copyright lines, punctuation, equivalent spellings) and digested;
the digest is looked up among those of known licence texts by a hash join. The known table has a
few rows of fixed number and is broadcast: `known_texts()`, made canonical by the same expressions, and
the digests of longer licences (`FULL`: Apache-2.0, the GPL family, MPL and others). Further texts are read from a table by
`table_digests`; a table handed in is broadcast by Catalyst only below its own threshold.

`scan_lines` looks up whole texts and, in the same way, each whole line: documents that aren't a
licence often name one in a line.

A copyright line begins with a notice's sign and a year, or two signs ("Copyright (c)"), or says only
that all rights are reserved; a line of a licence's body that begins with "copyright" stays, as does
a notice that is a bare name.

A null text, or one without a letter or digit, has a null digest and no licence. Rows are
independent: repeated rows appear again; of known texts with one digest the smallest name counts. An
empty table gives an empty result. Only id and text are read, whatever further columns are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence texts.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
KNOWN = {
    "MIT": MIT,
    "ISC": ISC,
    "0BSD": ZERO_BSD,
    "BSD-2-Clause": BSD_HEAD + BSD_TAIL,
    "BSD-3-Clause": BSD_HEAD + BSD_NAME + BSD_TAIL,
    "Zlib": ZLIB,
    "Unlicense": UNLICENSE,
    "Unlicense-linked": UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>",
    "Apache-2.0-notice": APACHE_NOTICE,
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-line": "Released under the MIT License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
}
# Digests of the canonical forms of public licence texts: whole, then without what follows
# "END OF TERMS AND CONDITIONS", then without that line too. They hold for SPELLINGS and COPYRIGHT_LINES as they are.
FULL = {
    "Apache-2.0": (
        "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b",
        "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe",
        "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64",
    ),
    "Artistic-1.0-Perl": ("08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",),
    "CC0-1.0": ("de4b88a2c819a4661af54f735069ed878216da8b4992b919b84afa18cfc0e54c",),
    "GFDL-1.2": ("94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60",),
    "GFDL-1.3": ("a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",),
    "GPL-1.0": (
        "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a",
        "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b",
        "af30c0af27b90ec812acdb040f3dcc944a87cd893456690efe35063f39e3eeeb",
    ),
    "GPL-2.0": (
        "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6",
        "1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca",
        "c67cc53030ae25fe2e2f0143b59060eca5ad89da8d2beca1445641234d29fc88",
    ),
    "GPL-3.0": (
        "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
        "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
        "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191",
    ),
    "LGPL-2.0": (
        "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
        "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",
        "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2",
    ),
    "LGPL-2.1": (
        "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
        "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
        "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df",
    ),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-1.1": ("a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b",),
    "MPL-2.0": ("f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",),
}
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License"),
    "Zlib": ("zlib License", "The zlib License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: Spellings that licence texts use for one another, as whole words.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "cancelled": "canceled", "catalogue": "catalog", "centre": "center", "customisation": "customization", "favour": "favor", "fulfil": "fulfill",
    "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "licence": "license", "licenced": "licensed", "organisation": "organization",
    "owner": "holder", "owners": "holders", "practise": "practice", "programme": "program", "recognised": "recognized", "sublicence": "sublicense",
    "unauthorised": "unauthorized", "utilisation": "utilization", "whilst": "while", "wilful": "willful", "noncommercial": "non commercial", "per cent": "percent", "https": "http",
}
SIGN = r"(?:\([cC]\)|©|[cC][oO][pP][yY][rR][iI][gG][hH][tT]:?)"
COPYRIGHT_LINES = rf"(?m)^[ \t]*(?:{SIGN}[ \t,]*(?:{SIGN}|[\[<(]?(?:[0-9]{{4}}|yyyy|YYYY|year))[^\n]*|[aA][lL][lL] [rR][iI][gG][hH][tT][sS] [rR][eE][sS][eE][rR][vV][eE][dD][ \t.]*)\r?$"
OTHER = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line, words between two spaces each. Spaces are doubled while words are replaced, so that neighbours don't share one."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, COPYRIGHT_LINES, "")), OTHER, "  ")
    out = F.concat(F.lit("  "), F.replace(plain, F.lit("\n"), F.lit("  \n  ")), F.lit("  "))
    for a, b in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.transform(F.split(out, "\n"), lambda line: F.trim(F.regexp_replace(line, " +", " ")))


def canonical(text: Column) -> Column:
    return F.array_join(F.array_remove(canonical_lines(text), ""), " ")


def digest(text: Column) -> Column:
    return F.sha2(F.nullif(canonical(text), F.lit("")), 256)


def known_texts() -> dict[str, str]:
    """KNOWN, and its texts below their titles."""
    return KNOWN | {f"{name} titled {i}": f"{title}\n\n{KNOWN[name]}" for name, titles in TITLES.items() for i, title in enumerate(titles, 1)}


def known_digests(spark, known: dict[str, str] | None = None) -> DataFrame:
    """digest, license of the given texts; without any, of known_texts() and FULL."""
    texts = table_digests(spark.createDataFrame([(k.split(" titled ")[0], v) for k, v in sorted((known or known_texts()).items())], "license string, known string"), text_col="known")
    full = [] if known else [(d, name) for name, digests in FULL.items() for d in digests]
    return texts.unionByName(spark.createDataFrame(full, "digest string, license string"))


def table_digests(texts: DataFrame, license_col: str = "license", text_col: str = "text") -> DataFrame:
    """digest, license of a table of known texts, for scan(known=...); texts without a letter or digit are left out."""
    rows = texts.select(F.col(license_col).alias("license"), digest(F.col(text_col)).alias("digest")).where("digest is not null")
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest, license (null: none) of every whole text; known: (digest, license), one row a digest."""
    table = F.broadcast(known_digests(docs.sparkSession)) if known is None else known
    return docs.select(F.col(id_col), digest(F.col(text_col)).alias("digest")).join(table, "digest", "left").select(id_col, "digest", "license")


def scan_lines(docs: DataFrame, known: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest, license of every whole text, and line_licenses: the licences whose known text is a whole line of it, sorted.

    Lines are compared with the digests of a fixed number of known texts, which are in the plan.
    """
    table = known_digests(docs.sparkSession, known)
    by_digest = {r["digest"]: r["license"] for r in table.collect()}
    lines = canonical_lines(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), lines.alias("lines"))
    whole = F.sha2(F.nullif(F.array_join(F.array_remove("lines", ""), " "), F.lit("")), 256)
    names = F.create_map(*(F.lit(x) for pair in by_digest.items() for x in pair)) if by_digest else F.lit(None).cast("map<string,string>")
    each = F.transform("lines", lambda line: F.when(line != "", F.sha2(line, 256)))
    found = F.transform(F.filter(each, lambda d: d.isin(list(by_digest))), lambda d: names[d])
    judged = rows.select("id", whole.alias("digest"), F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<string>")).alias("line_licenses"))
    return judged.join(F.broadcast(table), "digest", "left").select(F.col("id").alias(id_col), "digest", "license", "line_licenses")


def scan_sql(known: dict[str, str] | None = None) -> str:
    """scan_lines in SQL for DuckDB, over the table documents; line_licenses comma-joined."""

    def lines_sql(col: str) -> str:
        out = f"'  ' || replace(regexp_replace(lower(regexp_replace({col}, '{COPYRIGHT_LINES}', '', 'g')), '{OTHER}', '  ', 'g'), chr(10), '  ' || chr(10) || '  ') || '  '"
        for a, b in SPELLINGS.items():
            out = f"replace({out}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
        return f"list_transform(string_split({out}, chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g')))"

    whole = "sha256(nullif(array_to_string(list_filter(lines, lambda x: x <> ''), ' '), ''))"
    rows = ", ".join("('{}', '{}')".format(k.split(" titled ")[0], v.replace("'", "''")) for k, v in sorted((known or known_texts()).items()))
    full = "" if known else " UNION ALL SELECT * FROM (VALUES {}) f(digest, license)".format(", ".join(f"('{d}', '{name}')" for name, digests in FULL.items() for d in digests))
    return f"""WITH known AS (SELECT {whole} AS digest, min(name) AS license FROM (SELECT name, {lines_sql("body")} AS lines FROM (VALUES {rows}) t(name, body)) GROUP BY 1{full}),
cut AS (SELECT doc_id, {lines_sql("text")} AS lines FROM documents),
named AS (SELECT doc_id, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS line_licenses
  FROM (SELECT doc_id, unnest(lines) AS line FROM cut) l JOIN known k ON l.line <> '' AND k.digest = sha256(l.line) GROUP BY doc_id)
SELECT c.doc_id, {whole} AS digest, k.license, coalesce(n.line_licenses, '') AS line_licenses
FROM cut c LEFT JOIN known k ON k.digest = {whole} LEFT JOIN named n USING (doc_id)"""
