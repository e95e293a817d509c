"""Licence scans by canonical digest lookup.

A text is normalised line by line: lower-cased, everything but letters and digits made
one space, copyright lines dropped, equivalent spellings unified. The SHA-256 of the
normalised whole is joined to the digests of known licence texts, and so are those of
its single lines, where a licence may be stated in one sentence. Of short licences the texts
are here, of long ones (Apache, GPL, LGPL, GFDL, MPL, CC0, Artistic) the digests of the published texts.
The table of known digests has a few dozen rows whatever the data, so it is broadcast.

Null counts as empty; a text without letters or digits has the digest of the empty
text and no licence. Rows are never merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The texts of widely used short licences and of the sentences that name one.
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: (licence, title, text)
LICENCES = (
    ("MIT", "MIT License", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n' + _WARRANTY),
    ("MIT-0", "MIT No Attribution", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n' + _WARRANTY),
    ("ISC", "ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY),
    ("0BSD", "Zero-Clause BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", "zlib License", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Apache License notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "", "Released under the MIT License."),
    ("MIT", "", "Licensed under the MIT License."),
    ("Apache-2.0", "", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "", "Licensed under CC BY-SA 4.0."),
)

#: Copyright lines, after normalisation.
COPYRIGHT = r"^((portions )?copyright (c )?([0-9]{4}|year|yyyy|by |the authors)|c [0-9]{4} ).*$|^all rights reserved$"
#: Spellings that count as equal, after normalisation: (pattern, replacement); ``{}`` stands for the groups in order. Words end
#: at a space or the line's end, which both engines see alike.
SPELLINGS = (
    (r"licenc", "licens"),
    (r"([a-z]{3})is(ation|ations|e|ed|es|ing)( |$)", "{}iz{}{}"),
    (r"(anal|catal)ys(e|ed|es|ing)( |$)", "{}yz{}{}"),
    (r"(col|fav|hon|behavi|neighb|lab|harb|endeav)our", "{}or"),
    (r"(cance|labe|mode|signa|trave)ll(ed|ing|er)", "{}l{}"),
    (r"(cent|theat|calib|fib|lit)re(s?)( |$)", "{}er{}{}"),
    (r"(acknowledg|judg)ement", "{}ment"),
    (r"(anal|catal|dial)ogue", "{}og"),
    (r"(off|def)ence", "{}ense"),
    (r"practis(e|ed|es|ing)( |$)", "practic{}{}"),
    (r"programme(s?)( |$)", "program{}{}"),
    (r"fulfil(s|ment)?( |$)", "fulfill{}{}"),
    (r"(^| )whilst( |$)", "{}while{}"),
    (r"wilful", "willful"),
    (r"artefact", "artifact"),
    (r"per cent( |$)", "percent{}"),
    (r"copyright (owner|holder)", "copyright owner"),
    (r"non (infring|commercial|exclusive)", "non{}"),
    (r"sub (licens)", "sub{}"),
)


def _groups(replacement: str, mark: str) -> str:
    out, n = "", 0
    for part in replacement.split("{}"):
        out += (f"{mark}{n}" if n else "") + part
        n += 1
    return out


def normal_line(line: Column) -> Column:
    # Each step uses the one before once: a column that is used twice here is computed twice, step over step.
    x = F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))
    for pattern, to in SPELLINGS:
        x = F.regexp_replace(x, pattern, _groups(to, "$"))
    return F.regexp_replace(x, COPYRIGHT, "")


def normal_lines(text: Column) -> Column:
    """The normalised lines of a text that are not empty."""
    return F.filter(F.transform(F.split(text, "\n"), normal_line), lambda x: x != "")


#: Digests of whole published licence texts, normalised as here; with and without what follows the terms.
DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "eabe51f71b7f9b632fd1800716d5a623a7786d324b3af57bc31e4509d6175acc"),
    ("Apache-2.0", "2daa4a3e14d5607e99fe14016720a6a2979470468effbdbfddb38f5582e2aca1"),
    ("Apache-2.0", "3380e0d52349696674d7b6d5e6d89df12ceb00284472c622e9dcbadd10d29fb6"),
    ("Artistic-1.0-Perl", "88ebfe94756af79ba83ed260e1721276fd27cabc897b712ced5cbe8c7749c87f"),
    ("CC0-1.0", "85e7f1567f905ed7e2739b6fe92701ad687add4098453a68037228f233627e59"),
    ("GFDL-1.2", "560fd06150b99349a696913a9e6f95efb40dd9b52159ba7ffcd3b11316568af8"),
    ("GFDL-1.3", "e95acf703b023b992acffc36c784ae76f14fff34f3e491a96033c377e49cc7d0"),
    ("GPL-1.0", "2ebd5dc3f47373f326db33ddd772e18da488ab49febd8ac12292f723b66ad957"),
    ("GPL-1.0", "cb40ac3123ab1a5b6c7a420b3ebccd581c696fa6b90d73f8e54b9c465d5ec18d"),
    ("GPL-1.0", "ec041bd2c91a611c934134a19dcffaf8e6246959e2395a3f7140a7f93264a323"),
    ("GPL-2.0", "b019d0e69a0bbc83d589429c3be491c5543906e3a0230cdad3abb8b0ad52c768"),
    ("GPL-2.0", "0c42fa5c2cbc082aef61042ed1206d8e9189c342dd03173eb6b880937a6d75a7"),
    ("GPL-2.0", "da183007acd891b0f7df0bf8866030e75507f07d98aab39c8d3759ae425fedda"),
    ("GPL-3.0", "e17df5a0ba0d1e4e497dd665653a80c9d72afa3e081d8ee6f073d7c16406b4ec"),
    ("GPL-3.0", "d1879137cd2bae3e663958cc34166c81a515a5c79a377fae58a7194cbac658d5"),
    ("GPL-3.0", "31d050423edc77ebe913b0b0906b1639093683ed4318720a153d5139f8b96f5c"),
    ("LGPL-2.0", "5d7123c488837f53bd6335131ebb63f45e3ed89e79cdedff023deeffe897123e"),
    ("LGPL-2.0", "eff8c8e499bef5d6721cecfab586ea49326348c612e0b0b140afd01a1b838918"),
    ("LGPL-2.0", "6a355ea30fae934d9696bcbcbd9300724bbe6b93a6d1f8344ab41da2e18e8f36"),
    ("LGPL-2.1", "01ccb87ae8d3b97ac110809b84edc1fb1c0304c221e2df07cc7362d5faaeded3"),
    ("LGPL-2.1", "f1aab6471e1fa9976601b4dc7b9088e827c4766b63de60ed47f007a783fb227e"),
    ("LGPL-2.1", "2e14c9316ad23f963c9dda2e46674503e870e8d18cd4254736fee5e69eb9bc54"),
    ("LGPL-3.0", "9111884d93a72b30a3d024876dab3d755949ac2cfab230268a4169a93b86560c"),
    ("MPL-1.1", "ede2cf83fff2d61d68d0b7e0474293d8131487a356b9b4339dac53a4fd2590a4"),
    ("MPL-2.0", "28a06b5c59822a95bd5807f5441a3a8f8cc56485799422a443bb26f5587d2b89"),
)


def known_digests(spark: SparkSession, licences=LICENCES, digests=DIGESTS) -> DataFrame:
    """(digest, licence): each text with and without its title, and the digests of longer texts."""
    texts = sorted({(name, x) for name, title, text in licences for x in (text, f"{title}\n{text}")})
    rows = F.array(*(F.struct(F.lit(name).alias("licence"), F.lit(x).alias("t")) for name, x in texts))
    rows = spark.range(1).select(F.explode(rows).alias("x"))
    rows = rows.select(F.sha2(F.concat_ws(" ", normal_lines(F.col("x.t"))), 256).alias("digest"), "x.licence")
    if digests:
        whole = F.array(*(F.struct(F.lit(d).alias("digest"), F.lit(name).alias("licence")) for name, d in digests))
        rows = rows.unionByName(spark.range(1).select(F.explode(whole).alias("x")).select("x.digest", "x.licence"))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", licences=LICENCES) -> DataFrame:
    """One row per document: ``doc_id, text_digest, licence, line_licences``.

    ``licence``: whose text the whole document is, or null. ``line_licences``: those
    that a line is, sorted, each once.
    """
    if not licences:
        raise ValueError("no licences to look for")
    known = known_digests(docs.sparkSession, licences)
    lines = normal_lines(F.coalesce(F.col(text_col), F.lit("")))
    docs = docs.select(F.col(id_col).alias("doc_id"), lines.alias("lines"))
    docs = docs.select("doc_id", F.sha2(F.concat_ws(" ", "lines"), 256).alias("text_digest"), F.transform("lines", lambda x: F.sha2(x, 256)).alias("lines"))
    # The few known digests also stand in the plan as a constant, so lines need no explosion and no shuffle.
    table = F.create_map(*(F.lit(x) for row in sorted(known.collect()) for x in row))
    named = F.transform(F.array_intersect("lines", F.map_keys(table)), lambda x: F.element_at(table, x))
    docs = docs.select("doc_id", "text_digest", F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("line_licences"))
    found = docs.join(F.broadcast(known.withColumnRenamed("digest", "text_digest")), "text_digest", "left")
    return found.select("doc_id", "text_digest", "licence", "line_licences")


def _sql_line(x: str) -> str:
    x = f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for pattern, to in SPELLINGS:
        x = f"regexp_replace({x}, '{pattern}', '{_groups(to, chr(92))}', 'g')"
    return f"regexp_replace({x}, '{COPYRIGHT}', '')"


def oracle_sql(licences=LICENCES) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    texts = sorted({(name, x) for name, title, text in licences for x in (text, f"{title}\n{text}")})
    values = ", ".join(f"({quoted(n)}, {quoted(x)})" for n, x in texts)
    whole = "".join(f"UNION ALL SELECT '{d}', '{name}' " for name, d in DIGESTS)
    lines = f"list_filter(list_transform(string_split(t, chr(10)), lambda l : {_sql_line('l')}), lambda l : l <> '')"
    return f"""
WITH k AS (SELECT digest, min(licence) AS licence FROM (SELECT sha256(array_to_string({lines}, ' ')) AS digest, licence FROM (VALUES {values}) AS v(licence, t) {whole}) GROUP BY 1),
d AS (SELECT doc_id, {lines} AS ls FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
h AS (SELECT doc_id, sha256(array_to_string(ls, ' ')) AS text_digest, list_transform(ls, lambda l : sha256(l)) AS ds FROM d),
n AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS line_licences FROM (SELECT doc_id, unnest(ds) AS digest FROM h) JOIN k USING (digest) GROUP BY doc_id)
SELECT h.doc_id, text_digest, k.licence, coalesce(line_licences, '') AS line_licences
FROM h LEFT JOIN k ON h.text_digest = k.digest LEFT JOIN n ON h.doc_id = n.doc_id
"""
