"""License scans by canonical digest lookup.

Native: DataFrame functions only. A text is brought into a canonical form: lower case, copyright lines removed,
equivalent spellings made one, and everything that is neither letter nor digit turned into single blanks. The MD5
of the form is looked up among the digests of known licences in a hash join. Looked up are the whole text, each of
its lines and paragraphs, and each run of as many paragraphs as a known form has, so that a notice or a whole licence
inside a document is found as well as a licence file. Long licences are known by their digests alone.

A unit whose canonical length no known form has cannot have a known digest, so those units are left out before the
hash is taken. The licence table is broadcast: it is a list of ``KNOWN`` forms, whatever the input.

Defined results: null counts as empty; an empty text matches nothing. Repeated rows give repeated rows. Licences
found are sorted and distinct. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import table

# Spellings that licence matching guidelines treat as equal, longest first where one holds another.
SPELLINGS = (
    ("https://", "http://"),
    ("sublicence", "sublicense"),
    ("licence", "license"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorise", "authorize"),
    ("non-commercial", "noncommercial"),
    ("copyright holder", "copyright owner"),
    ("per cent", "percent"),
    ("whilst", "while"),
    ("fulfil ", "fulfill "),
)
COPYRIGHT = r"(copyright[ \t:,-]*(\(c\)|©|[0-9<\[{]|by |the )|\(c\)|©|all rights reserved)"
COPYRIGHT_LINE = rf"(?m)^[^\w\n]*{COPYRIGHT}[^\n]*$"
OTHER = r"[^\p{L}\p{N}\n]+"

# Parts of the BSD licences.
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:"
)
_BSD_SOURCE = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer."
)
_BSD_BINARY = (
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

# Texts and notices of common licences.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License");\n'
        "you may not use this file except in compliance with the License.\n"
        "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n"
        "Unless required by applicable law or agreed to in writing, software\n"
        'distributed under the License is distributed on an "AS IS" BASIS,\n'
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n"
        "See the License for the specific language governing permissions and\nlimitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.",
    ),
    ("BSD-2-Clause", f"{_BSD_START}\n\n{_BSD_SOURCE}\n\n{_BSD_BINARY}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_START}\n\n{_BSD_SOURCE}\n\n{_BSD_BINARY}\n\n{_BSD_NAMES}\n\n{_BSD_END}"),
)

# Canonical digests of whole licence texts as their stewards publish them: licence, MD5, characters,
# paragraphs.
KNOWN_DIGESTS = (
    ("Apache-2.0", "1bca074a1b9800bdf6fd0eb214469b96", 9821, 32),
    ("Artistic-1.0-Perl", "c1b81bf4478b19597097b63e59382266", 5823, 29),
    ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48", 6692, 13),
    ("GFDL-1.2", "8d0843544e24727fdc5e9df92d1f8263", 19576, 57),
    ("GFDL-1.3", "93019451609b1c5343aaffc95cde060b", 22005, 67),
    ("GPL-1.0", "b37a688f44419d3168b23775b65749eb", 11762, 50),
    ("GPL-2.0", "422f821c6c0b1812cbde7c1c3be04922", 17113, 59),
    ("GPL-3.0", "6c7bdf1b2028403454e44e3c32401ce2", 33397, 122),
    ("LGPL-2.0", "ebf358251bfe9161668a8c8251261977", 24126, 83),
    ("LGPL-2.1", "1ff066c677365f47fea81c911a7c822e", 25213, 85),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d", 7104, 37),
    ("MPL-1.1", "a708f02208e9c42d3644490185833425", 22339, 73),
    ("MPL-2.0", "35fb4d2625087f7fd780039aa7b4ebb2", 14271, 83),
)


def canonical_lines(text: Column) -> Column:
    """The canonical form with line ends kept: words with single blanks, and newlines."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.replace(F.replace(out, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, OTHER, " ")


def whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def paragraphs(lines: Column) -> Column:
    """The canonical paragraphs that hold a word."""
    return F.filter(F.transform(F.split(lines, r"\n *(\n *)+"), whole), lambda x: x != "")


def known_digests(
    spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple, ...] = KNOWN_DIGESTS
) -> DataFrame:
    """(license, digest, n_chars, n_paragraphs) of the known forms; texts go through the functions that the documents
    go through."""
    forms = spark.createDataFrame(list(known), "license string, text string")
    lines = forms.select("license", canonical_lines(F.col("text")).alias("lines"))
    made = lines.select("license", whole(F.col("lines")).alias("form"), F.size(paragraphs(F.col("lines"))).alias("n_paragraphs"))
    made = made.select("license", F.md5("form").alias("digest"), F.length("form").alias("n_chars"), "n_paragraphs")
    listed = spark.createDataFrame(list(digests), "license string, digest string, n_chars int, n_paragraphs int")
    return made.union(listed).distinct()


def _runs(known: list) -> Column:
    """The runs of paragraphs (column ``_paras``, their lengths ``_sizes``), but not all of them, that have as many
    paragraphs and characters as a known form of several paragraphs."""
    by_size: dict[int, set[int]] = {}
    for r in known:
        if r["n_paragraphs"] > 1:
            by_size.setdefault(r["n_paragraphs"], set()).add(r["n_chars"])
    if not by_size:
        return F.array().cast("array<string>")
    forms = ", ".join(f"named_struct('m', {m}, 'l', array({', '.join(map(str, sorted(n)))}))" for m, n in sorted(by_size.items()))
    length = "aggregate(slice(_sizes, i + 1, k.m), k.m - 1, (a, x) -> a + x)"
    return F.expr(
        f"flatten(transform(filter(array({forms}), k -> size(_paras) > k.m), k -> transform("
        f"filter(sequence(0, size(_paras) - k.m), i -> array_contains(k.l, {length})), "
        "i -> array_join(slice(_paras, i + 1, k.m), ' '))))"
    )


def license_report(
    docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN, listed: tuple[tuple, ...] = KNOWN_DIGESTS
) -> DataFrame:
    """doc_id, text_digest, whole_license (null if none), licenses (comma-joined), n_hits (lines, paragraphs and runs
    of paragraphs that are known)."""
    digests = known_digests(docs.sparkSession, known, listed)
    forms = digests.select("n_chars", "n_paragraphs").distinct().collect()  # of the known forms
    lengths = sorted({r["n_chars"] for r in forms})
    fits = lambda x: F.length(x).isin(lengths) & (F.length(x) > 0)
    rows = docs.select("doc_id", canonical_lines(F.col("text")).alias("_lines")).select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", "_lines", whole(F.col("_lines")).alias("_whole"), paragraphs(F.col("_lines")).alias("_paras")
    )
    rows = rows.withColumn("_sizes", F.transform("_paras", F.length))
    lines = F.filter(F.transform(F.split("_lines", "\n"), lambda x: F.trim(x)), fits)
    blocks = F.filter(F.split("_lines", r"\n *(\n *)+"), lambda x: F.instr(F.trim(F.translate(x, "\n", "\x00")), "\x00") > 0)
    blocks = F.filter(F.transform(blocks, whole), fits)
    own = F.when(fits(F.col("_whole")), F.array("_whole")).otherwise(F.array().cast("array<string>"))
    units = rows.select(
        "_row",
        "doc_id",
        F.md5("_whole").alias("text_digest"),
        F.explode_outer(
            F.concat(
                F.transform(own, lambda x: F.struct(F.lit(True).alias("is_whole"), F.md5(x).alias("digest"))),
                F.transform(
                    F.concat(lines, blocks, _runs(forms)), lambda x: F.struct(F.lit(False).alias("is_whole"), F.md5(x).alias("digest"))
                ),
            )
        ).alias("_unit"),
    ).select("_row", "doc_id", "text_digest", "_unit.is_whole", "_unit.digest")
    found = units.join(F.broadcast(digests.select("digest", "license")), "digest", "left")
    return (
        found.groupBy("_row", "doc_id", "text_digest")
        .agg(
            F.max(F.when(F.col("is_whole"), F.col("license"))).alias("whole_license"),
            F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
            F.count_if(F.col("license").isNotNull() & ~F.col("is_whole")).alias("n_hits"),
        )
        .drop("_row")
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def oracle_sql(known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple, ...] = KNOWN_DIGESTS) -> str:
    """The same report in DuckDB SQL, which normalises the known texts itself."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def canonical(text: str) -> str:
        out = f"replace(replace(lower(coalesce({text}, '')), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
        out = f"regexp_replace({out}, '{COPYRIGHT_LINE}', '', 'g')"
        for old, new in SPELLINGS:
            out = f"replace({out}, {quote(old)}, {quote(new)})"
        return rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"

    def one(text: str) -> str:
        return rf"trim(regexp_replace({text}, '[ \n]+', ' ', 'g'))"

    values = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in known)
    listed = ", ".join(f"({quote(name)}, {quote(digest)}, {n})" for name, digest, _, n in digests)

    def split(lines: str) -> str:
        return f"list_filter(list_transform(regexp_split_to_array({lines}, '\\n *(\\n *)+'), lambda b: {one('b')}), lambda b: b <> '')"
    return rf"""
WITH k AS (
  SELECT DISTINCT name AS license, md5({one(canonical("body"))}) AS digest, len({split(canonical("body"))}) AS m FROM (VALUES {values}) v(name, body)
  UNION SELECT * FROM (VALUES {listed}) v(name, digest, m)
), p AS (
  SELECT doc_id, {split(canonical("text"))} AS ps FROM documents
), d AS (
  SELECT doc_id, {canonical("text")} AS lines FROM documents
), w AS (
  SELECT doc_id, lines, {one("lines")} AS form FROM d
), u AS (
  SELECT doc_id, true AS is_whole, md5(form) AS digest FROM w WHERE form <> ''
  UNION ALL
  SELECT doc_id, false, md5(trim(unnest(string_split(lines, chr(10))))) FROM w
  UNION ALL
  SELECT doc_id, false, md5({one("b")}) FROM (
    SELECT doc_id, unnest(regexp_split_to_array(lines, '\n *(\n *)+')) AS b FROM w
  ) WHERE instr(trim(trim(b, chr(10) || ' ')), chr(10)) > 0
  UNION ALL
  SELECT doc_id, false, md5(array_to_string(ps[i:i + m - 1], ' ')) FROM (
    SELECT doc_id, ps, m, unnest(range(1, len(ps) - m + 2)) AS i FROM p JOIN (SELECT DISTINCT m FROM k WHERE m > 1) s ON len(ps) > m
  )
), f AS (
  SELECT u.doc_id, max(CASE WHEN is_whole THEN license END) AS whole_license,
         string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
         count(*) FILTER (WHERE NOT is_whole) AS n_hits
  FROM u JOIN k ON u.digest = k.digest GROUP BY u.doc_id
)
SELECT w.doc_id, md5(w.form) AS text_digest, f.whole_license, coalesce(f.licenses, '') AS licenses,
       coalesce(f.n_hits, 0) AS n_hits
FROM w LEFT JOIN f ON w.doc_id = f.doc_id
"""


SQL_OP10 = oracle_sql()
