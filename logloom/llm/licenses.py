"""License scans [native]: canonical digest lookup.

A text is normalised (case, punctuation, copyright lines, equivalent spellings, white space) and the
SHA-256 of the whole normalised text is hash-joined to the digests of known licences. The known table
is the constant below, so it is broadcast with a proven bound. The same digest is also looked up for
each single line that mentions a licence, which finds licence notices inside longer texts.

A whole text that this digest doesn't find is looked up once more without title lines and with a wider
notion of copyright lines, among full texts and standard headers (license_texts.py). canonical_sha256
and the SQL twin know the first lookup only.

Defined results: null and empty texts have the digest of the empty string and no licence. One row per
input row; other columns are ignored. Normalisation is per line and works on whole texts.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower
from .license_texts import TEXTS

#: Known licence texts and one-line notices (licence, text).
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
)

#: Equivalent spellings, as whole words of normalised text.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("noncommercial", "non commercial"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("whilst", "while"),
    ("https", "http"),
)
#: A line that starts so, once normalised, is a copyright line.
COPYRIGHT = r"^(c |copr |copyright )?(c |copyright )?(\(c\) )?(c|copr|copyright)( [0-9]{4}| c [0-9]{4}| by | the | holder|$)|^all rights reserved$"
#: Fixed value: lines that don't count when a whole text is looked up as `bare`: copyright lines with or without a year
#: (sign, year or "by" must follow, as wrapped lines of a licence may start with the word), and titles of short licences.
OUTSIDE = (
    r"^(portions )?(copyright|copr)( c| ©)+( |$)|^(portions )?(copyright|copr) ([0-9]{4}|yyyy|year|by|the)( |$)|^(c|©) ?[0-9]{4}|^©|^all rights reserved$"
    r"|^(the )?(mit|expat|isc|((new|modified|revised|simplified) )?bsd( [23] clause)?( (or|new|modified|revised|simplified))*) license( (mit|expat|isc|bsd( [23] clause)?))?$"
)
#: Digests of whole long licences, `bare`, as in Debian's common-licenses; Apache-2.0 also without its appendix.
WHOLE = {
    "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a": "Apache-2.0",
    "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0": "Apache-2.0",
    "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2": "Apache-2.0",
    "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6": "GPL-2.0",
    "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a": "GPL-3.0",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a": "MPL-2.0",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
}
MENTION = r"[Ll][Ii][Cc][Ee][Nn][CcSs][Ee]|[Cc][Cc][ -]?([Bb][Yy]|0)|[Pp]ermission"


def canonical_line(line: Column) -> Column:
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(line), r"[^0-9a-z\x{80}-\x{10ffff}]+", " ")), F.lit(" "))
    for spelling, usual in SPELLINGS:
        out = F.replace(out, F.lit(f" {spelling} "), F.lit(f" {usual} "))
    return F.trim(out)


def canonical_text(lines: Column, outside: str = COPYRIGHT) -> Column:
    """Of an array of normalised lines: without copyright and blank lines, joined by one space."""
    kept = F.filter(lines, lambda x: (x != "") & ~F.regexp_like(x, F.lit(outside)))
    return F.array_join(kept, " ")


def canonical(text: str, outside: str = COPYRIGHT) -> str:
    """The same for one string, for the table of known licences."""
    kept = []
    for line in text.split("\n"):
        out = " " + re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", line.translate(str.maketrans(UPPER, LOWER))).strip(" ") + " "
        for spelling, usual in SPELLINGS:
            out = out.replace(f" {spelling} ", f" {usual} ")
        out = out.strip(" ")
        if out and not re.search(outside, out):
            kept.append(out)
    return " ".join(kept)


def known_digests(known=KNOWN) -> dict[str, str]:
    return {hashlib.sha256(canonical(text).encode()).hexdigest(): name for name, text in reversed(known)}


def bare_digests(known=KNOWN) -> dict[str, str]:
    """Licences by the digest of their text without OUTSIDE lines."""
    texts = {hashlib.sha256(canonical(text, OUTSIDE).encode()).hexdigest(): name for name, text in reversed((*known, *TEXTS))}
    return WHOLE | texts


def scan_licenses(docs: DataFrame, known=KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, canonical_sha256, license (of the whole text, else null), notices (licences of single lines, sorted, comma-joined), n_notices."""
    digests = known_digests(known)
    spark: SparkSession = docs.sparkSession
    table = spark.createDataFrame(sorted(digests.items()), "canonical_sha256 string, license string")
    lookup = F.create_map(*[F.lit(x) for pair in sorted(digests.items()) for x in pair])
    df = docs.select(F.col(id_col), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("_lines"))
    bare = F.create_map(*[F.lit(x) for pair in sorted(bare_digests(known).items()) for x in pair])
    mentions = F.filter("_lines", lambda x: F.regexp_like(x, F.lit(MENTION)))
    df = df.select(id_col, F.transform("_lines", canonical_line).alias("_canon"), F.transform(mentions, lambda x: F.sha2(canonical_line(x), 256)).alias("_marks"))
    df = df.select(id_col, F.sha2(canonical_text(F.col("_canon")), 256).alias("canonical_sha256"), F.sha2(canonical_text(F.col("_canon"), OUTSIDE), 256).alias("_bare"), "_marks")
    found = F.filter(F.transform("_marks", lambda x: F.try_element_at(lookup, x)), lambda x: x.isNotNull())
    df = df.select(id_col, "canonical_sha256", F.try_element_at(bare, F.col("_bare")).alias("_named"), found.alias("_found"))
    return df.join(F.broadcast(table), "canonical_sha256", "left").select(
        id_col, "canonical_sha256", F.coalesce("license", "_named").alias("license"),
        F.array_join(F.array_sort(F.array_distinct("_found")), ",").alias("notices"),
        F.size("_found").cast("long").alias("n_notices"),
    )


def oracle(known=KNOWN) -> str:
    """The same in DuckDB, over every line of every text."""
    line = "concat(' ', trim(regexp_replace(translate(x, '%s', '%s'), '[^0-9a-z\\x{80}-\\x{10ffff}]+', ' ', 'g'), ' '), ' ')" % (UPPER, LOWER)
    for spelling, usual in SPELLINGS:
        line = f"replace({line}, ' {spelling} ', ' {usual} ')"
    line = f"trim({line}, ' ')"
    rows = ", ".join(f"('{d}', '{n}')" for d, n in sorted(known_digests(known).items()))
    return f"""
with known(d, license) as (values {rows}),
docs as (select doc_id, row_number() over () as r, string_split(coalesce(text, ''), chr(10)) as raw from documents),
lines as (select doc_id, r, unnest(raw) as x, generate_subscripts(raw, 1) as i from docs),
canon as (select doc_id, r, i, x, {line} as c from lines),
whole as (select doc_id, r, sha256(coalesce(string_agg(c, ' ' order by i) filter (where c <> '' and not regexp_matches(c, '{COPYRIGHT}')), '')) as canonical_sha256 from canon group by doc_id, r),
marks as (select c.r, k.license from canon c join known k on sha256(c.c) = k.d where regexp_matches(c.x, '{MENTION}')),
told as (select r, string_agg(distinct license, ',' order by license) as notices, count(*) as n from marks group by r)
select w.doc_id, w.canonical_sha256, k.license, coalesce(t.notices, '') as notices, coalesce(t.n, 0) as n_notices
from whole w left join known k on w.canonical_sha256 = k.d left join told t on t.r = w.r"""
