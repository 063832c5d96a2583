"""License scans by canonical digest.

A text is brought to a canonical form (case, punctuation, copyright lines and equivalent spellings are
evened out), and the SHA-256 of the whole form is looked up among the digests of known licences with a
hash join. The canonical lines of a text are looked up in the same way among known one-line notices.

A text that isn't known as it stands is looked up once more without its head, which is the titles and
copyright lines, with a year or not, that its canonical lines begin with, however many; and in that form a holder named in a
BSD licence's clauses is any holder. The full texts of more licences are in the folder ``licenses``, by their name; they are known
without their head, and Apache's and the GNU licences also without what follows the terms. They come from Debian's common licences,
the npm packages path-scurry (Blue Oak) and tslib (0BSD) and the crates globset (Unlicense) and xxhash-rust (BSL).

The known table is made from the texts given, so its size is that of a parameter, a few dozen rows. A
caller's own table is broadcast up to ``FEW`` rows, and joined by Spark's choice beyond. Texts are read and
brought to their canonical form once; no text leaves the scan but as a digest. Lines are looked up in the
same projection among up to ``FEW_NOTICES`` notices, and by a join beyond.

Defined cases: a null or empty text matches nothing; rows that repeat a doc_id share the notices found
in any of them; a doc_id of null is one document; texts are digested whole, however long; extra columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored

#: Rows of a known table that are broadcast, and notices that are part of the projection.
FEW, FEW_NOTICES = 100_000, 1000

#: (pattern, replacement), applied in this order to lower-cased text; RE2 and Java read them alike.
SPELLINGS = (
    (r"©|\(c\)", "copyright"),
    (r"licence", "license"),
    (r"sub-licens", "sublicens"),
    (r"non-commercial", "noncommercial"),
    (r"copyright holders", "copyright owners"),
    (r"https?://", ""),
    (r"whilst", "while"),
    (r"per cent", "percent"),
)
#: All but letters, digits and line ends become one blank.
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F‘’“”–—•·\x{A0}]+"
#: A canonical line that only says who holds the rights.
COPYRIGHT_LINE = r"^(copyright\b.*[0-9]{4}.*|all rights reserved)$"

#: Canonical lines that may stand before a licence's text; so many are looked at first, then all.
FIRST_LINES = 12
HEAD = (
    r"^(copyright\b.*|all rights reserved|creative commons legal code|cc0 1 0 universal|version [0-9]( [0-9])?( [0-9]* ?[a-z]+ [0-9]{4})?|www apache org licenses"
    r"|(the |a )?(mit|expat|x11|isc|zlib|libpng|([a-z0-9]+ ){0,4}bsd|apache|artistic|mozilla public|gnu (lesser general|library general|general) public|gnu free documentation)"
    r"( [a-z0-9]+){0,4} license( [a-z0-9]+){0,6}"
    r"|boost software license version 1 0.*|blue oak model license)$"
)
#: Where a text without its head names a holder, as (pattern, replacement).
HOLDERS = (
    (r"neither the names? of [a-z0-9 ]{1,300}? nor the names of (its|their|any|other) contributors", "neither the name of the owner nor the names of its contributors"),
    (r"this software is provided by [a-z0-9 ]{1,300}? as is", "this software is provided by the owner as is"),
    (r"in no event shall [a-z0-9 ]{1,300}? be liable for any direct", "in no event shall the owner be liable for any direct"),
)
FOLDER = Path(__file__).parent / "licenses"
#: Where the terms end, and the line of Apache's appendix that users fill in.
TERMS_END, TO_FILL_IN = "END OF TERMS AND CONDITIONS", "Copyright [yyyy] [name of copyright owner]"

#: Known licences by whole text, and notices of one line. Fixed values.
LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License 2.0."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL v3."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."),
}


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text: none of them empty, and none a mere copyright line."""
    even = F.lower(text)
    for pattern, to in SPELLINGS:
        even = F.regexp_replace(even, pattern, to)
    even = F.regexp_replace(even, PUNCTUATION, " ")
    return F.filter(F.transform(F.split(even, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(COPYRIGHT_LINE))


def without_head(lines: Column) -> Column:
    """The lines from the first one that is neither a title nor a copyright line; all of them if there is none."""

    def first(some: Column) -> Column:
        return F.array_position(F.transform(some, lambda x: ~x.rlike(HEAD)), F.lit(True)).cast("int")

    def from_body(at: Column) -> Column:
        # Only a text of nothing but head in its first lines is searched whole.
        found = F.when((at == 0) & (F.size(lines) > FIRST_LINES), first(lines)).otherwise(at)
        return let(found, lambda k: F.when(k > 1, F.slice(lines, k, F.greatest(F.size(lines), F.lit(1)))).otherwise(lines))

    return let(first(F.slice(lines, 1, FIRST_LINES)), from_body)


def body_text(lines: Column) -> Column:
    """The text of the lines without their head, and with any holder."""
    text = F.array_join(without_head(lines), " ")
    for pattern, to in HOLDERS:
        text = F.regexp_replace(text, pattern, to)
    return text


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the files, in the forms in which they are passed on; a file is named LICENCE.txt or LICENCE.VARIANT.txt."""
    made = []
    for file in sorted(FOLDER.glob("*.txt")):
        name, text = file.stem.removesuffix(".regents"), file.read_text("utf-8")
        forms = {text, text.replace(TO_FILL_IN, "")}
        if TERMS_END in text:
            upto = text[: text.index(TERMS_END)]
            forms |= {upto, upto + TERMS_END}
        made += [(name, form) for form in sorted(forms)]
    return made


def known(spark, licenses: dict[str, str] | None = None, notices: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(kind, digest, license) of the known texts; one licence per digest. The kind 'body' is of texts without their head."""
    rows = [(kind, k, t) for k, t in (LICENSES if licenses is None else licenses).items() for kind in ("text", "body")]
    rows += [("body", k, t) for k, t in full_texts()] if licenses is None else []
    rows += [("notice", k, t) for k, ts in (NOTICES if notices is None else notices).items() for t in ts]
    texts = spark.createDataFrame(rows, "kind string, license string, text string")
    form = let(canonical_lines(F.col("text")), lambda x: F.when(F.col("kind") == "body", body_text(x)).otherwise(F.array_join(x, " ")))
    made = texts.select("kind", "license", F.sha2(form, 256).alias("digest"))
    return made.groupBy("kind", "digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, table: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, license, notices) for each row: the licence that the whole text is, or null, and an
    ascending array of the licences whose notices are lines of the document."""
    if table is None:
        table = stored(known(docs.sparkSession), "licenses")
    held = table.where("kind = 'notice'").select("digest", "license").limit(FEW_NOTICES + 1).collect()
    table = F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table
    within = len(held) <= FEW_NOTICES
    names = F.create_map(*(F.lit(x) for r in held for x in r)) if held and within else F.expr("map('', '')")

    def digests(lines: Column) -> Column:
        each = F.transform(lines, lambda x: F.sha2(x, 256))
        notices = F.filter(F.transform(each, lambda x: F.element_at(names, x)), lambda x: x.isNotNull())
        return F.struct(
            F.sha2(F.array_join(lines, " "), 256).alias("whole"),
            F.sha2(body_text(lines), 256).alias("body"),
            F.array_distinct(notices if within else each).alias("lines"),
        )

    made = stored(docs.select(docs[doc_id].alias("doc_id"), let(canonical_lines(F.coalesce(docs[text], F.lit(""))), digests).alias("d")), "license-digests")
    found = made.select(F.col("doc_id").alias("doc"), F.explode("d.lines").alias("notice"))
    if not within:
        notices = table.where("kind = 'notice'").select(F.col("digest").alias("line"), "license")
        found = found.join(notices, F.col("notice") == F.col("line")).select("doc", F.col("license").alias("notice"))
    found = found.groupBy("doc").agg(F.sort_array(F.collect_set("notice")).alias("notices"))
    whole = table.where("kind = 'text'").select(F.col("digest").alias("whole"), F.col("license").alias("as_whole"))
    body = table.where("kind = 'body'").select(F.col("digest").alias("known_body"), F.col("license").alias("as_body"))
    return (
        made.select("doc_id", F.col("d.whole").alias("digest"), F.col("d.body").alias("body"))
        .join(whole, F.col("digest") == F.col("whole"), "left")
        .join(body, F.col("body") == F.col("known_body"), "left")
        .join(found, F.col("doc_id").eqNullSafe(F.col("doc")), "left")
        .select("doc_id", "digest", F.coalesce("as_whole", "as_body").alias("license"), F.coalesce("notices", F.expr("cast(array() as array<string>)")).alias("notices"))
    )
