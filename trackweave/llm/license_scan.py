"""Operator 4: licence scan by canonical digests.

A text is brought to a canonical form - lower case, licence spellings made alike, copyright notices and titles dropped,
punctuation and white space made single spaces - and its digest is looked up, by hash join, among the digests of known
licence texts. Entire documents are looked up, each of their lines, as notices stand on lines of their own, and, as licences
stand in longer documents, each passage that begins like a known text and is as long; all by the digest of the entire text.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as equal; what they differ in, outside the groups, is left out.
SPELLINGS = (
    r"(licen)[cs](?=e|ing)|(organi)[sz](?=ation)|(favo)u?(?=r)|(fulfil)l?|\b(non|per)[ \n]+(?=commercial|cent)"
    r"|(copyright[ \n]+)(?:holder|owner)|\b(http)s\b"
)
#: What follows "copyright" or "(c)" in licence prose, or as the licence's own notice and form; anything
#: else, on the same line, is the notice of a work. Text of KNOWN, however wrapped, is held to it in the tests.
PROSE = (
    r"(?:holder|owner|notice|licen[cs]e|law|statement|disclaimer|interest|permission|protection|treat(?:y|ie))s?\b"
    r"|(?:and|or|on|in|of|to|is|are|if|as|for|from|under|with|that|this|then|which|may|must|shall|also|like|those|line|patent|you|affirmer|year|yyyy|name of)\b"
    r"|the (?:software|library|program|work)\b|similar rights\b|2007 free software foundation, inc\. <http"
)
#: A line with a notice, or with the reservation of rights alone, after comment marks if there are any.
NOTICE = (
    r"(?m)^[^\p{L}\p{N}\n(]*(?:"
    r"(?:copyright|\(c\))(?![.;]|--)(?:[^\p{L}\p{N}\n(]++|\(c\)|\((?!c\))|copyright\b|by\b)*+"
    r"(?<![\p{L}\p{N}])(?!" + PROSE + r")[\p{L}\p{N}][^\n]*"
    r"|all rights reserved[^\p{L}\p{N}\n]*$)\n?"
)
#: Titles, in canonical form, before the first words of texts that have none of their own.
TITLE = (
    r"^ ?(?:the )?(?:mit|isc|expat|unlicene|(?:new |modified |revised )?bsd)(?: 3 clause)?(?: new or revised)?(?: licene)?"
    r"(?: mit| isc| expat| bsd 3 clause)? (?=permission |redistribution |this is free )"
)


def entire(name: str) -> str:
    """A licence text of this package, whole."""
    return (resources.files(__package__) / "licenses" / f"{name}.txt").read_text(encoding="utf-8")


def _without(text: str, start: str) -> str:
    """text without the lines that start so."""
    return "\n".join(x for x in text.split("\n") if not x.strip().startswith(start))


_APACHE, _BSD, _END = entire("Apache-2.0"), entire("BSD-3-Clause"), "END OF TERMS AND CONDITIONS"
#: Public licence notices and texts, by identifier.
KNOWN = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "ISC": [
        "SPDX-License-Identifier: ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
        # As published, with the form filled in (a notice of the work), and without the appendix.
        _APACHE,
        _without(_APACHE, "Copyright [yyyy]"),
        _APACHE.split(_END)[0],
        _APACHE.split(_END)[0] + _END,
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        entire("GPL-3.0"),
        entire("GPL-3.0").split("How to Apply These Terms")[0],
        entire("GPL-3.0").split(_END)[0] + _END,
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", entire("CC-BY-SA-4.0")],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", entire("CC0-1.0")],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        _BSD,
        # Its conditions are numbered as often as not.
        _BSD.replace("* Redis", "1. Redis", 1).replace("* Redis", "2. Redis", 1).replace("* Neither", "3. Neither"),
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
        entire("Unlicense"),
        _without(entire("Unlicense"), "For more information"),
    ],
}


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line ends kept."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(F.regexp_replace(out, r"©|&copy;", "(c)"), NOTICE, "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    return F.regexp_replace(out, SPELLINGS, "$1$2$3$4$5$6$7")


def in_one_line(lines: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(lines, r"[ \n]+", " "), TITLE, ""))


def canonical(text: Column) -> Column:
    """The canonical form. Without its copyright notices a text may be empty."""
    return in_one_line(canonical_lines(text))


#: Words by which the beginning of a known text is found in a document; shorter texts are looked for as lines only.
BEGINNING = 8


def passages(form: Column, beginnings: dict[str, list[int]]) -> Column:
    """The passages of a canonical form that begin with one of beginnings and are as long as one of its known texts."""
    prefixed = lambda beginning: lambda x: F.concat(F.lit(f"{beginning} "), x, F.lit(" "))
    as_long = lambda n: lambda x: F.substring(x, 1, n + 1)
    found = []
    for beginning, lengths in sorted(beginnings.items()):
        after = F.split(F.concat(F.lit(" "), form, F.lit(" ")), f" {beginning} ")
        starts = F.transform(F.slice(after, 2, F.greatest(F.size(after) - 1, F.lit(0))), prefixed(beginning))
        cut = [F.transform(starts, as_long(n)) for n in lengths]
        whole = F.filter(F.concat(*cut), lambda x: F.substring(x, -1, 1) == " ")
        none = F.array().cast("array<string>")
        found.append(F.when(F.contains(form, F.lit(beginning)), F.transform(whole, lambda x: F.rtrim(x))).otherwise(none))
    return F.concat(*found) if found else F.array().cast("array<string>")


def known_digests(spark: SparkSession, known: dict[str, list[str]] = KNOWN) -> DataFrame:
    """(digest, license_id, length of the canonical form, how it begins if it is long), a row a digest: as many as there are
    known texts at most."""
    rows = [(name, text) for name, texts in known.items() for text in texts]
    texts = spark.createDataFrame(rows, "license_id string, text string")
    forms = texts.select("license_id", canonical(F.col("text")).alias("form"))
    begins = F.when(F.size(F.split("form", " ")) >= 4 * BEGINNING, F.substring_index("form", " ", BEGINNING))
    return forms.groupBy(F.sha2("form", 256).alias("digest"), F.length("form").alias("length"), begins.alias("begins")).agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, known: dict[str, list[str]] = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: id, text_digest, text_license, line_licenses, n_license_lines, part_licenses.

    text_license is the licence that the entire text is, else null; line_licenses lists, sorted and once each, those whose
    notice is an entire line, and part_licenses those that stand entire anywhere in the text. A null text is empty; a text
    without letters or digits is no licence. Texts count whole, however long. Equal texts and repeated rows give equal
    results, null ids stay, other columns of docs play no part, and an empty table gives an empty result. The known texts
    are a parameter, so the table that is broadcast is as large as that.
    """
    spark = docs.sparkSession
    known_rows = known_digests(spark, known).collect()
    table = F.broadcast(spark.createDataFrame([(r["digest"], r["license_id"]) for r in known_rows], "digest string, license_id string"))
    # Only lines whose canonical form is as long as that of a known text get a digest.
    lengths = sorted({r["length"] for r in known_rows})
    beginnings: dict[str, set[int]] = {}
    for r in known_rows:
        if r["begins"]:
            beginnings.setdefault(r["begins"], set()).add(r["length"])
    # Rows are told apart by a number, as ids may be null or repeated.
    base = docs.select(F.col(id_col).alias("id"), canonical_lines(F.col(text_col)).alias("_lines"), F.monotonically_increasing_id().alias("row"))
    form = in_one_line(F.col("_lines"))
    lines = F.filter(F.transform(F.split("_lines", "\n"), lambda x: F.trim(x)), lambda x: F.length(x).isin(lengths))
    digest = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), F.sha2(x, 256).alias("digest"))
    pieces = F.concat(
        F.array(digest("text")(F.col("_form"))), F.transform(lines, digest("line")), F.transform(passages(F.col("_form"), {b: sorted(n) for b, n in beginnings.items()}), digest("part"))
    )
    base = base.withColumn("_form", form).select("id", "row", F.explode(pieces).alias("piece"))
    hits = base.select("id", "row", "piece.kind", "piece.digest").join(table, "digest", "left")
    names = lambda kind: F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("kind") == kind, F.col("license_id")))))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    hits = hits.where("kind = 'text' or license_id is not null")
    return hits.groupBy("row", "id").agg(
        of("text", "digest").alias("text_digest"), of("text", "license_id").alias("text_license"), names("line").alias("line_licenses"),
        F.count(F.when(F.col("kind") == "line", 1)).alias("n_license_lines"), names("part").alias("part_licenses"),
    ).select(F.col("id").alias(id_col), "text_digest", "text_license", "line_licenses", "n_license_lines", "part_licenses")
