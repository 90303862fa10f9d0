"""Licence lookup by canonical digest, in DataFrame operations alone.

Whole texts are brought to a canonical form - lower case, no copyright lines, equivalent spellings made one, words alone
without punctuation - and the SHA-256 of that form is joined with the digests of known licences.

Defined results: null texts and texts without a word have no digest and no licence; a digest of several known names gives
the smallest; repeated rows are kept; other columns of the input stay away.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: More known digests than this are joined by shuffle.
BROADCAST_ROWS = 10_000

#: Lines that name a copyright holder, or reserve rights, at the start of a line after comment signs.
COPYRIGHT_LINE = r"(?m)^[^\pL\pN(©\n]*(?:(?:copyright|\(c\)|©)\s*(?:\(c\)|©|[0-9<{\[])[^\n]*|all rights reserved[^\pL\pN\n]*)$"

#: Spellings that licence matching guidelines hold to be the same.
SAME = [
    ("acknowledgment", "acknowledgement"), ("analog", "analogue"), ("analyze", "analyse"), ("artifact", "artefact"), ("authorization", "authorisation"),
    ("authorized", "authorised"), ("caliber", "calibre"), ("canceled", "cancelled"), ("capitalizations", "capitalisations"), ("catalog", "catalogue"),
    ("categorize", "categorise"), ("center", "centre"), ("copyright owner", "copyright holder"), ("emphasized", "emphasised"), ("favor", "favour"),
    ("favorite", "favourite"), ("fulfill", "fulfil"), ("fulfillment", "fulfilment"), ("https", "http"), ("initialize", "initialise"), ("judgment", "judgement"),
    ("labeling", "labelling"), ("labor", "labour"), ("license", "licence"), ("licensed", "licenced"), ("licenses", "licences"), ("licensee", "licencee"),
    ("maximize", "maximise"), ("modeled", "modelled"), ("modeling", "modelling"), ("noncommercial", "non commercial"), ("offense", "offence"),
    ("optimize", "optimise"), ("organization", "organisation"), ("organize", "organise"), ("per cent", "percent"), ("practice", "practise"), ("program", "programme"),
    ("realize", "realise"), ("recognize", "recognise"), ("signaling", "signalling"), ("sub licence", "sublicence"), ("sublicense", "sublicence"),
    ("utilization", "utilisation"), ("while", "whilst"), ("wilfull", "wilful"), ("copyright c", "copyright"),
]

#: The texts of short licences, after their copyright lines.
KNOWN = {
    "MIT": "MIT License\n\nCopyright (c) <year> <holder>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "ISC License\n\nCopyright (c) <year> <holder>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Copyright (c) <year>, <holder>\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}


#: Title lines under which the short texts are found, besides none.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License"], "Zlib": ["zlib License", "The zlib License"],
}
#: Whole texts, a file each.
TEXTS = Path(__file__).with_name("licence_texts")
UNTITLED = frozenset(["Unlicense"])
LAST_TERM = "END OF TERMS AND CONDITIONS"
THIRD_CLAUSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"


def variants() -> list[tuple[str, str]]:
    """Every known text with its licence: the fixed ones and the whole texts, with titles and without, with the appendix and without."""
    short = KNOWN | {"BSD-3-Clause": KNOWN["BSD-2-Clause"].replace("THIS SOFTWARE IS", THIRD_CLAUSE + "THIS SOFTWARE IS", 1)}
    out = list(short.items())
    for name, titles in TITLES.items():
        body = short[name].removeprefix(f"{titles[0]}\n\n")
        out += [(name, body), *((name, f"{t}\n\n{body}") for t in titles)]
    for file in sorted(TEXTS.glob("*.txt")):
        whole, name = file.read_text("utf-8").strip(), file.name.removesuffix(".txt")
        for text in {whole, whole.split(LAST_TERM)[0] + LAST_TERM if LAST_TERM in whole else whole}:
            out.append((name, text))
            if name not in UNTITLED:
                out.append((name, text.split("\n\n", 1)[1]))
    return sorted(set(out))


def canonical(text: Column) -> Column:
    """The canonical form: words with single spaces between them."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    # two spaces between words, so that each spelling is replaced wherever it stands as whole words
    out = F.concat(F.lit(" "), F.regexp_replace(kept, r"[^\pL\pN]+", "  "), F.lit(" "))
    for a, b in SAME:
        out = F.replace(out, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def known_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(variants(), "license_id string, license_text string")


def lookup(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, n_words (of the canonical form), digest, license_id and is_license of every row of ``docs`` (doc_id, text)."""
    form = canonical(F.col("text"))
    has = F.col("form") != ""
    words = F.when(has, F.length("form") - F.length(F.replace("form", F.lit(" "), F.lit(""))) + 1).otherwise(0)
    seen = docs.select("doc_id", form.alias("form")).select("doc_id", words.cast("bigint").alias("n_words"), F.when(has, F.sha2("form", 256)).alias("digest"))
    digests = known.select("license_id", canonical(F.col("license_text")).alias("form")).where(has).groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = seen.join(F.broadcast(digests) if small else digests, "digest", "left")
    return joined.select("doc_id", "n_words", "digest", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def sql() -> str:
    """The same lookup in SQL, with the known texts as values."""

    def form(text: str) -> str:
        out = f"regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', '', 'g')"
        out = f"' ' || regexp_replace({out}, '[^\\pL\\pN]+', '  ', 'g') || ' '"
        for a, b in SAME:
            a, b = (x.replace(" ", "  ") for x in (a, b))
            out = f"replace({out}, ' {a} ', ' {b} ')"
        return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in KNOWN.items())
    return f"""
WITH known(license_id, license_text) AS (VALUES {values}),
forms AS (SELECT license_id, {form("license_text")} AS form FROM known),
digests AS (SELECT sha256(form) AS digest, min(license_id) AS license_id FROM forms WHERE form <> '' GROUP BY 1),
seen AS (SELECT doc_id, {form("text")} AS form FROM documents)
SELECT doc_id, CASE WHEN form = '' THEN 0 ELSE length(form) - length(replace(form, ' ', '')) + 1 END::BIGINT AS n_words,
  CASE WHEN form <> '' THEN sha256(form) END AS digest, license_id, license_id IS NOT NULL AS is_license
FROM seen LEFT JOIN digests ON form <> '' AND sha256(form) = digests.digest
"""
