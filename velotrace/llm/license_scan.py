"""Licence scan by canonical digest lookup.

A text is brought to canonical form: lower case, punctuation and white space
reduced to single blanks, copyright lines dropped, equivalent spellings made
equal; its SHA-256 digest is then hash-joined to the digests of the known
licences, so a whole text is a licence or it is not. Each line of a text is
also a text of its own for the one-line notices, by the same canonical form.

The table of known digests is built from ``KNOWN`` and ``BODIES``, or from a
list or table of ``license_id, text``; a text of several lines is also known
under the ``TITLES`` of its licence. Its size is checked against
``BROADCAST_ROWS`` and it is broadcast only below that, else joined by shuffle.

Defined results: a null text is an empty one; an empty canonical form is no
licence; repeated rows get equal results; two known texts with one canonical
form report the alphabetically first name. Empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted

_WORDS = re.compile(r"[^\W_]+")
#: A statement: (c) with a year or "copyright", or "copyright" before a mark, a year or a holder. Wrapped prose goes on with
#: "copyright notice", "copyright holders" and the like, and "(c)" alone numbers a clause.
_PROSE = (
    "notices?|holders?|owners?|ownership|laws?|licen[cs]es?|licen[cs]ed|statements?|interests?|permissions?|disclaimers?|protection|infringements?|"
    "treat(?:y|ies)|status|claims?|rights?|terms?|grants?|information|restrictions?|and|or|in|is|as|on|to|of|for|with|which|that|if|are|may|shall|can|under|at|where|doctrines?|resulting|the (?:library|software|program|work)"
)
_COPYRIGHT = re.compile(
    r"^\W*(?:\(c\)\W*(?:copyright\b|\d{4})|©|all rights reserved\W*$|copyright\b(?:\W*(?:\(c\)|©|\d{4})|\s*[<\[{]|"
    rf"(?!-)(?=[^\w.,;:)\"'”’]*[^\W_])(?!\W*(?:{_PROSE})\b)))",
    re.IGNORECASE,
)
#: Equivalent spellings -> the canonical one.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sublicence": "sublicense",
    "authorisation": "authorization", "authorised": "authorized", "organisation": "organization", "organisations": "organizations",
    "favour": "favor", "honour": "honor", "behaviour": "behavior", "centre": "center", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "merchantibility": "merchantability", "modelled": "modeled", "programme": "program", "recognised": "recognized",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful", "analogue": "analog", "catalogue": "catalog",
    "judgement": "judgment", "initialise": "initialize", "labelling": "labeling", "acknowledgement": "acknowledgment",
    "v2": "2", "v3": "3", "https": "http",
}
BROADCAST_ROWS = 10_000

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    "{}.\n"
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.\n"
    "{}"
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Known texts: (name, whole text or one-line notice).
KNOWN = [
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.\n" + _WARRANTY,
    ),
    ("ISC", _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")),
    ("0BSD", _ISC.format("")),
    ("BSD-2-Clause", _BSD.format("")),
    (
        "BSD-3-Clause",
        _BSD.format(
            "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
            "products derived from this software without specific prior written permission.\n"
        ),
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\n"
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
        "language governing permissions and limitations under the License.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "MPL-2.0")),
]

#: BSD clauses are also set as bullets.
KNOWN += [(name, re.sub(r"(?m)^\d\. ", "* ", text)) for name, text in KNOWN if name in ("BSD-2-Clause", "BSD-3-Clause") and "\n" in text]
#: Title lines that may stand above a whole text.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "MIT"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD 0-Clause License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "BSD License"),
}
#: Digests of texts too long to be kept here, with and without their appendix.
BODIES = [
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Apache-2.0", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Apache-2.0", "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GFDL-1.3", "ccfa2750c2a3b9dae93f959cfa64078cc3a306c4a4cd4cfaf18365396202da90"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-1.1", "80cd52a1836f5ea3706bd2afa402fc448999d4a22581ee62d4041bd8a08efd87"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("MPL-2.0", "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de"),
]


def canonical(text: str | None) -> str:
    """Canonical form of a whole text."""
    lines = (text or "").lower().splitlines()
    words = (w for line in lines if not _COPYRIGHT.match(line) for w in _WORDS.findall(line))
    return " ".join([SPELLINGS.get(w, w) for w in words])


def digest(text: str | None) -> str | None:
    form = canonical(text)
    return hashlib.sha256(form.encode("utf-8", "surrogatepass")).hexdigest() if form else None


def _forms(name: str, text: str | None) -> list[tuple[str, str, int | None]]:
    """``digest, license_id, line_chars`` of a known text and of it under its titles; the length is that of a one-line notice."""
    form = canonical(text)
    if not form:
        return []
    if "\n" not in text:
        return [(digest(text), name, len(form))]
    return [(digest(t), name, None) for t in (text, *(f"{title}\n{text}" for title in TITLES.get(name, ())))]


def _known_forms(spark: SparkSession, known: list[tuple[str, str]] | DataFrame | None) -> DataFrame:
    kind = "digest string, license_id string, line_chars int"
    if isinstance(known, DataFrame):

        def made(parts):
            for part in parts:
                rows = [r for name, text in zip(part["license_id"], part["text"], strict=True) for r in _forms(name, text)]
                out = pd.DataFrame(rows, columns=["digest", "license_id", "line_chars"])
                yield out.astype({"line_chars": "Int32"})

        return known.select("license_id", "text").mapInPandas(made, kind)
    rows = {r for name, text in (KNOWN if known is None else known) for r in _forms(name, text)}
    rows |= {(d, name, None) for name, d in BODIES} if known is None else set()
    return spark.createDataFrame(sorted(rows, key=str), kind)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """``digest, license_id``: one row per canonical form of the known texts (a list of pairs or a table ``license_id, text``)."""
    return _known_forms(spark, known).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def _digests(text, low: int, high: int):
    """Digest of a whole text, and of its lines whose canonical length lies between two bounds."""

    @F.pandas_udf("digest string, lines array<string>")
    def digests(texts: pd.Series) -> pd.DataFrame:
        whole, lines = [], []
        for one in texts:
            forms = [canonical(line) for line in one.splitlines()]
            joined = " ".join([f for f in forms if f])
            whole.append(hashlib.sha256(joined.encode("utf-8", "surrogatepass")).hexdigest() if joined else None)
            lines.append([hashlib.sha256(f.encode("utf-8", "surrogatepass")).hexdigest() for f in forms if low <= len(f) <= high])
        return pd.DataFrame({"digest": whole, "lines": lines})

    return digests(text)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """``id_col, digest, license_id, notices`` of every row.

    ``license_id`` names the licence that the whole text is (else null),
    ``notices`` the licences (sorted, each once) that single lines of it name.
    """
    sizes = _known_forms(docs.sparkSession, known).agg(F.min("line_chars").alias("low"), F.max("line_chars").alias("high"), F.count("*").alias("n")).first()
    names = known_digests(docs.sparkSession, known)
    if sizes["n"] <= BROADCAST_ROWS:
        names = F.broadcast(names)
    read = docs.select(
        quoted(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), _digests(F.coalesce(quoted(text_col), F.lit("")), sizes["low"] or 1, sizes["high"] or 0).alias("d")
    ).select("id", "row", "d.*")
    # nearly all texts have a digest that no licence has: rows with hits only are grouped
    wholes = read.join(names, "digest", "left")
    marked = wholes.withColumn("line", F.explode_outer(F.array_distinct("lines"))).join(
        names.select(F.col("digest").alias("line"), F.col("license_id").alias("notice")), "line", "left"
    )
    told = marked.groupBy("row", "id", "digest", "license_id").agg(F.array_sort(F.collect_set("notice")).alias("notices"))
    return told.select(F.col("id").alias(id_col), "digest", "license_id", "notices")
