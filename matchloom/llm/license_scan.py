"""License scan by sentence rules, in DataFrame functions only.

A text is cut into sentences at line ends and after ``. ! ? ;`` before white space. Each
sentence is normalised (lower case, every run of other characters than a-z and 0-9 becomes
one blank) and looked up in the table of known licence sentences. The identifiers found
form a sequence per document, and a licence rule fits if its identifiers occur in that
sequence in its order, other identifiers between them allowed. A rule that names a stronger
licence hides the rules that it contains (``hides``).

Wrapped licence texts are read a second way, with single line ends taken as blanks, so that
a sentence over several lines is known too; a line of comment marks alone is a blank one, and a copyright notice, which
has a sign or a year, ends with its line. Line ends of all systems count, dnl and rem before a line don't. The
identifiers of both readings form one sequence in the order of their places (the number of characters
other than white space before them), an identifier once a place.

A sentence that the table lacks but that opens with an SPDX tag, or says that something is licensed, released or
distributed under something (``PREFIX``), is an expression: what follows is split at "or", "and" and "with", and each part
looked up in a table of licence names (``NAMED``). It stands for the identifiers of all known parts. An SPDX tag's line ends its sentence.

Only texts that hold one of ANCHORS go through this. An anchor has no blank in it and stands in one word
of each known sentence, so it stands unbroken in every text that has the sentence, however that is
spaced or wrapped: the gate only saves work. No row leaves its task: there is no shuffle.

Defined results: null and empty texts have no sentence and no licence; very long texts are read whole;
a null doc_id, copies, ties and repeated rows each give their own row; an empty table gives none;
other columns are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, id_and_text, scanned

#: Identifiers of known licence sentences, in normalised form.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-ref",
    "licensed under the apache license version 2 0 the license": "apache-ref",
    "you may not use this file except in compliance with the license": "apache-file",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache-limits",
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "mit license": "mit-title",
    "the mit license": "mit-title",
    "the mit license mit": "mit-title",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 3": "gpl3-ref",
    "this work is licensed under the gnu general public license version 2": "gpl2-ref",
    "licensed under the gnu general public license version 2": "gpl2-ref",
    "gnu general public license": "gpl-title",
    "version 3 29 june 2007": "gpl3-date",
    "version 2 june 1991": "gpl2-date",
    "licensed under the gnu lesser general public license version 3": "lgpl3-ref",
    "licensed under the gnu affero general public license version 3": "agpl3-ref",
    "licensed under cc by nc 4 0": "cc-by-nc-ref",
    "licensed under cc by 4 0": "cc-by-ref",
    "licensed under cc by sa 4 0": "cc-by-sa-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-ref",
    "licensed under the mozilla public license version 2 0": "mpl-ref",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd3-names",
    "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd3-names",
    "spdx license identifier mit": "mit-ref",
    "spdx license identifier apache 2 0": "apache-ref",
    "spdx license identifier gpl 3 0 only": "gpl3-ref",
    "spdx license identifier bsd 3 clause": "bsd3-ref",
    "all rights reserved": "all-rights",
    "apache license": "apache-title",
    "version 2 0 january 2004": "apache-date",
}
#: The GNU licences, whose notices differ by name and version alone.
GNU = {"gnu general public license": "gpl", "gnu lesser general public license": "lgpl", "gnu library general public license": "lgpl", "gnu affero general public license": "agpl"}


def gnu_sentences() -> dict[str, str]:
    """The notices "you can redistribute it ...", with and without what stands before them, by name and version."""
    found = {}
    for name, short in GNU.items():
        terms = f"you can redistribute it and or modify it under the terms of the {name}"
        for version in ("2", "2 1", "3"):
            either = f"{terms} as published by the free software foundation either version {version} of the license or at your option any later version"
            only = f"{terms} version {version} as published by the free software foundation"
            for subject in ("", "this program is free software ", "this library is free software "):
                found |= {f"{subject}{notice}": f"{short}{version[0]}-ref" for notice in (either, only)}
    return found


#: SPDX identifiers and what they are called here; those of the GNU licences may end in "only" or "or later".
SPDX = {
    "MIT": "mit", "Apache-2.0": "apache", "GPL-3.0": "gpl3", "GPL-2.0": "gpl2", "LGPL-2.1": "lgpl2", "LGPL-3.0": "lgpl3", "AGPL-3.0": "agpl3", "BSD-3-Clause": "bsd3", "BSD-2-Clause": "bsd2", "MPL-2.0": "mpl",
    "ISC": "isc", "BSL-1.0": "boost", "Unlicense": "unlicense", "CC0-1.0": "cc0", "Zlib": "zlib", "0BSD": "bsd0", "EPL-2.0": "epl2", "CC-BY-4.0": "cc-by", "CC-BY-SA-4.0": "cc-by-sa", "CC-BY-NC-4.0": "cc-by-nc",
}


def spdx_sentences() -> dict[str, str]:
    found = {}
    for name, short in SPDX.items():
        plain = "spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower())
        found |= {f"{plain}{end}": f"{short}-ref" for end in (("", " only", " or later") if "GPL" in name else ("",))}
    return found


#: Further SPDX identifiers, each a licence of its own that only its name tells of.
MORE = [
    "AFL-3.0", "Apache-1.1", "Artistic-2.0", "BlueOak-1.0.0", "BSD-4-Clause", "CC-BY-3.0", "CC-BY-SA-3.0", "CDDL-1.0", "CECILL-2.1", "curl",
    "EPL-1.0", "EUPL-1.2", "LPPL-1.3c", "MIT-0", "MPL-1.1", "MS-PL", "MulanPSL-2.0", "NCSA", "ODbL-1.0", "OFL-1.1",
    "OpenSSL", "OSL-3.0", "PHP-3.01", "PostgreSQL", "PSF-2.0", "Python-2.0", "Ruby", "UPL-1.0", "Vim", "WTFPL", "X11",
]
#: What licences are called in sentences, without "the", "GNU" in front and "license" behind.
CALLED = {
    "apache": ["apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache license v2", "apache v2", "apache 2"],
    "mit": ["expat", "mit expat", "mit x11"],
    "bsd3": ["3 clause bsd", "bsd 3 clause", "new bsd", "modified bsd", "revised bsd"],
    "bsd2": ["2 clause bsd", "simplified bsd", "freebsd"],
    "mpl": ["mozilla public license version 2 0", "mozilla public license v2 0", "mozilla public license 2 0", "mozilla public license v 2 0", "mplv2"],
    "isc": ["internet systems consortium"],
    "boost": ["boost software license version 1 0", "boost software license 1 0", "boost software"],
    "cc0": ["cc0", "creative commons zero"],
    "epl2": ["eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license 2 0"],
    "cc-by": ["creative commons attribution 4 0 international", "creative commons attribution 4 0"],
    "cc-by-sa": ["creative commons attribution sharealike 4 0 international", "creative commons attribution sharealike 4 0"],
    "cc-by-nc": ["creative commons attribution noncommercial 4 0 international", "creative commons attribution noncommercial 4 0"],
}
#: The GNU licences' versions.
VERSIONS = {"gpl": ("2", "2 0", "3", "3 0"), "lgpl": ("2 1", "3", "3 0"), "agpl": ("3", "3 0")}


def plain(name: str) -> str:
    """A name in normalised form."""
    return re.sub("[^a-z0-9]+", " ", name.lower())


def license_names() -> dict[str, str]:
    """Identifiers by the names that an expression may hold."""
    found = {f"{plain(name)}{end}": f"{short}-ref" for name, short in SPDX.items() for end in (("", " only") if "GPL" in name else ("",))}
    found |= {plain(name): f"{plain(name).replace(' ', '-')}-ref" for name in MORE}
    found |= {called: f"{short}-ref" for short, names in CALLED.items() for called in names}
    for full, short in GNU.items():
        for v in VERSIONS[short]:
            forms = [f"{title}{sign}{v}" for title in (full.removeprefix("gnu "), short) for sign in (" ", " v", " version ")] + [f"{short}v{v}"]
            found |= dict.fromkeys(forms, f"{short}{v[0]}-ref")
    return found


SENTENCES |= gnu_sentences() | spdx_sentences()
NAMED = license_names()
TAG = "spdx license identifier "
#: What opens an expression, what it may say of later versions, between its parts, and around a name. No group repeats.
PREFIX = f"^(?:{TAG}|(?:(?:this|the|all) [a-z]+ (?:[a-z]+ )?(?:is|are) |it is )?(?:dual )?(?:licensed|released|distributed|published|available|made available) under )"
LATER = " or (?:at your option )?(?:any )?later(?: version)?"
BETWEEN = " (?:or|and|with) "
LEAD, TAIL = "^(?:either )?(?:of )?(?:the |an? )?(?:terms of )?(?:the |an? )?(?:gnu )?", "(?: the)? license$"
#: Parts of words, of which every known sentence and every expression holds at least one.
ANCHORS = ("licens", "permi", "copyright", "redistribution", "warranty", "reserved", "june", "january", "licenc", "released", "distributed", "published", "available")
#: Fixed values: (licence, identifiers in order, licences that it hides).
RULES = [
    ("Apache-2.0", ["apache-ref", "apache-file", "apache-copy", "apache-basis", "apache-limits"], ["Apache-2.0-reference"]),
    ("Apache-2.0", ["apache-title", "apache-date"], ["Apache-2.0-reference"]),
    ("Apache-2.0-reference", ["apache-ref"], []),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"], ["MIT-reference"]),
    ("MIT-reference", ["mit-ref"], []),
    ("MIT-reference", ["mit-title"], []),
    ("GPL-3.0", ["gpl-title", "gpl3-date"], ["GPL-3.0-reference"]),
    ("GPL-3.0-reference", ["gpl3-ref"], []),
    ("GPL-2.0", ["gpl-title", "gpl2-date"], ["GPL-2.0-reference"]),
    ("GPL-2.0-reference", ["gpl2-ref"], []),
    ("LGPL-2.1-reference", ["lgpl2-ref"], []),
    ("LGPL-3.0-reference", ["lgpl3-ref"], []),
    ("AGPL-3.0-reference", ["agpl3-ref"], []),
    ("AGPL-2.0-reference", ["agpl2-ref"], []),
    ("CC-BY-NC-4.0", ["cc-by-nc-ref"], []),
    ("CC-BY-4.0", ["cc-by-ref"], []),
    ("CC-BY-SA-4.0", ["cc-by-sa-ref"], []),
    ("BSD-3-Clause", ["bsd3-ref"], ["BSD-2-Clause"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd3-names"], ["BSD-2-Clause"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"], []),
    ("MPL-2.0", ["mpl-ref"], []),
    ("ISC", ["isc-grant"], []),
    ("ISC", ["isc-ref"], []),
    ("BSD-2-Clause", ["bsd2-ref"], []),
    ("BSL-1.0", ["boost-ref"], []),
    ("Unlicense", ["unlicense-ref"], []),
    ("CC0-1.0", ["cc0-ref"], []),
    ("Zlib", ["zlib-ref"], []),
    ("0BSD", ["bsd0-ref"], []),
    ("EPL-2.0", ["epl2-ref"], []),
    ("Proprietary", ["all-rights"], []),
    *[(name, [NAMED[plain(name)]], []) for name in MORE],
]
CUT = r"([.!?;])[ \t\r\n]+"
#: Line ends of other systems, comment words that open a line, and copyright notices, which end a sentence where they end a line.
RETURNS, WORDS = r"\r\n?", r"(?mid)^[ \t]*(?:dnl|rem)(?:[ \t]+|$)"
NOTICE = r"(?mid)^[ \t/*#;%!<>\"'-]*(?:copyright\b[^\n]*(?:\(c\)|©|\b(?:19|20)[0-9][0-9]\b)|\(c\)|©)[^\n]*$"
TAGGED = r"(?mid)^[^\n]*spdx-license-identifier[ \t]*:[^\n]*$"
MARKS = r"(?md)^[ \t]*[/*#;%!<>\"'-]+[ \t\r]*$"
#: Whoever is named counts as the copyright holder.
HOLDER = r"^neither the name of .+ nor the names of (?:its|the|their) contributors", "neither the name of the copyright holder nor the names of its contributors"


FOUND = "struct<at:int,id:string>"


def _identifiers(text: Column) -> Column:
    """(place, identifier) of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    pieces = F.split(F.regexp_replace(F.lower(text), CUT, "$1\n"), "\n")
    named = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    spelled = lambda s: F.replace(F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")), F.lit("licence"), F.lit("license"))
    normal = lambda s: F.regexp_replace(spelled(s), *map(F.lit, HOLDER))
    name = lambda part: F.regexp_replace(F.regexp_replace(part, LEAD, ""), TAIL, "")
    parts = lambda s: F.split(F.regexp_replace(F.regexp_replace(s, PREFIX, ""), LATER, ""), BETWEEN)
    joined = lambda s: F.array_join(F.transform(parts(s), lambda part: F.try_element_at(named, name(part))), ",")
    expressed = lambda s: F.when(s.rlike(PREFIX), F.nullif(joined(s), F.lit("")))
    known_as = lambda piece: bound(normal(piece), lambda s: F.coalesce(F.try_element_at(known, s), expressed(s)))
    move = lambda at, piece: at + F.char_length(F.regexp_replace(piece, r"\s+", ""))
    one = lambda at, piece: bound(known_as(piece), lambda i: F.when(i.isNotNull(), F.struct(at.alias("at"), i.alias("id"))))
    each = lambda x: F.transform(F.split(x["id"], ","), lambda i: F.struct(x["at"].alias("at"), i.alias("id")))
    return F.flatten(F.transform(scanned(pieces, F.lit(0), move, one, FOUND), each))


def scan_licenses(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids and licenses, comma-joined."""
    anchored = F.col("text").rlike("(?i)" + "|".join(ANCHORS))
    nothing = F.array().cast("array<string>")
    unmarked = F.col("text")
    for pattern, instead in ((RETURNS, "\n"), (WORDS, ""), (MARKS, ""), (NOTICE, "$0\n"), (TAGGED, "$0\n")):
        unmarked = F.regexp_replace(unmarked, pattern, instead)
    unwrapped = F.regexp_replace(unmarked, r"([^\n])\n([^\n])", "$1 $2")
    both = F.array_sort(F.array_distinct(F.concat(_identifiers(unmarked), _identifiers(unwrapped))))
    rows = (
        id_and_text(docs)
        .select("doc_id", F.when(anchored, F.transform(both, lambda x: x["id"])).otherwise(nothing).alias("ids"))
    )

    def in_order(ids: list[str]) -> Column:
        """Whether a rule's identifiers occur in their order: one pass that counts how many of them were met."""
        wanted = F.array(*map(F.lit, ids))
        return F.aggregate("ids", F.lit(0), lambda met, x: met + F.when(x == F.get(wanted, met), 1).otherwise(0)) == len(ids)

    fits = F.array_distinct(F.filter(F.array(*[F.when(in_order(ids), F.lit(name)) for name, ids, _ in rules]), lambda x: x.isNotNull()))
    hidden = F.flatten(
        F.array(*[F.when(F.array_contains(F.col("fits"), F.lit(name)), F.array(*map(F.lit, hides))).otherwise(nothing) for name, _, hides in rules if hides])
    )
    return rows.withColumn("fits", fits).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.array_except("fits", hidden), ",").alias("licenses"),
    )
