import random

import duckdb

from matchloom.llm.license_scan import ANCHORS, NAMED, RULES, SENTENCES, scan_licenses
from matchloom.llm.oracle import license_sql

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL."""


def test_sentences_and_rules(table, odd):
    rows = odd + [
        (20, "noise noise\nReleased under the MIT License."),
        (21, "Licensed under CC BY-NC 4.0.\nx. Licensed under the Apache License, Version 2.0. y"),
        (22, "The MIT License (MIT)\n\n" + MIT),
        (23, "Not released under the MIT License."),
        (24, "Unless required by applicable law, nothing."),
    ]
    got = {r.doc_id: r for r in scan_licenses(table(rows)).collect()}
    assert got[20].licenses == "MIT-reference"
    assert set(got[21].licenses.split(",")) == {"CC-BY-NC-4.0", "Apache-2.0-reference"}
    assert got[22].licenses == "MIT" and got[22].n_sentences == 4
    assert got[23].licenses == got[24].licenses == got[10].licenses == got[2].licenses == ""
    assert len(scan_licenses(table(rows)).collect()) == len(rows)


def test_tables_agree():
    assert all(any(a in word for a in ANCHORS for word in s.split()) for s in SENTENCES)
    assert {i for _, ids, _ in RULES for i in ids} <= {*SENTENCES.values(), *NAMED.values()}
    assert {h for _, _, hides in RULES for h in hides} <= {name for name, _, _ in RULES}


def test_empty(table):
    assert scan_licenses(table([])).collect() == []


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """
3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_whole_texts(table):
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    grant, _, rest = MIT.split("\n\n")
    one_line = f"{grant}\n\n{notice}\n\n{rest}"
    marked = ["\n".join((mark + line).rstrip() for line in APACHE.split("\n")) for mark in ("// ", " * ", "# ", "")]
    rows = [(0, one_line), (1, MIT + "\n\n" + notice), (2, BSD), *[(10 + k, t) for k, t in enumerate(marked)]]
    rows += [(20 + k, BSD + NAMES.format(who)) for k, who in enumerate(("the copyright holder", "Foo Inc.", "the University of Bar"))]
    got = {r.doc_id: r.licenses for r in scan_licenses(table(rows)).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "BSD-2-Clause", **{10 + k: "Apache-2.0" for k in range(4)}, **{20 + k: "BSD-3-Clause" for k in range(3)}}


GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def test_spacing_hides_no_sentence(table):
    rows = [(0, "All rights reserved."), (1, "All rights\nreserved."), (2, "x. All rights  reserved. y"), (3, "ALL\tRIGHTS -- RESERVED"), (4, GPL), (5, GPL.replace("3", "2").replace("software:", "software;"))]
    rows += [(6, "Apache License\n   Version 2.0, January 2004\n http://www.apache.org/licenses/"), (7, GPL.replace("General", "Lesser General").replace("3", "2.1")), (8, "# " + GPL.replace("\n", "\n# "))]
    got = {r.doc_id: r.licenses for r in scan_licenses(table(rows)).collect()}
    assert got == {**dict.fromkeys(range(4), "Proprietary"), 4: "GPL-3.0-reference", 5: "GPL-2.0-reference", 6: "Apache-2.0", 7: "LGPL-2.1-reference", 8: "GPL-3.0-reference"}


def test_partly_wrapped_and_mixed_texts_agree_with_sql(table, odd):
    """The SQL has no gate and finds places in a way of its own."""
    rng = random.Random(3)
    known = [k for k in SENTENCES] + [MIT, APACHE, BSD, NAMES.format("Foo Inc."), GPL]
    rows = odd + [(20, MIT.replace("copy\nof", "copy of").replace("the\nrights", "the rights"))]
    for k in range(200):
        parts = [rng.choice(known) for _ in range(rng.randint(1, 5))]
        rows.append((100 + k, rng.choice(["\n", "\n\n", ". ", "\n//\n", "; "]).join(rng.choice([p, p.upper(), p.replace(" ", "\n", 2), p + ".", "x " + p]) for p in parts)))
    docs = table(rows)
    documents = docs.toPandas()
    got = sorted(map(tuple, scan_licenses(docs).collect()), key=repr)
    want = duckdb.sql(license_sql()).fetchall()
    assert got == sorted(want, key=repr) and sum(bool(r[3]) for r in got) > 100 and len(documents) == len(rows)


def test_thousands_of_known_sentences(table):
    """A rule's search is one pass, however many of its sentences a text has without the last one."""
    grant, notice = (next(k for k, v in SENTENCES.items() if v == x) for x in ("mit-grant", "mit-notice"))
    rows = [(1, f"{grant}.\n" * 2000 + f"{notice}.\n" * 2000), (2, f"{notice}.\n{grant}.\n" * 500 + MIT), (3, "license " * 100_000)]
    got = {r.doc_id: (r.n_sentences, r.licenses) for r in scan_licenses(table(rows)).collect()}
    assert got[1] == (4000, "") and got[2][1] == "MIT" and got[3] == (0, "")


def test_notices_line_ends_and_comment_words_hide_nothing(table):
    """A copyright notice right above the grant, line ends of other systems, m4 and batch comments; SPDX names."""
    notice = "Copyright (c) 2020 Jane Doe"
    texts = [f"{notice}\n{MIT}", f"{notice}. All rights kept.\n(c) Kim Poe\n{MIT}", f"# {notice}\n" + "\n".join(f"# {x}" for x in MIT.split("\n")), f"© Doe 2020\n{MIT}".replace("\n", "\r")]
    texts += [f"{notice}\r\n" + MIT.replace("\n", "\r\n"), "\n".join(f"dnl {x}" if x else "dnl" for x in [notice, *MIT.split("\n")]), "\n".join(f"REM {x}" for x in MIT.split("\n"))]
    # A wrapped sentence that goes on with these words is no notice.
    texts.append(MIT.replace("The above copyright notice and", "The above\ncopyright notice and").replace("shall be included in all\ncopies", "shall be included in all copies"))
    spdx = {"GPL-2.0-or-later": "GPL-2.0-reference", "GPL-3.0-only": "GPL-3.0-reference", "LGPL-2.1": "LGPL-2.1-reference", "BSL-1.0": "BSL-1.0", "Unlicense": "Unlicense", "CC0-1.0": "CC0-1.0", "0BSD": "0BSD", "ISC": "ISC", "BSD-2-Clause": "BSD-2-Clause"}
    rows = list(enumerate(texts)) + [(100 + n, f"// SPDX-License-Identifier: {name}\ncode();") for n, name in enumerate(spdx)]
    got = {r.doc_id: (r.n_sentences, r.sentence_ids, r.licenses) for r in scan_licenses(table(rows)).collect()}
    assert [got[k][2] for k in range(len(texts))] == ["MIT"] * len(texts)
    assert [got[100 + n][2] for n in range(len(spdx))] == list(spdx.values())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert {r[0]: tuple(r[1:]) for r in con.execute(license_sql()).fetchall()} == got


def test_expressions_name_every_known_part(table):
    """SPDX expressions and sentences of the form "released under ...", against the SQL as well."""
    want = {
        "// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;": "Apache-2.0-reference,MIT-reference",
        "/* SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND BSD-3-Clause */\nint x = 1;": "GPL-2.0-reference,BSD-3-Clause",
        "SPDX-License-Identifier: Artistic-2.0\nnext line": "Artistic-2.0",
        "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0-reference",
        "SPDX-License-Identifier: LicenseRef-Own OR Zlib": "Zlib",
        "SPDX-License-Identifier: LicenseRef-Own": "",
        "This software is released under the MIT License.": "MIT-reference",
        "Distributed under the MIT license. See LICENSE.": "MIT-reference",
        "Licensed under the GPLv3.": "GPL-3.0-reference",
        "released\n// under GPL-2.0": "GPL-2.0-reference",
        "The source code is made available under the terms of the GNU Lesser General Public License v2.1 or any later version.": "LGPL-2.1-reference",
        "Licensed under either of the Apache License, Version 2.0 or the MIT license": "Apache-2.0-reference,MIT-reference",
        "It is dual licensed under the Mozilla Public Licence 2.0 and the 3-Clause BSD Licence!": "BSD-3-Clause,MPL-2.0",
        "This project is published under the Unlicense.": "Unlicense",
        "Available under CC0": "CC0-1.0",
        "This software is not released under the MIT License.": "",
        "Released under the pressure of time.": "",
        "Distributed under Boost Software License, Version 1.0": "BSL-1.0",
    }
    rows = list(enumerate(want))
    got = {r.doc_id: (r.n_sentences, r.sentence_ids, r.licenses) for r in scan_licenses(table(rows)).collect()}
    assert {t: got[k][2] for k, t in rows} == want
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert {r[0]: tuple(r[1:]) for r in con.execute(license_sql()).fetchall()} == got


def test_every_name_has_a_rule_and_long_expressions_end(table):
    assert set(NAMED.values()) <= {i for _, ids, _ in RULES for i in ids}
    rows = [(1, "licensed under " + "the of either " * 50_000), (2, "SPDX-License-Identifier: " + "MIT OR " * 20_000 + "ISC")]
    got = {r.doc_id: (r.n_sentences, r.licenses) for r in scan_licenses(table(rows)).collect()}
    assert got == {1: (0, ""), 2: (2, "MIT-reference,ISC")}
