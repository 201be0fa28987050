"""Licence scans against genuine notices, plain search and SQL."""

import re
import textwrap

import duckdb
import pytest

from fringeworks.llm import licenses, queries

from ..conftest import compare

MIT = """MIT License

Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
LGPL = GPL2.replace("This program", "This library").replace("GNU General", "GNU Lesser General").replace("version 2 of", "version 2.1 of").replace("this program", "this library")
AGPL = GPL3.replace("GNU General", "GNU Affero General")
ISC = """Copyright (c) 2004-2010 Somebody

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
BSD3 = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 * 1. Redistributions of source code must retain the above copyright notice, this
 *    list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright notice,
 *    this list of conditions and the following disclaimer in the documentation
 *    and/or other materials provided with the distribution.
 * 3. Neither the name of the copyright holder nor the names of its
 *    contributors may be used to endorse or promote products derived from
 *    this software without specific prior written permission.
"""
BSD2 = "\n".join(BSD3.split("\n")[:7])
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
GENUINE = [
    (MIT, "MIT"), (GPL3, "GPL-3.0-or-later"), (GPL2, "GPL-2.0-or-later"), (LGPL, "LGPL-2.1-or-later"), (AGPL, "AGPL-3.0-or-later"), (ISC, "ISC"), (BSD3, "BSD-3-Clause"), (BSD2, "BSD-2-Clause"), (APACHE, "Apache-2.0"), (MPL, "MPL-2.0"),
]


def commented(text: str, sign: str) -> str:
    return "".join(f"{sign}{line}\n" for line in text.split("\n"))


def plain_search(text: str | None) -> tuple[list[str], list[str]]:
    """Known sentences and licences by a loop over lines, words and rules."""
    lines = []
    for line in (text or "").lower().split("\n"):
        line = re.sub(r"^[ \t]*(#+|//+!?|/\*+!?|\*+/?|--+|;+|%+|>+|<!--|dnl |rem )", "", line)
        lines.append(line)
    parts, buf = [], ""

    def close():
        nonlocal buf
        parts.append(buf)
        buf = ""

    for k, line in enumerate(lines):
        if k and (not line.strip(" \t\r") or re.match(licenses.OPENERS[2:], line)):
            close()
        while m := re.search(r"\.([ \t\r\f]+|$)", line):
            buf += line[: m.start()]
            close()
            line = line[m.end() :]
        colon = k < len(lines) - 1 and re.search(r":[ \t\r]*$", line)
        buf += line + "\n"
        if colon:
            close()
    close()
    ids = []
    for p in parts:
        words = re.findall("[a-z0-9]+", p)
        if len(words) > 1 and re.fullmatch("[0-9]{1,2}", words[0]):
            words = words[1:]
        key = " ".join(words)
        if m := re.match(licenses.POINTER, key):
            key = m[1]
        if m := re.match(licenses.REFERENCE, key):
            key = "under " + m[1]
        if key in licenses.SENTENCES:
            ids.append(licenses.SENTENCES[key])
    left, found = list(ids), []
    for name, rule in licenses.RULES:
        at, hit = 0, False
        while at + len(rule) <= len(left):
            if tuple(left[at : at + len(rule)]) == rule:
                left[at : at + len(rule)] = [None]
                hit = True
            at += 1
        if hit and name not in found:
            found.append(name)
    return ids, found


def test_licenses_equal_sql(spark, duck):
    compare(spark, duck, queries.QUERIES["op9_license_sentences"], queries.ORACLE_SQL["op9_license_sentences"])


def test_genuine_notices(spark):
    """Each notice plain, commented, with another wrap, and as one line after a title."""
    rows, want = [], []
    for text, name in GENUINE:
        forms = [text, "Some prose.\n\n" + text + "\nint main() {}", text.replace("\n", "\r\n")]
        if not re.match(r"[#/ ]*\*|[#/]", text):
            forms += [commented(text, "// "), commented(text, "# "), "\n\n".join(textwrap.fill(p, 50) for p in text.split("\n\n"))]
        for f in forms:
            rows.append((len(rows), f, "x"))
            want.append(name)
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, text, _ in rows:
        assert (got[i].licenses, got[i].n_unmatched) == (want[i], 0), text
        ids, found = plain_search(text)
        assert (got[i].sentence_ids, got[i].licenses) == ("".join(f"<{x}>" for x in ids), ",".join(found))


CASES = [
    ("text\nLICENSED under CC BY-NC 4.0.", "CC-BY-NC-4.0", 0), ("Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\n", "MIT,Apache-2.0", 0),
    ("# Licensed under the MIT license, see LICENSE.", "MIT", 0), ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later", 0), ("released under cc\tby 4.0", "CC-BY-4.0", 0),
    ("x. Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.", "Apache-2.0", 0),
    ("This software is licensed under the terms of the BSD 3-Clause License.", "BSD-3-Clause", 0), ("See the GNU General Public License for more details.", "", 1),
    ("a licence of love", "", 0), (None, "", 0), ("", "", 0), ("\n\n.\n", "", 0), ("lorem ipsum dolor " * 50_000 + ".\n\n" + MIT, "MIT", 0),
    # A notice in the middle of another does not make its halves neighbours.
    (BSD3.split(" * 2.")[0] + APACHE + " * 2." + BSD2.split(" * 2.")[1], "Apache-2.0", 3),
]


@pytest.mark.parametrize(("text", "want", "left"), CASES)
def test_license_rules(spark, text, want, left):
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, text, "x")], "doc_id long, text string, licenses string")
    rows = licenses.scan(df).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"] and len({tuple(r)[1:] for r in rows}) == 1
    r = rows[0]
    ids, found = plain_search(text)
    assert (r.licenses, r.n_unmatched, r.sentence_ids) == (want, left, "".join(f"<{x}>" for x in ids)) and r.licenses == ",".join(found)
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.execute("insert into documents values (?, ?)", [r.doc_id, text])
    assert con.sql(licenses.oracle_sql()).fetchall()[0] == tuple(r)


def test_license_sentences_of_another_table(spark):
    df = spark.createDataFrame([(1, "Do what you like with it. More."), (2, "plain")], "doc_id long, text string")
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in licenses.scan(df, {"do what you like with it": "WTF"}, [("Free", ("WTF",))]).collect()}
    assert got == {1: ("<WTF>", "Free"), 2: ("", "")} and licenses.scan(df.limit(0)).count() == 0


def test_license_tables():
    assert all(any(a in s for a in licenses.ANCHORS) or re.search(licenses.CC_BY, s) for s in licenses.SENTENCES)
    assert {i for _, ids in licenses.RULES for i in ids} <= set(licenses.SENTENCES.values())
    lengths = [len(ids) for _, ids in licenses.RULES]
    assert lengths == sorted(lengths, reverse=True) and len({ids for _, ids in licenses.RULES}) == len(lengths)
