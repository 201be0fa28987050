"""Licence scans by sentence rules.

A text is cut into sentences, each is normalised, and known licence sentences
become identifiers; the identifiers in text order are then matched against
ordered rules, longer rules first.  What a rule has matched gives way to a mark, so
that its neighbours stay apart for the rules after it.  The known sentences and the
rules are derived from the notices and reference forms below; everything on the
data is a column expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GRANTED = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_BSD_LIABLE = "IN NO EVENT SHALL THE {who} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. """ + _BSD_LIABLE.format(who="COPYRIGHT HOLDER OR CONTRIBUTORS")

# Public licence texts and notices, (licence, text, least number of its
# sentences that a rule takes).
NOTICES: list[tuple[str, str, int]] = [
    ("MIT", _GRANTED + """

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", 1),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", 1),
    ("BSD-3-Clause", _BSD_HEAD + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
""" + _BSD_TAIL, 4),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL, 3),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", 1),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""", 1),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", 1),
]
# Fixed values: (licence, name, version, whether later ones count) of the notices that
# the GNU licences recommend.
GNU = [
    (f"{short}-{version}-{'or-later' if later else 'only'}", name, version, later)
    for short, name, versions in (("GPL", "GNU General Public License", ("2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", ("3",)))
    for version in versions
    for later in (True, False)
]
# Names and identifiers in references to a licence.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT License", "MIT licence"],
    "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 license"],
    "GPL-2.0-only": ["GNU General Public License version 2", "GNU General Public License v2.0", "GPLv2"],
    "GPL-3.0-only": ["GNU General Public License version 3", "GNU General Public License v3.0", "GPLv3"],
    "LGPL-2.1-only": ["GNU Lesser General Public License version 2.1", "LGPLv2.1"],
    "LGPL-3.0-only": ["GNU Lesser General Public License version 3", "LGPLv3"],
    "AGPL-3.0-only": ["GNU Affero General Public License version 3", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License Version 2.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal License"],
    "Unlicense": ["Unlicense"],
}
SPDX_ONLY = ("GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later")
#: Every known sentence holds one of these, or "cc by" with any sign between, so other
#: texts need no cutting.
ANCHORS = ("licen", "copyright", "warrant", "redistribut", "permission", "unencumbered", "liable", "gpl", "creative", "cc0", "mozilla")
CC_BY = "cc[^a-z0-9]+by"
#: Comment signs at the start of a line.
PREFIX = r"(\A|\n)[ \t]*(?:#+|//+!?|/\*+!?|\*+/?|--+|;+|%+|>+|<!--|dnl |rem )"
#: What opens a licence sentence at the start of a line, whatever ends the line before.
OPENERS = r"\n[ \t]*(licensed under|released under|distributed under the terms|permission is hereby|permission to use|redistribution and use|redistributions of|redistributions in|neither the name|the above copyright notice and this permission notice shall|the software is provided|this software is (?:provided|licensed)|this (?:project|work|program|library|file|code) is|this source code form is|this is free and|spdx-license-identifier|unless required by)"
#: A full stop before white space, a colon at the end of a line, and an empty line.
ENDS = r"\.(?:[ \t\r\n\f]+|\z)|:[ \t\r]*\n|\n[ \t\r]*\n"
#: A pointer to the full text after a reference, and a list's number before a sentence.
POINTER = r"^(.+) see (?:the )?(?:accompanying )?(?:license|licence|copying)(?: md| txt)?(?: file)?(?: for (?:more )?(?:details|information))?$"
NUMBER = r"^[0-9]{1,2} "
#: The forms of a reference, of which what follows is kept.
REFERENCE = r"^(?:this (?:project|work|software|program|library|code|file|package|repository) is )?(?:licensed|released|distributed|published|available|made available) under (?:the terms of )?(?:the |an? )?(.+)$"
MARK = "\x01"


def sentences_of(text: str) -> list[str]:
    """The normalised sentences of a text, as the columns of ``scan`` have them."""
    python = lambda p: p.replace(r"\z", r"\Z")
    low = re.sub(PREFIX, r"\1", text.lower())
    marked = re.sub(OPENERS, MARK + r"\1", re.sub(python(ENDS), MARK + "\n", low))
    plain = (re.sub(NUMBER, "", re.sub("[^a-z0-9]+", " ", s).strip(" ")) for s in marked.split(MARK))
    return [re.sub(REFERENCE, r"under \1", re.sub(POINTER, r"\1", s)) for s in plain]


def _notices() -> list[tuple[str, list[str], int]]:
    out = [(name, sentences_of(text), least) for name, text, least in NOTICES]
    for short, name, version, later in GNU:
        long = short.replace("-2-", "-2.0-").replace("-3-", "-3.0-")
        for thing in ("program", "library", "software"):
            # Versions 2 part the clauses by semicolons, versions 3 by a colon and commas.
            first = f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the {name} "
            first += f"as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version." if later else f"version {version} as published by the Free Software Foundation."
            rest = f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this {thing}."
            out.append((long, sentences_of(f"{first}\n\n{rest}"), 1))
    return out


def _tables() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Known sentences with their identifiers, and the rules.

    A notice's sentences are numbered where no notice before it has them.  Its rules take
    the whole, and as many sentences from the start or the second as the notice asks for
    at least.  Sentences without an anchor are left out.
    """
    known: dict[str, str] = {}
    rules: dict[tuple[str, ...], str] = {}
    for name, sentences, least in _notices():
        ids = []
        for k, s in enumerate(s for s in sentences if any(a in s for a in ANCHORS)):
            ids.append(known.setdefault(s, f"{name}:{k + 1}"))
        own = ids[0].startswith(f"{name}:") or least > 1
        for stop in range(least, len(ids) + 1):
            if own:
                rules.setdefault(tuple(ids[:stop]), name)
            if least > 1 and stop > least - 1:
                rules.setdefault(tuple(ids[1:stop]), name)
    for name in dict.fromkeys([*NAMES, *SPDX_ONLY]):
        ref = f"{name}:ref"
        for title in NAMES.get(name, []):
            known.setdefault(sentences_of(f"Licensed under {title} ")[0], ref)
        for identifier in dict.fromkeys([name, name.removesuffix("-only")]):
            known.setdefault(sentences_of(f"SPDX-License-Identifier: {identifier} ")[0], ref)
        rules.setdefault((ref,), name)
        if name in ("MIT", "Apache-2.0"):  # a reference as the notice's heading
            whole = max((ids for ids, n in rules.items() if n == name), key=len)
            rules.update({(ref, *whole[:k]): name for k in range(1, len(whole) + 1)})
    for title in ("Apache License, Version 2.0 (the \"License\")",):  # cut off from its clause
        known.setdefault(sentences_of(f"Licensed under the {title}; ")[0], "Apache-2.0:ref")
    return known, sorted(((n, ids) for ids, n in rules.items()), key=lambda r: -len(r[1]))


SENTENCES, RULES = _tables()


def _licence_steps(rules: list[tuple[str, tuple[str, ...]]]) -> list[tuple[str, str]]:
    return [(name, "".join(f"<{i}>" for i in ids)) for name, ids in rules]


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, tuple[str, ...]]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licenses, n_sentences, n_unmatched) for each row.

    sentence_ids are the known sentences in text order as `<id><id>`; licenses are
    the licences of the rules met, in the rules' order, comma-separated and each
    once; n_unmatched counts the known sentences that no rule took.  Null, empty and
    unlicensed texts give empty strings and 0; repeated rows and null ids pass
    through; an empty table gives an empty result; other columns are not read.
    Sentences of another table are given as ``sentences_of`` normalises them; of rules of
    one length the first given goes first.
    """
    sentences = SENTENCES if sentences is None else sentences
    rules = RULES if rules is None else rules
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    table = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    # Another table's sentences need hold no anchor.
    anchored = F.lit(sentences is not SENTENCES)
    for a in ANCHORS:
        anchored = anchored | F.contains("low", F.lit(a))
    anchored = anchored | F.rlike("low", F.lit(CC_BY))
    bare = F.regexp_replace("low", PREFIX, "$1")
    marked = F.regexp_replace(F.regexp_replace(bare, ENDS, MARK + "\n"), OPENERS, MARK + "$1")
    plain = lambda s: F.regexp_replace(F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")), NUMBER, "")
    known = F.transform(F.split(marked, MARK), lambda s: F.element_at(table, F.regexp_replace(F.regexp_replace(plain(s), POINTER, "$1"), REFERENCE, "under $1")))
    ids = F.transform(F.filter(known, lambda i: i.isNotNull()), lambda i: F.concat(F.lit("<"), i, F.lit(">")))
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("low"))
    cut = cut.select("doc_id", F.when(anchored, F.array_join(ids, "")).otherwise(F.lit("")).alias("sentence_ids"))
    steps = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(ids).alias("ids")) for name, ids in _licence_steps(rules)])
    start = F.struct(F.col("sentence_ids").alias("left"), F.array().cast("array<string>").alias("found"))
    take = lambda acc, r: F.when(F.instr(acc["left"], r["ids"]) > 0, F.struct(F.replace(acc["left"], r["ids"], F.lit("|")).alias("left"), F.array_append(acc["found"], r["name"]).alias("found"))).otherwise(acc)
    met = F.when(F.col("sentence_ids") != "", F.aggregate(steps, start, take))
    cut = cut.withColumn("met", met)
    count = lambda c: (F.length(c) - F.length(F.replace(c, F.lit("<"), F.lit("")))).cast("long")
    licences = F.coalesce(F.array_join(F.array_distinct("met.found"), ","), F.lit(""))
    return cut.select("doc_id", "sentence_ids", licences.alias("licenses"), count(F.col("sentence_ids")).alias("n_sentences"), F.coalesce(count(F.col("met.left")), F.lit(0)).cast("long").alias("n_unmatched"))


def oracle_sql() -> str:
    """The same result for DuckDB by other means: sentences are rows that join a table of
    known ones, and each rule is a step of its own."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({q(s)}, {q(i)})" for s, i in SENTENCES.items())
    marked = f"regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{PREFIX}', '\\1', 'g'), '{ENDS}', chr(1) || chr(10), 'g'), '{OPENERS}', chr(1) || '\\1', 'g')"
    normal = f"regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')), '{NUMBER}', ''), '{POINTER}', '\\1'), '{REFERENCE}', 'under \\1')"
    steps, last = [], "s0"
    for k, (name, ids) in enumerate(_licence_steps(RULES)):
        steps.append(f"s{k + 1} AS (SELECT row_id, doc_id, sentence_ids, CASE WHEN contains(rest, {q(ids)}) AND NOT list_contains(l, {q(name)}) THEN list_append(l, {q(name)}) ELSE l END AS l, replace(rest, {q(ids)}, '|') AS rest FROM {last})")
        last = f"s{k + 1}"
    return f"""
    WITH known(sentence, id) AS (VALUES {known}),
    docs AS (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents),
    parts AS (SELECT row_id, string_split({marked}, chr(1)) AS p FROM docs),
    cut AS (SELECT row_id, unnest(p) AS s, generate_subscripts(p, 1) AS k FROM parts),
    met AS (SELECT row_id, string_agg('<' || id || '>', '' ORDER BY k) AS ids FROM cut JOIN known ON known.sentence = {normal} GROUP BY row_id),
    s0 AS (SELECT row_id, doc_id, ids AS sentence_ids, CAST([] AS VARCHAR[]) AS l, ids AS rest FROM met JOIN docs USING (row_id)),
    {', '.join(steps)}
    SELECT d.doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(array_to_string(l, ','), '') AS licenses,
      CAST(coalesce(length(sentence_ids) - length(replace(sentence_ids, '<', '')), 0) AS BIGINT) AS n_sentences,
      CAST(coalesce(length(rest) - length(replace(rest, '<', '')), 0) AS BIGINT) AS n_unmatched
    FROM docs d LEFT JOIN {last} USING (row_id)"""
