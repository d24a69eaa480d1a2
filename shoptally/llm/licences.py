"""Licence scans by sentence rules.

A text is cut into sentences, each sentence is normalised (lower case, anything but letters and
digits as one space) and looked up among known licence sentences. What remains of the text is its
sequence of sentence identifiers, and a licence is found where the identifiers of one of its rules
occur in the rule's order; other sentences may stand between. Everything is one projection of
built-in functions: no shuffle, no join, no state, so copies, long texts and hot sources cost what
their own bytes cost. Texts without any of the anchor words skip the sentence work; every known
sentence holds an anchor (a test asserts it), so nothing is lost.

A sentence ends at ``.``, ``!`` or ``?`` before white space, at a colon that ends a line, or at a line
of nothing but blanks and comment signs. Sentences are those of the published layouts, so a notice is
found in a comment and in a list as in plain paragraphs. A sentence that is not known as a whole is also looked up line by line, so a notice on a line of its own is found below
a line without a full stop.

A licence that extends another (three clauses over two) is reported without it. A text that meets the
rules of several others has them all, in the order of their names, which also settles ties.

Defined cases: a NULL or empty text has no sentence and no licence. A sentence that occurs several
times occurs several times in the sequence. Rows that repeat an id are reported each. Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptally.llm.common import columns_apart, table

# Sentences of published licences and notices, by identifier.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-comply": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
                     "except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-copy-url": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the "
                    'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
                    "either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-notice": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 'associated documentation files (the "Software"), to deal in the Software without restriction, '
                 "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                 "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
                 "furnished to do so, subject to the following conditions:",
    "mit-notices": "The above copyright notice and this permission notice shall be included in all copies or "
                   "substantial portions of the Software",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                  'associated documentation files (the "Software"), to deal in the Software without restriction, '
                  "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                  "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
                  "furnished to do so",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
                    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
                    "NONINFRINGEMENT",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
                     "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
                     "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
                 "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
                 "in all copies",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
                    "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
                  "fee is hereby granted",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                 "provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions "
                  "and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
                  "and the following disclaimer in the documentation and/or other materials provided with the "
                  "distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                   "or promote products derived from this software without specific prior written permission",
    "bsd-endorse-old": "Neither the name of the <organization> nor the names of its contributors may be used to "
                       "endorse or promote products derived from this software without specific prior written "
                       "permission",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version",
    "gpl3-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "General Public License as published by the Free Software Foundation, version 3",
    "gpl2-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation; either version 2 of the "
                  "License, or (at your option) any later version",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                 "General Public License as published by the Free Software Foundation; version 2 of the License",
    "lgpl21-later": "This library is free software; you can redistribute it and/or modify it under the terms of the "
                    "GNU Lesser General Public License as published by the Free Software Foundation; either version "
                    "2.1 of the License, or (at your option) any later version",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
                 "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl-details": "See the GNU Lesser General Public License for more details",
    "lgpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                   "Lesser General Public License as published by the Free Software Foundation, either version 3 of "
                   "the License, or (at your option) any later version",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version",
    "agpl-details": "See the GNU Affero General Public License for more details",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial "
                  "applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
                 'software and accompanying documentation covered by this license (the "Software") to use, reproduce, '
                 "display, distribute, execute, and transmit the Software, and to prepare derivative works of the "
                 "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to "
                 "the following:",
    "bsl-notices": "The copyright notices in the Software and this entire statement, including the above license "
                   "grant, this restriction and the following disclaimer, must be included in all copies of the "
                   "Software, in whole or in part, and all derivative works of the Software, unless such copies or "
                   "derivative works are solely in the form of machine-executable object code generated by a source "
                   "language processor",
    "epl2-header": "This program and the accompanying materials are made available under the terms of the Eclipse "
                   "Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl1-header": "This program and the accompanying materials are made available under the terms of the Eclipse "
                   "Public License v1.0 which accompanies this distribution, and is available at "
                   "http://www.eclipse.org/legal/epl-v10.html",
    "cc0-title": "CC0 1.0 Universal",
    "cc0-dedication": "To the extent possible under law, the author(s) have dedicated all copyright and related and "
                      "neighboring rights to this software to the public domain worldwide",
    "wtfpl-terms": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "wtfpl-copying": "Everyone is permitted to copy and distribute verbatim or modified copies of this license "
                     "document, and changing it is allowed as long as the name is changed",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
                "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "lgpl-notice": "Licensed under the GNU Lesser General Public License, version 3",
    "agpl-notice": "Licensed under the GNU Affero General Public License, version 3",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "ccby-notice": "Licensed under CC BY 4.0",
    "ccbysa-notice": "Licensed under CC BY-SA 4.0",
    "ccbync-notice": "Licensed under CC BY-NC 4.0",
    "ccbyncnd-notice": "Licensed under CC BY-NC-ND 4.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
# both paragraphs where no line ends between them
SENTENCES["mit-grant-notices"] = f'{SENTENCES["mit-grant"]} {SENTENCES["mit-notices"]}'

# Rules as (licence, identifiers in order); a licence may have several rules.
RULES = [
    ("Apache-2.0", ("apache-comply", "apache-copy", "apache-url", "apache-basis", "apache-see")),
    ("Apache-2.0", ("apache-comply", "apache-copy-url", "apache-basis", "apache-see")),
    ("Apache-2.0", ("apache-notice",)),
    ("MIT", ("mit-grant", "mit-notices", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant-notices", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-licensed",)),
    ("MIT-0", ("mit0-grant", "mit-warranty", "mit-liability")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-old")),
    ("GPL-2.0-only", ("gpl2-only", "gpl-hope", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-later", "gpl-hope", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-3.0-only", ("gpl3-only", "gpl-hope", "gpl-details")),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("LGPL-2.1-or-later", ("lgpl21-later", "lgpl-hope", "lgpl-details")),
    ("LGPL-3.0-or-later", ("lgpl3-later", "gpl-hope", "lgpl-details")),
    ("LGPL-3.0", ("lgpl-notice",)),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope", "agpl-details")),
    ("AGPL-3.0", ("agpl-notice",)),
    ("MPL-2.0", ("mpl-subject",)),
    ("EPL-1.0", ("epl1-header",)),
    ("EPL-2.0", ("epl2-header",)),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
    ("BSL-1.0", ("bsl-grant", "bsl-notices")),
    ("CC0-1.0", ("cc0-title",)),
    ("CC0-1.0", ("cc0-dedication",)),
    ("WTFPL", ("wtfpl-terms", "wtfpl-copying")),
    ("CC-BY-4.0", ("ccby-notice",)),
    ("CC-BY-SA-4.0", ("ccbysa-notice",)),
    ("CC-BY-NC-4.0", ("ccbync-notice",)),
    ("CC-BY-NC-ND-4.0", ("ccbyncnd-notice",)),
    ("Unlicense", ("unlicense",)),
]

# A licence found by a rule also meets the rules of those it extends; they are not reported beside it.
EXTENDS = {"BSD-3-Clause": ("BSD-2-Clause",)}

ANCHORS = ("licen", "warrant", "permission", "redistribut", "copyright", "unencumbered", "cc0")

_BLANK = r"[ \t\r\n\f]"
# between the lines of an empty line there may be signs of a comment
SENTENCE_END = rf"[.!?]{_BLANK}+|:[ \t\r\f]*\n|\n[ \t\r\n\f*#/;%-]*\n"


def plain(sentence: str) -> str:
    """The normal form of a known sentence, as ``normal_form`` makes it of a column."""
    out = "".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower())
    return " ".join(out.split())


def normal_form(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def identifiers(text: Column, sentences: dict[str, str]) -> Column:
    """The identifiers of a text's known sentences, in the text's order."""
    known = F.create_map(*[F.lit(x) for name, s in sentences.items() for x in (plain(s), name)])

    def looked_up(sentence: Column) -> Column:
        whole = F.try_element_at(known, normal_form(sentence))
        lines = F.transform(
            F.split(sentence, "\n"), lambda line: F.try_element_at(known, normal_form(line)))
        return F.when(whole.isNotNull(), F.array(whole)).when(
            F.contains(sentence, F.lit("\n")), lines).otherwise(F.array(F.lit(None).cast("string")))

    found = F.flatten(F.transform(F.split(text, SENTENCE_END), looked_up))
    lowered = F.lower(text)
    anchored = F.lit(False)
    for anchor in ANCHORS:
        anchored = anchored | F.contains(lowered, F.lit(anchor))
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(anchored, F.lit(False)), F.filter(found, lambda x: x.isNotNull())).otherwise(none)


def matched(sequence: Column, rules: list[tuple[str, tuple[str, ...]]]) -> Column:
    """The licences with a rule whose identifiers occur in ``sequence`` in order, sorted."""
    marked = F.concat(F.lit("<"), F.array_join(sequence, "><"), F.lit(">"))
    found = {}
    for licence, rule in rules:
        hit = marked.like("%" + "%".join(f"<{name}>" for name in rule) + "%")
        found[licence] = found[licence] | hit if licence in found else hit
    for wide, narrow in EXTENDS.items():
        for licence in narrow:
            if wide in found and licence in found:
                found[licence] = found[licence] & ~found[wide]
    hits = [F.when(hit, F.lit(licence)) for licence, hit in sorted(found.items())]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
         sentences: dict[str, str] | None = None,
         rules: list[tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """Per row: ``doc_id``, ``sentences`` and ``licences`` (arrays)."""
    rows = columns_apart(docs, [doc_id, text])
    found = rows.select(
        F.col(doc_id).alias("doc_id"),
        identifiers(F.col(text), sentences or SENTENCES).alias("sentences"))
    return found.withColumn("licences", matched(F.col("sentences"), rules or RULES))


def op1(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("sentences").alias("n_sentences"),
        F.array_join("sentences", ",").alias("sentence_ids"),
        F.array_join("licences", ",").alias("licences"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(plain(s))}, {quoted(name)})" for name, s in SENTENCES.items())
    norm = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    by_licence: dict[str, list[str]] = {}
    for licence, rule in RULES:
        by_licence.setdefault(licence, []).append(
            "marked LIKE '%" + "%".join(f"<{n}>" for n in rule) + "%'")
    met = {k: f"({' OR '.join(by_licence[k])})" for k in sorted(by_licence)}
    for wide, narrow in EXTENDS.items():
        for licence in narrow:
            met[licence] += f" AND NOT {met[wide]}"
    cases = ", ".join(f"CASE WHEN {hit} THEN '{k}' END" for k, hit in met.items())
    return f"""
WITH k(sentence, name) AS (VALUES {known}),
s AS (
  SELECT doc_id, unnest(string_split_regex(text, '{SENTENCE_END}')) AS sentence,
         generate_subscripts(string_split_regex(text, '{SENTENCE_END}'), 1) AS pos
  FROM documents),
w AS (SELECT s.*, k.name FROM s LEFT JOIN k ON k.sentence = {norm.format("s.sentence")}),
l AS (
  SELECT doc_id, pos, unnest(string_split(sentence, chr(10))) AS line,
         generate_subscripts(string_split(sentence, chr(10)), 1) AS line_pos
  FROM w WHERE name IS NULL AND contains(sentence, chr(10))),
f AS (
  SELECT doc_id, pos, 0 AS line_pos, name FROM w WHERE name IS NOT NULL
  UNION ALL
  SELECT doc_id, pos, line_pos, k.name FROM l JOIN k ON k.sentence = {norm.format("l.line")}),
g AS (
  SELECT doc_id, count(*)::INT AS n, string_agg(name, ',' ORDER BY pos, line_pos) AS ids,
         '<' || string_agg(name, '><' ORDER BY pos, line_pos) || '>' AS marked
  FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::INT AS n_sentences, coalesce(ids, '') AS sentence_ids,
       coalesce(concat_ws(',', {cases}), '') AS licences
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
"""


SQL = _sql()
