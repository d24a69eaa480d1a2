"""Packing, sampled segmentations and licences."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from messy import TEXTS, empty, table
from pyspark.sql import functions as F

from shoptally.llm import licences, packing, pieces


@pytest.fixture(scope="module")
def encoder():
    return packing.ChunkIds(packing.vocabulary(), limit=50)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_ids_are_the_tokenizers(text):
    held = packing.encoder(packing.vocabulary())
    got = np.frombuffer(held.encode(text), "<u4").tolist()
    assert got == held.tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_known_traps(encoder):
    for text in ["It's DON'T we'll 12.5%", "İstanbul ΣΑΣ ﬁ", "<|endoftext|>x <|startoftext|>", "a\x1cb\x85c", "é ́"]:
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want


def test_pieces_cover_every_token_once(spark, encoder):
    got = packing.pack(table(spark), packing.vocabulary(), length=64).collect()
    line = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    place = 0
    for sequence, offset, length in line:
        assert sequence * 64 + offset == place and offset + length <= 64
        place += length
    want = Counter()
    for i, text in TEXTS:
        ids = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert place == sum(n * size for (_, size, _), n in want.items())
    whole = Counter((r["doc_id"], r["doc_tokens"], r["ids_crc32"]) for r in got if r["length"] == r["doc_tokens"])
    assert all(want[k] >= n for k, n in whole.items())
    assert packing.pack(empty(spark), packing.vocabulary()).count() == 0


def test_chunks_of_a_slice_are_looked_up_once(encoder):
    texts = ["word Wörter, word. " * 40, "", "Wörter, it's 12% İĸŉ ǅẞ word " * 40, "é##ö ª½ ﬁ·"]
    asked = []
    held = type("Counted", (packing.ChunkIds,), {"__getitem__": lambda self, c: asked.append(c) or super(
        packing.ChunkIds, self).__getitem__(c)})(packing.vocabulary(), limit=1000)
    for more in [], ["a\x1cword b\x1f c\x85d\u2003e\u200bf"]:  # Arrow cuts at these separators, the tokenizer does not
        whole, sizes = held.encoded(pa.array([*texts, *more]).slice(1), b"\1\0\0\0")
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in [*texts, *more][1:]]
        assert [np.frombuffer(i, "<u4").tolist() for i in whole.to_pylist()] == want
        assert sizes.tolist() == list(map(len, want))
    asked.clear()
    held.encoded(pa.array(texts), b"\1\0\0\0")
    assert sum(c in ("word", "Wörter,") for c in asked) <= 3  # "word" once more as the word of "word."


def test_places_read_no_ids(spark):
    passed = packing.tokens(table(spark), packing.vocabulary())
    assert all(r["size"] == len(r["ids"]) // 4 for r in passed.collect())
    read = packing.places(passed)._jdf.queryExecution().executedPlan().toString()
    assert "part" in read and "ids" not in read.split("ReadSchema")[-1].split(">")[0]


def test_cutting_lets_the_table_of_ids_go():
    from shoptally.llm import common

    packing.encoder(packing.vocabulary())
    ids = np.arange(10, dtype="<u4")
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7, None]), pa.array([3, 6], pa.int64()), pa.array([ids[:3].tobytes(), ids[3:].tobytes()])], names=["d", "p", "i"])
    got = pa.Table.from_batches(packing._cut(4)(iter([batch]))).to_pylist()
    assert not common._TABLES
    assert [tuple(r.values())[:3] + tuple(r.values())[4:] for r in got] == [
        (7, 0, 1, 3, 0, 3), (7, 1, 2, 3, 1, 0), (None, 0, 2, 7, 1, 2), (None, 2, 4, 7, 2, 0), (None, 6, 1, 7, 3, 0)]
    assert got[3]["ids_crc32"] == zlib.crc32(ids[5:9].tobytes())


def segmentations(vocabulary, unit):
    points = np.frombuffer(unit.encode("utf-32-le"), np.uint32).astype(np.uint64)
    edges = list(zip(*(e.tolist() for e in vocabulary.edges(points, np.full(len(unit), len(unit)))), strict=True))
    found = {}

    def go(at, path, log):
        if at == len(unit):
            found[path] = math.exp(log)
        for begin, end, code, weight in edges:
            if begin == at:
                go(end, (*path, code), log + weight)

    go(0, (), 0.0)
    total = sum(found.values())
    return {p: x / total for p, x in found.items()}


def test_segmentations_are_drawn_without_replacement():
    held = pieces.lattices(pieces.vocabulary_path())
    a, b = (segmentations(held.vocabulary, u) for u in ("▁ton", "▁abe"))
    every = {x + y: p * q for x, p in a.items() for y, q in b.items()}
    n = 4000
    keys = np.random.default_rng(1).integers(0, 1 << 63, n).astype(np.uint64)
    first, pairs, weighted = Counter(), Counter(), defaultdict(float)
    for found in pieces.segmented(held, ["ton abe"] * n, keys, 3):
        paths = [tuple(codes.tolist()) for codes, _, _ in found]
        assert len(set(paths)) == len(paths) == 3
        for path, (_, log, odds) in zip(paths, found, strict=True):
            assert abs(math.exp(log) - every[path]) < 1e-9 and 0 < odds <= 1
            weighted[path] += 1 / odds / n
        first[paths[0]] += 1
        pairs[paths[0], paths[1]] += 1
    top = sorted(every, key=every.get, reverse=True)[:3]
    for p in top:
        assert abs(first[p] / n - every[p]) < 0.03
        assert abs(weighted[p] - 1) < 0.15  # inclusion scores undo the sampling
        for q in top:
            if p != q:
                assert abs(pairs[p, q] / n - every[p] * every[q] / (1 - every[p])) < 0.03


def test_few_segmentations_are_all_given():
    held = pieces.lattices(pieces.vocabulary_path())
    (found,) = pieces.segmented(held, [""], np.array([7], np.uint64), 4)
    assert len(found) == 1 and found[0][2] == 1.0
    every = segmentations(held.vocabulary, "▁ton")
    (found,) = pieces.segmented(held, ["ton"], np.array([7], np.uint64), 30)
    paths = [tuple(c.tolist()) for c, _, _ in found]
    assert len(paths) == len(set(paths)) and set(paths) <= set(every)
    assert set(paths) >= {p for p, x in every.items() if x > 1e-3}
    assert abs(sum(math.exp(log) for _, log, _ in found) - 1) < 1e-3


def test_rare_segmentations_are_drawn_too():
    held = pieces.lattices(pieces.vocabulary_path())
    for word in ("ton", "lemon"):
        every = segmentations(held.vocabulary, "▁" + word)
        (found,) = pieces.segmented(held, [word], np.array([11], np.uint64), len(every) + 5)
        assert {tuple(c.tolist()) for c, _, _ in found} == set(every) and len(found) == len(every)
        assert all(abs(log - math.log(every[tuple(c.tolist())])) < 1e-6 for c, log, _ in found)


def test_query_draws_eight_segmentations(spark, tmp_path):
    table(spark, [(1, "The quick brown fox jumps over a lazy dog."), (2, None)]).write.parquet(
        str(tmp_path / "documents.parquet"))
    got = pieces.op5(spark, str(tmp_path)).groupBy("doc_id").agg(
        F.count_distinct("ids_crc32").alias("n"), F.every("round_trip").alias("fine")).collect()
    assert {r["doc_id"]: (r["n"], r["fine"]) for r in got} == {1: (8, True), 2: (1, True)}


def test_pieces_of_awkward_rows_decode(spark):
    got = pieces.sample(table(spark), pieces.vocabulary_path(), k=2)
    rows = got.collect()
    assert all(r["round_trip"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert {r["doc_id"] for r in rows} == {i for i, _ in TEXTS}
    texts = {(r["doc_id"], r["text"]) for r in pieces.decode(got, pieces.vocabulary_path()).collect()}
    assert texts == {(i, (t or "").replace("▁", " ")) for i, t in TEXTS}
    again = pieces.sample(table(spark).repartition(5), pieces.vocabulary_path(), k=2)
    digest = lambda d: sorted((str(r["doc_id"]), r["sample"], r["ids_crc32"], r["inclusion"]) for r in d.collect())
    assert digest(again) == digest(got)
    assert pieces.sample(empty(spark), pieces.vocabulary_path()).count() == 0


def licences_of(spark, *texts):
    got = licences.scan(table(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    return [r["licences"] for r in got]


def test_licences_need_their_sentences_in_order(spark):
    s = licences.SENTENCES
    mit = [s["mit-grant-notices"], s["mit-warranty"], s["mit-liability"]]
    assert licences_of(
        spark, "Text.\nReleased under the MIT License.", "no stop\nLicensed under CC BY-NC 4.0.\nmore",
        ". ".join(mit) + ".", ". ".join(mit[::-1]) + ".", mit[0] + ". Words between. " + mit[1] + "!\n\n" + mit[2],
        "licensed UNDER the   apache license -- version 2.0", "It is licensed under the Apache License, Version 2.0.",
        "x. " * 20_000 + s["gpl3-notice"],
    ) == [["MIT"], ["CC-BY-NC-4.0"], ["MIT"], [], ["MIT"], ["Apache-2.0"], [], ["GPL-3.0-only"]]


MIT = """MIT License

Copyright (c) 2020 A. Person

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
APACHE = """Copyright 2020 A. Person

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
BSD2 = """Copyright (c) 2020, A. Person

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".
"""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
LGPL21 = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented.
"""
EPL2 = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/

SPDX-License-Identifier: EPL-2.0"""
UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy it."
ZERO = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE."""
PUBLISHED = [
    ("MIT", MIT), ("Apache-2.0", APACHE), ("BSD-2-Clause", BSD2), ("BSD-3-Clause", BSD3), ("GPL-2.0-or-later", GPL2),
    ("LGPL-2.1-or-later", LGPL21), ("MPL-2.0", MPL), ("Zlib", ZLIB), ("EPL-2.0", EPL2), ("Unlicense", UNLICENSE),
    ("0BSD", ZERO)]


def test_published_layouts_plain_and_in_comments(spark):
    comments = [
        lambda t: t,
        lambda t: t.replace("\n", "\r\n"),
        lambda t: "/*\n" + "\n".join((" * " + line).rstrip() for line in t.split("\n")) + "\n */\nint main;\n",
        lambda t: "\n".join(("# " + line).rstrip() for line in t.split("\n")) + "\n#\nimport os\n",
        lambda t: "\n".join(("// " + line) for line in t.split("\n")) + "\n\ncode()\n",
    ]
    got = iter(licences_of(spark, *[c(text) for c in comments for _, text in PUBLISHED]))
    for number, _ in enumerate(comments):
        for name, _ in PUBLISHED:
            assert next(got) == [name], (number, name)


def test_two_licences_in_one_text_and_a_missing_part(spark):
    assert licences_of(spark, MIT + "\n\n" + ZLIB, MIT.replace("IN NO EVENT", "NEVER"), BSD3 * 2) == [
        ["MIT", "Zlib"], [], ["BSD-3-Clause"]]
    assert len({name for name, _ in licences.RULES}) >= 25


def test_every_known_sentence_has_an_anchor_and_is_one_sentence():
    import re

    for name, sentence in licences.SENTENCES.items():
        assert any(a in sentence.lower() for a in licences.ANCHORS), name
        assert not re.search(licences.SENTENCE_END, sentence), name
    assert {n for _, rule in licences.RULES for n in rule} == set(licences.SENTENCES)


def test_licences_of_awkward_rows(spark):
    got = licences.scan(table(spark)).collect()
    assert len(got) == len(TEXTS) and all(r["licences"] == [] and r["sentences"] == [] for r in got)
    assert licences.scan(empty(spark)).count() == 0
