"""Licence scan and decontamination on small rows."""

import itertools
import random

from curbside.llm import decontamination as D
from curbside.llm import license_scan as L

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


def test_every_known_sentence_has_a_trigger():
    assert all(any(t in s for t in L.TRIGGERS) for s in L.known_sentences())
    assert all(i in set(L.known_sentences().values()) for _, ids in L.RULES for i in ids)


def test_licences_of_whole_texts(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.\n"
    condition = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    texts = ["Text. Licensed under the Apache License, Version 2.0.", mit + condition, "Released under the MIT License.\nAll rights reserved.", "no licence here, all rights", None, "", "x " * 50_000]
    got = [(r.sentence_ids, r.licenses) for r in sorted(L.scan(frame(spark, texts)).collect())]
    assert got[0] == ("under:Apache-2.0", "Apache-2.0")
    assert got[1] == ("mit-grant,mit-condition", "MIT")
    assert got[2] == ("under:MIT,rights", "MIT,proprietary")
    assert got[3:] == [("", "")] * 4
    assert L.scan(frame(spark, texts).limit(0)).count() == 0


MIT = """MIT License

Copyright (c) 2020 Somebody

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
BSD = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
    * Redistributions of source code must retain the above copyright
      notice, this list of conditions and the following disclaimer.
    * Redistributions in binary form must reproduce the above copyright
      notice, this list of conditions and the following disclaimer in the
      documentation and/or other materials provided with the distribution.
    * Neither the name of the copyright holder nor the names of its
      contributors may be used to endorse or promote products derived from
      this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION).
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
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
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS.
"""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
GPL2 = """/*
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 */
"""


def test_unshortened_wrapped_licences(spark):
    """Whole licence texts as they are usually wrapped, with LF and CRLF, and the same from SQL."""
    import duckdb

    notice = "intro without a mark\nLicensed under the MIT License\nmore prose without a mark\n// SPDX-License-Identifier: BSD-3-Clause\n"
    texts = [MIT, BSD, ISC, APACHE, GPL3, GPL2, notice, MIT.replace("\n", "\r\n"), "prose. " * 30 + "\n\n" + ISC + "\n" + MIT]
    got = [(r.sentence_ids, r.licenses) for r in sorted(L.scan(frame(spark, texts)).collect())]
    assert [x for _, x in got] == ["MIT", "BSD-3-Clause,proprietary", "ISC", "Apache-2.0", "GPL-3.0-or-later", "GPL-2.0-or-later", "MIT,BSD-3-Clause", "MIT", "MIT,ISC"]
    assert got[0][0] == "mit-grant,mit-condition,mit-warranty,mit-liability" and got[3][0] == "under:Apache-2.0,apache-comply,apache-copy-at,apache-address"
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert [tuple(r) for r in sorted(con.execute(f"SELECT doc_id, sentence_ids, licenses FROM ({L._oracle()})").fetchall())] == [(i, *g) for i, g in enumerate(got)]


def test_ordered_rules_take_their_sentences(spark):
    sentences, rules = {"a licen": "a", "b licen": "b"}, [("AB", ("a", "b")), ("A", ("a",)), ("B", ("b",))]
    texts = ["a licen. b licen.", "b licen. a licen.", "a licen. a licen. b licen"]
    got = [r.licenses for r in sorted(L.scan(frame(spark, texts), sentences, rules).collect())]
    assert got == ["AB", "A,B", "AB,A"]


def test_masks_survive_any_allowed_substitutions():
    for bad in itertools.combinations(range(D.WINDOW), D.ALLOWED):
        assert any(all(o + p not in bad for p in m) for m in D.MASKS for o in range(D.WINDOW - m[-1]))
    for size in range(D.MIN_ITEM, D.WINDOW):
        for bad in itertools.combinations(range(size), size * D.ALLOWED // D.WINDOW):
            assert any(all(o + p not in bad for p in m) for m in D.MASKS for o in range(size - m[-1]))


def brute_leaks(docs, items):
    out = {}
    for d, text in docs:
        w = text.split()
        for i, item in items:
            v = item.split()
            if len(v) < D.MIN_ITEM:
                continue
            width = min(D.WINDOW, len(v))
            for shift in range(-len(v), len(w)):
                same = [v[j] == w[j + shift] for j in range(max(0, -shift), min(len(v), len(w) - shift))]
                best = max((sum(same[k : k + width]) for k in range(len(same) - width + 1)), default=0)
                if best >= width - width * D.ALLOWED // D.WINDOW:
                    key = d, i
                    out[key] = max(out.get(key, (0, 0))[0], sum(same)), max(out.get(key, (0, 0))[1], best)
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghij") + rng.choice("xyz")
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 9, 11, 14, 30])))) for i in range(12)]
    docs = []
    for d in range(60):
        w = [word() for _ in range(rng.randrange(0, 60))]
        if d % 3:
            part = rng.choice(items)[1].split()
            part = part[rng.randrange(0, 4) :]
            for _ in range(rng.randrange(0, 4)):
                part[rng.randrange(len(part))] = word()
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = part
        docs.append((d, " ".join(w)))
    df = spark.createDataFrame(docs + docs[:5], "doc_id long, text string").selectExpr("doc_id", "text", "1 AS item_id")
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    want = brute_leaks(docs, items)
    for limit in (D.BROADCAST_SEEDS, 0):  # shipped and shuffled
        got = {(r.doc_id, r.item_id): (r.n_equal, r.n_best) for r in D.leaks(df, bench, broadcast_seeds=limit).collect()}
        assert got == want
    assert want


def test_clean_documents_keeps_the_rest(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    df = frame(spark, [f"x {item} y", "one two three", None, "", item.upper() + "!"])
    bench = spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id long, text string")
    assert sorted(r.doc_id for r in D.clean_documents(df, bench).collect()) == [1, 2, 3]
    assert D.leaks(df.limit(0), bench).count() == 0 and D.leaks(df, bench.limit(0)).count() == 0


def test_clean_documents_finds_short_items_and_scripts_without_spaces(spark):
    long_item = "春眠不觉晓处处闻啼鸟夜来风雨声花落知多少"
    bench = spark.createDataFrame([(0, "name the largest moon of saturn"), (1, "你好,世界"), (2, long_item), (3, "")], "item_id long, text string")
    texts = [
        "q: Name the largest moon of Saturn! a: titan", "name the largest moon of a planet", "name largest the moon of saturn",
        "他说你好世界了", "你好 新世界", "前文" + long_item + "后文", "前文" + long_item.replace("觉", "知") + "后文", "前文" + long_item[::-1], None,
    ]
    assert sorted(r.doc_id for r in D.clean_documents(frame(spark, texts), bench).collect()) == [1, 2, 4, 7, 8]


def test_all_leaks_counts_short_items_and_letters(spark):
    """One row an item and document, with its tokens; letters of scripts without spaces count one by one; SQL gives the same."""
    import duckdb

    rows = [(0, "Ask: name the moon! Twice: name the moon."), (1, "name, the moon"), (2, "name of the moon"), (3, "x你好世界y"), (4, "你世界好"), (5, None), (6, "one two three four five six seven eight nine ten eleven"), (7, "")]
    bench = [(0, "Name the moon"), (1, "你好,世界"), (2, "one two three four five six SEVEN eight nine ten eleven"), (3, None), (4, "moon"), (4, "moon")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    items = spark.createDataFrame([(i, t, 2) for i, t in bench], "item_id long, text string, n int")
    got = sorted(tuple(r) for r in D.all_leaks(docs, items).collect())
    assert got == [(0, 0, 3, 3), (0, 4, 1, 1), (1, 0, 3, 3), (1, 4, 1, 1), (2, 4, 1, 1), (3, 1, 4, 4), (6, 2, 11, 11)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", bench)
    assert sorted(con.execute(D._oracle()).fetchall()) == got
    assert D.all_leaks(docs, items.limit(0)).collect() == [] and D.all_leaks(docs.limit(0), items).collect() == []
