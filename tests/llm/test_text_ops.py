import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from feedloom.llm import decontaminate, toxicity
from feedloom.llm.common import Workspace
from feedloom.llm.decontaminate import OPENERS, UNITS, WINDOW, contaminated, template_classes
from feedloom.llm.licences import CUES, RULES, SENTENCES, _known, lengths, licence_hits, sentence_table
from feedloom.llm.ngram_lm import discounts, score_texts
from feedloom.llm.packing import binary_pieces, pack, write_buckets
from feedloom.llm.preference import conversations, format_pairs, swapped_answers
from feedloom.llm.warc import read_records, write_archives
from tests.llm.conftest import edge_rows, frame, prose


def test_language_model(spark, edges, empty):
    rows = [((t or "").encode().lower().split() + [None], (i or 0) % 5 == 1) for i, t in edge_rows()]
    c, b = collections.Counter(), collections.Counter()
    for w, held in rows:
        if not held:
            c.update(w)
            b.update(zip([0, *w], w, strict=False))
    n, size = sum(c.values()), len(c)
    context, ways = collections.defaultdict(lambda: [0, 0, 0, 0]), collections.Counter()
    for (x, y), k in b.items():
        context[x][0] += k
        context[x][min(k, 3)] += 1
        ways[y] += 1
    off2, off1 = ((0, *discounts(np.bincount(np.minimum(list(m.values()), 5), minlength=6)[1:5])) for m in (b, ways))
    total = sum(ways.values())
    kept = sum(off1[min(k, 3)] for k in ways.values()) / total

    def p(x, y):
        q = max(ways[y] - off1[min(ways[y], 3)], 0) / total + kept / (size + 1)
        if x not in context:
            return q
        k = context[x]
        return max(b[x, y] - off2[min(b[x, y], 3)], 0) / k[0] + sum(off2[j] * k[j] for j in (1, 2, 3)) / k[0] * q

    assert sum(p(0, y) for y in c) + p(0, b"unknown!") == pytest.approx(1)
    want = [(len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (size + 1))) for x in w), sum(math.log10(p(x, y)) for x, y in zip([0, *w], w, strict=False))) for w, _ in rows]
    got = score_texts(edges, F.coalesce(F.col("doc_id"), F.lit(0)) % 5 == 1).collect()
    assert np.array(sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)) == pytest.approx(np.array(sorted(want)), rel=1e-9)
    assert score_texts(empty, F.lit(False)).collect() == []
    alone = score_texts(frame(spark, [(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["score"] <= 0 for r in alone)


def test_pieces_are_binary_digits():
    assert binary_pieces(1) == [1]
    assert binary_pieces(2048) == [2048]
    assert binary_pieces(5000) == [2048, 2048, 512, 256, 128, 8]


def test_packing_holds_every_id_once(edges, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    whole = collections.Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [1])) for i, x in edge_rows())
    got = pack(edges, path).collect()
    assert len({r["sequence_id"] for r in got}) == len(got)
    pieces = collections.defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    for (i, ids), n in whole.items():
        mine = pieces[i, len(ids)]
        for at, x in mine:
            assert any(j == i and list(other[at : at + len(x)]) == x for j, other in whole)
        assert sum(len(x) for _, x in mine) == sum(len(o) * m for (j, o), m in whole.items() if j == i and len(o) == len(ids))
        assert n
    assert pack(empty, path).collect() == []


def test_special_tokens_and_unusual_words(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["It's dogs' café — naïve… İstanbul ΣΑΣ", "<|endoftext|>, a<|ENDOFTEXT|>. b", "don't, 3.14! abc123. \x1c a\x1cb 日本語. ẞ ŉ ǆ é", "x\xa0y   z", "…", "'s 'S ''s"]
    got = {r["doc_id"]: r for r in pack(frame(spark, list(enumerate(texts))), path).where("start = 0").collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x, add_special_tokens=False).ids + [1]
        assert got[i]["doc_tokens"] == len(ids)
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids[: got[i]["length"]]


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 300
    rows = [(1, "http://a/x y\r\nz", big), (2, None, big), (3, "http://b", "small"), (4, "http://c", "small"), (5, "http://d", None), (None, "http://e", "z" * 70_000), (9, "http://f", big), (9, "http://f", big)]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id bigint, url string, html string, file string")
    space = Workspace(spark)
    index = write_archives(pages, space)
    got = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"]), bytes(r["payload"]).decode()) for r in read_records(index, space.folder("warc")).collect())
    want = [("1", "revisit", "9", ""), ("2", "revisit", "9", ""), ("3", "response", "None", "small"), ("4", "response", "None", "small"), ("5", "response", "None", ""), ("9", "response", "None", big), ("9", "response", "None", big), ("None", "response", "None", "z" * 70_000)]
    assert got == want
    some = read_records(index.where("page_id = '3'"), space.folder("warc")).collect()
    assert [bytes(r["payload"]) for r in some] == [b"small"]
    none = Workspace(spark)
    assert read_records(write_archives(pages.limit(0), none), none.folder("warc")).collect() == []


def test_toxicity_on_held_out_rows(spark, empty):
    rng = random.Random(3)
    bad, rows, marks = ["moron", "scumbag", "worthless"], [(0, None), (1, "")], [(0, 0), (1, None), (1, 0)]
    for i in range(2, 900):
        w = prose(rng, rng.randint(5, 80))
        label = int(rng.random() < 0.3)
        if label:
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        marks.append((i, label))
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(*m, 1) for m in marks], "doc_id bigint, toxic int, quality int")
    model = toxicity.train(toxicity.labelled_texts(docs, labels))
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, model).collect()}
    truth = dict(marks)
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i in held) and len(held) > 150
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.97
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {i for i in got if not got[i]["predicted"]}
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    nothing = toxicity.train(toxicity.labelled_texts(empty, labels.limit(0)))
    assert [r["score"] for r in toxicity.toxicity_scores(frame(spark, [(1, "x")]), nothing).collect()] == [0.5]
    assert toxicity.toxicity_scores(empty, model).collect() == []


def test_reparameterised_questions(spark, edges, empty):
    rng = random.Random(9)
    tail = " ".join(prose(rng, 12))
    item = f"if Anna buys 12 apples and Bert takes 5 km of rope then Anna has 12 apples {tail}"
    other = f"if Zoe buys 40 apples and Kim takes 9 miles of rope then Zoe has 40 apples {tail}"
    broken = f"if Zoe buys 40 apples and Kim takes 9 miles of rope then Zoe has 77 apples {tail}"
    filler = lambda: " ".join(prose(rng, 25))
    rows = [(1, f"{filler()}. {filler()} {other} {filler()}"), (2, f"{filler()} {broken}"), (3, filler()), (4, None), (5, item.upper()), (6, " ".join(item.split()[3:9]))]
    bench = spark.createDataFrame([(10, "intro words here: " + item, 1), (11, None, 1), (12, "", 1), (13, "intro words here: " + item, 1), (14, "tiny item", 1)], "item_id bigint, text string, id int")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(frame(spark, rows), bench).collect()}
    assert (1, 10) in got and (2, 10) not in got
    assert not {i for i, _ in got} & {3, 4, 6}
    assert contaminated(empty, bench).collect() == []
    assert contaminated(edges, bench.limit(0)).collect() == []


def test_items_of_one_template_with_other_equal_slots(spark):
    far = "take {} red blocks out of the wooden box near the old door and then put {} blue blocks under the long table by the window"
    bench = frame(spark, [(1, far.format(5, 5)), (2, far.format(3, 4))]).withColumnRenamed("doc_id", "item_id")
    rows = [(1, far.format(3, 4)), (2, far.format(8, 9)), (3, far.format(7, 7)), (4, far.format(5, 6))]
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(frame(spark, rows), bench).collect()}
    assert got >= {(1, 2), (2, 2), (3, 1), (4, 2)} and not {(1, 1), (2, 1), (3, 2)} & got
    assert (4, 1) in got  # the item's own 5 among 13 tokens in a row


def test_names_that_open_sentences_and_other_case(spark):
    story = "{0} has 12 apples. {1} gives her 5 more. {0} eats 3 of them. {2} takes 2 away. How many are left?"
    inner = "if Anna and then Bert buy 12 apples while Cara keeps Dora away from the red door of Emil and Fred"
    bench = frame(spark, [(1, story.format("Anna", "Bert", "Cara")), (2, inner)]).withColumnRenamed("doc_id", "item_id")
    rows = [(1, story.format("Zoe", "Kim", "Lou")), (2, story.format("Anna", "Bert", "Cara").upper()), (3, inner.lower()), (4, inner.upper()), (5, story.format("Zoe", "Zoe", "Zoe"))]
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(frame(spark, rows), bench).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (4, 2)}


def test_preference_pairs(spark):
    turn = lambda *t: [{"role": r, "text": x} for r, x in t]
    u, a, b = ("user", "hi"), ("assistant", "yes"), ("assistant", "no!")
    rows = [(1, turn(u, a), turn(u, b)), (2, turn(u, a), turn(u, a)), (3, turn(a), turn(b)), (4, None, turn(u)), (5, turn(u, a, u), turn(u, a))]
    pairs = spark.createDataFrame(rows, "k int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r["k"]: r for r in format_pairs(pairs).collect()}
    assert got[1]["prompt"] == "<|user|>\nhi<|end|>\n" and got[1]["usable"]
    assert got[1]["chosen_text"] == "<|assistant|>\nyes<|end|>\n"
    s = got[1]["chosen_mask"][0]
    assert got[1]["chosen_text"][s["start"] : s["stop"]] == "yes<|end|>\n"
    assert got[2]["prompt_turns"] == 2 and not got[2]["usable"] and got[2]["chosen_text"] == ""
    assert got[3]["prompt_turns"] == 0 and got[3]["usable"]
    assert got[4]["prompt"] == "" and not got[4]["usable"]
    assert got[5]["prompt_turns"] == 2 and got[5]["chosen_text"] == "<|user|>\nhi<|end|>\n"


def test_licence_rules(spark, edges, empty):
    bsd = 'Redistribution and use in source and binary forms, with or without modification,\nare permitted provided that the following conditions are met:\n\n* Redistributions of source code must retain the above copyright notice, this\nlist of conditions and the following disclaimer.\n* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'
    rows = [(1, "words | here\nReleased under the MIT License.\nmore"), (2, "// SPDX-License-Identifier: Apache-2.0"), (3, "a license is a thing"), (4, None), (1, "words | here\nReleased under the MIT License.\nmore"), (5, "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n")]
    got = {tuple(r) for r in licence_hits(frame(spark, rows)).collect()}
    assert got == {(1, "MIT", "notice", 1), (2, "Apache-2.0", "notice", 1), (5, "Apache-2.0", "header", 3)}
    split = licence_hits(frame(spark, [(9, bsd.replace(":\n\n*", ".\n\n*"))])).collect()
    assert {r["licence"] for r in split} <= {"BSD-2-Clause"}
    assert licence_hits(empty).collect() == [] and licence_hits(edges).collect() == []


GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
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
BSD2 = """Copyright (c) 2020, Jo Doe

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
ISC = """ISC License

Copyright (c) 2020 Jo Doe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
"""
APACHE = """Copyright 2020 Jo Doe

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


def test_licence_texts_as_published(spark):
    mit = "MIT License\n\nCopyright (c) 2020 Jo Doe\n\n" + GRANT
    paragraphs = "Copyright (c) 2020 Jo Doe\n" + "\n".join(" ".join(p.split()) for p in GRANT.split("\n\n"))
    comment = "".join(f" * {x}\n" for x in ("/* x\n" + APACHE).split("\n"))
    rows = [(1, mit), (2, paragraphs), (3, " ".join(GRANT.split())), (4, BSD2 + BSD_END), (5, BSD2 + BSD3 + BSD_END), (6, " ".join((BSD2.split("\n\n", 1)[1] + BSD3).split())), (7, ISC), (8, APACHE), (9, comment), (10, GPL), (11, "it is not\nreleased under the MIT License today"), (12, "#!/bin/sh\r\n" + GRANT.replace("\n", "\r\n"))]
    got = {tuple(r) for r in licence_hits(frame(spark, rows)).collect()}
    text = lambda i, x, n: (i, x, "text", n)
    assert got == {text(1, "MIT", 3), text(2, "MIT", 3), text(3, "MIT", 3), text(4, "BSD-2-Clause", 3), text(5, "BSD-3-Clause", 4), text(6, "BSD-3-Clause", 4), text(7, "ISC", 1), (8, "Apache-2.0", "header", 3), (9, "Apache-2.0", "header", 3), (10, "GPL-3.0", "header", 2), text(12, "MIT", 3)}


def test_every_known_sentence_has_a_cue():
    for variants in SENTENCES.values():
        for v in variants:
            assert re.search(CUES, v.lower()), v


def test_more_licences_and_sentences_between(spark):
    gpl2 = GPL.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
    lgpl = gpl2.replace("program", "library").replace("General Public", "Lesser General Public", 1).replace("version 2 ", "version 2.1 ")
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    mixed = BSD2.split("2. ")[0] + "Released under the MIT License.\n\n2. " + BSD2.split("2. ")[1]
    rows = [(1, gpl2), (2, lgpl), (3, GPL.replace("GNU General", "GNU Affero General", 1)), (4, mpl), (5, mixed)]
    rows += [(6, "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.")]
    rows += [(7, "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n")]
    got = {(r["doc_id"], r["licence"], r["rule"]) for r in licence_hits(frame(spark, rows)).collect()}
    assert got == {(1, "GPL-2.0", "header"), (2, "LGPL-2.1", "header"), (3, "AGPL-3.0", "header"), (4, "MPL-2.0", "header"), (5, "BSD-2-Clause", "text"), (5, "MIT", "notice"), (6, "Unlicense", "text"), (7, "Zlib", "text")}


def brute_sentences(body, table):
    """Every known sentence at every word of a text, by the words of the docstring."""
    spans = [m.span() for m in re.finditer("[a-z0-9]+", body.lower())]
    lower = body.lower()
    found = []
    for i, (a, _) in enumerate(spans):
        before = body[spans[i - 1][1] if i else 0 : a]
        for sentence, sid in table:
            words = sentence.split(" ")
            j = i + len(words)
            if [lower[x:y] for x, y in spans[i:j]] != words:
                continue
            b = spans[j - 1][1]
            after = body[b : spans[j][0] if j < len(spans) else len(body)]

            def ends(at, gap, following):
                stop = re.search(r"[.!?;:]+\s", gap + (following or " "))
                blank = re.search(r"(\r\n|\r|\n)[^\r\n]*(\r\n|\r|\n)", gap)
                marker = any(at <= m.end() <= at + len(gap) for m in re.finditer(r"(?:^|[\r\n])[^A-Za-z0-9\r\n]*?(?:[-*\u2022]|\(?[A-Za-z0-9]{1,3}[.)])(?=\s)", body))
                line = re.search(r"[\r\n]", gap) and following and not following.islower()
                return bool(stop or blank or marker or line)

            first, last = i == 0, j == len(spans)
            opens = first or ends(a - len(before), before, body[a])
            closes = last or ends(b, after, None if last else body[spans[j][0]])
            alone = (first or re.search(r"[\r\n]", before)) and (last or re.search(r"[\r\n]", after)) and not re.search(r"[\r\n]", body[a:b])
            if opens and closes or alone:
                found.append((a, b, sid))
    kept = []
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
        elif x[1] - x[0] > kept[-1][1] - kept[-1][0]:
            kept[-1] = x
    return kept


def test_sentences_by_look_up_equal_every_sentence_at_every_word():
    rng = random.Random(12)
    table = sentence_table()
    pool = [v for x in SENTENCES.values() for v in x]
    glue = [" ", ". ", "; ", "\n", "\r\n", "\n\n", ": ", ", ", "\n * ", "\n1. ", " - ", ".", "\n# \n", " the ", "\nof ", "\u00c9. "]
    n = 0
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            x = rng.choice(pool)
            if rng.random() < 0.3:
                w = x.split(" ")
                k = rng.randrange(len(w))
                x = " ".join(w[:k]) + rng.choice(["\n", "\n// ", " x "]) + " ".join(w[k:])
            parts += [x, rng.choice(glue), rng.choice(["", "Some words", "more text here", "9"]), rng.choice(glue)]
        body = "".join(parts)
        got = _known(body, dict(table), lengths(table))
        assert got == brute_sentences(body, table), body
        n += len(got)
    assert n > 400 and _known("", dict(table), lengths(table)) == []


def test_every_rule_matches_its_own_sentences(spark):
    """A text of a rule's sentences, one a paragraph, has that rule or a longer one of which it is a part."""
    rows = [(i, ".\n\n".join(SENTENCES[s][0].rstrip(":") for s in ids) + "\n") for i, (_, _, ids) in enumerate(RULES)]
    got = {(r["doc_id"], r["licence"], r["rule"]) for r in licence_hits(frame(spark, rows)).collect()}
    assert {(i, a, b) for i, (a, b, _) in enumerate(RULES)} <= got


def test_licences_by_more_rules(spark):
    bsd4 = BSD2 + "\n3. All advertising materials mentioning features or use of this software must\n   display the following acknowledgement:\n   This product includes software developed by Jo Doe.\n" + BSD3.replace("3.", "4.") + BSD_END
    zero = ISC.replace("ISC License\n\n", "").replace("fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "fee is hereby granted.")
    lgpl3 = GPL.replace("GNU General", "GNU Lesser General", 1)
    apache = "   2. Grant of Copyright License. Subject to the terms and conditions of\n      this License, each Contributor hereby grants to You a perpetual,\n      worldwide, non-exclusive, no-charge, royalty-free, irrevocable\n      copyright license to reproduce, prepare Derivative Works of,\n      publicly display, publicly perform, sublicense, and distribute the\n      Work and such Derivative Works in Source or Object form.\n"
    gpl2 = "  The licenses for most software are designed to take away your\nfreedom to share and change it.  By contrast, the GNU General Public\nLicense is intended to guarantee your freedom to share and change free\nsoftware--to make sure the software is free for all its users.  This\nGeneral Public License applies to most of it.\n"
    rows = [(1, bsd4), (2, zero), (3, lgpl3), (4, apache), (5, gpl2), (6, "# SPDX-License-Identifier: BSD-3-Clause\n# code"), (7, "This work is licensed under CC BY-NC-SA 4.0."), (8, "This work is licensed under CC BY-NC-SA 4.0 or so")]
    got = {(r["doc_id"], r["licence"], r["rule"]) for r in licence_hits(frame(spark, rows)).collect()}
    assert got == {(1, "BSD-4-Clause", "text"), (2, "0BSD", "text"), (3, "LGPL-3.0", "header"), (4, "Apache-2.0", "text"), (5, "GPL-2.0", "text"), (6, "BSD-3-Clause", "notice"), (7, "CC-BY-NC-SA-4.0", "notice")}


def brute_templates(text):
    """For each reading the tokens (literal word, or kind) and slot values of a text, word by word."""
    out = []
    for names in range(3):
        tokens, opens, kind_before = [], True, None
        for line in text.split("\n"):
            opens = True
            for raw in line.split():
                word = raw.strip("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()))
                if not word:
                    continue
                proper = word[0].isupper() and not any(c.isdigit() for c in word) and any(c.islower() for c in word[1:])
                if any(c.isdigit() for c in word):
                    kind = 1
                elif kind_before == 1 and word.lower() in UNITS:
                    kind = 3
                elif proper and (names == 0 and not opens or names == 2 and (not opens or word.lower() not in OPENERS)):
                    kind = 2
                else:
                    kind = 0
                if kind and tokens and tokens[-1][0] == kind:
                    tokens[-1] = (kind, tokens[-1][1] + " " + word.lower())
                else:
                    tokens.append((kind, word.lower()))
                kind_before, opens = (1 if kind == 1 else 0), raw[-1] in ".!?:;"
        out.append(tokens)
    return out


def brute_holds(text, item):
    """Half an item's windows, or 13 tokens, on one diagonal with values one to one (readings 0 and 2 only)."""
    for reading in (0, 2):
        d, t = brute_templates(text)[reading], brute_templates(item)[reading]
        size = min(WINDOW, len(t))
        shape = lambda x: [w if k == 0 else k for k, w in x]
        windows = [p for p in range(len(t) - size + 1) if sum(k == 0 for k, _ in t[p : p + size]) >= max(1, size // 2)]
        diagonals = collections.defaultdict(list)
        for p in windows:
            for q in range(len(d) - size + 1):
                if shape(d[q : q + size]) == shape(t[p : p + size]):
                    diagonals[q - p].append(p)
        for gap, places in diagonals.items():
            pairs = {(d[p + gap + i][1], t[p + i][1]) for p in places for i in range(size) if t[p + i][0]}
            fits = len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
            covered = {p + i for p in places for i in range(size)}
            if fits and (len(places) >= 0.5 * len(windows) or len(covered) >= 13):
                return True
    return False


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_WINDOWS, 0])
def test_decontamination_against_loops(spark, monkeypatch, broadcast):
    """Made-up questions with lower-case words, with the benchmark's windows as a filter and without."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    rng = random.Random(21)
    names = ["Anna", "Bert", "Cara", "Dora", "Emil"]

    def question(words):
        return " ".join(rng.choice(names) if w == "N" else str(rng.randint(2, 99)) if w == "#" else w for w in words)

    shapes = [[rng.choice(["N", "#", *prose(rng, 6)]) for _ in range(rng.randint(6, 22))] for _ in range(8)]
    items = [(i, "so " + question(s)) for i, s in enumerate(shapes)]
    rows = []
    for k in range(60):
        s = list(rng.choice(shapes))
        for _ in range(rng.choice([0, 0, 1, 2])):
            s[rng.randrange(len(s))] = "changed"
        lead = " ".join(prose(rng, rng.randint(0, 12)))
        rows.append((k, f"{lead} so {question(s)} {' '.join(prose(rng, 5))}"))
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(frame(spark, rows), frame(spark, items).withColumnRenamed("doc_id", "item_id")).collect()}
    want = {(k, i) for k, t in rows for i, s in items if brute_holds(t, s)}
    assert want and want <= got
    # what is reported beyond that has the item's own values in the matched windows
    for k, i in got - want:
        text, item = dict(rows)[k], dict(items)[i]
        own = item.lower().split()
        assert any(" ".join(own[j : j + 4]) in text.lower() for j in range(len(own) - 3))


def test_template_classes_name_every_item(spark):
    shape = "take {} red blocks out of the wooden box near the old door and put {} under the table"
    bench = frame(spark, [(1, shape.format(5, 6)), (2, shape.format(3, 4)), (3, shape.format(3, 3)), (4, None), (5, "another question with nothing but eight words in it")]).withColumnRenamed("doc_id", "item_id")
    got = {(r["item_id"], r["class_id"]) for r in template_classes(bench).where("reading = 0").collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (5, 5)}
    held = contaminated(frame(spark, [(9, shape.format(7, 8))]), bench).collect()
    assert [(r["item_id"], r["n_items"]) for r in held] == [(1, 2)]


def grams(text):
    folded = b" " + re.sub(rb"[\t\n\x0b\f\r]", b" ", bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())) + b" "
    return {folded[i : i + n] for n in (3, 4, 5) for i in range(len(folded) - n + 1)}


def test_toxicity_counts_and_scores_against_loops(spark):
    """Log-count ratios and the choice of features from sets of n-grams, and scores from the fitted weights."""
    rng = random.Random(8)
    rows = [(i, " ".join(prose(rng, rng.randint(3, 20)) + (["scumbag"] if i % 3 == 0 else []))) for i in range(60)]
    rows += [(i, rows[0][1]) for i in range(100, 140)]  # repeated rows
    rows.append((200, " ".join(prose(rng, 60_000))))  # beyond the length that is counted by marks
    labels = [int(i % 3 == 0) for i, _ in rows]
    labelled = spark.createDataFrame([(t, y) for (_, t), y in zip(rows, labels, strict=True)], "body string, label int")
    model = toxicity.train(labelled)
    number = lambda g: int(toxicity.Rolling(np.frombuffer(g, np.uint8)).grams(len(g))[0] >> np.uint64(64 - toxicity.BITS))
    sets = [{number(g) for g in grams(t)} for _, t in rows]
    n = [labels.count(0), labels.count(1)]
    counts = [collections.Counter(), collections.Counter()]
    for s, y in zip(sets, labels, strict=True):
        counts[y].update(s)

    def ratio(f):
        return math.log((counts[1][f] + 1) / (n[1] + 2)) - math.log((counts[0][f] + 1) / (n[0] + 2))

    def gain(f):
        both = counts[0][f] + counts[1][f]
        return sum(counts[y][f] * math.log(max(counts[y][f], 1e-9) / max(both * n[y] / sum(n), 1e-9)) for y in (0, 1))

    chosen = model.features.tolist()
    assert len(chosen) == toxicity.CHOSEN and model.ratios == pytest.approx([ratio(f) for f in chosen])
    gains = {f: gain(f) for f in set(counts[0]) | set(counts[1])}
    rest = max(g for f, g in gains.items() if f not in set(chosen))
    assert min(gains.get(f, 0.0) for f in chosen) >= rest - 1e-9
    place = {f: k for k, f in enumerate(chosen)}
    docs = frame(spark, rows)
    for r in toxicity.toxicity_scores(docs, model).collect():
        text = dict(rows)[r["doc_id"]]
        v = {place[f] for f in {number(g) for g in grams(text)} if f in place}
        z = model.bias + sum(model.weights[k] * model.ratios[k] for k in v) / math.sqrt(sum(model.ratios[k] ** 2 for k in v) + 1)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z))) and r["predicted"] == int(r["score"] >= 0.3)


def test_weights_of_equal_rows():
    """A row with a weight is that many rows."""
    rng = np.random.default_rng(2)
    found = [np.unique(rng.integers(0, 20, 6)) for _ in range(12)]
    labels, times = (np.arange(12) % 2).astype(float), rng.integers(1, 4, 12)
    ratios = rng.normal(size=20)
    a = toxicity.fit_weights(found, labels, ratios, times.astype(float))
    index = np.repeat(np.arange(12), times)
    b = toxicity.fit_weights([found[i] for i in index], labels[index], ratios)
    assert a[0] == pytest.approx(b[0]) and a[1] == pytest.approx(b[1])


def test_conversations_and_swapped_answers(spark):
    """Ties and nulls in turns, repeated rows, null ids, extra columns; against plain lists."""
    rows = [(4, 0, "user", "hi"), (4, 1, "assistant", "a4"), (5, 0, "user", "hi"), (5, 1, "assistant", "a5"), (5, 2, "user", "bye"), (6, 0, "assistant", "a6"), (7, 0, "user", "only"), (8, 0, None, None), (8, 1, "assistant", "x"), (8, 1, "assistant", "x"), (None, 0, "assistant", "n")]
    table = spark.createDataFrame([(*r, "p", "c") for r in rows], "conv_id bigint, turn int, role string, text string, prompt string, chosen string")
    talks = conversations(table)
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in talks.collect()}
    assert got[8] == [("", ""), ("assistant", "x"), ("assistant", "x")] and got[None] == [("assistant", "n")] and len(got) == 6
    pairs = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["chosen"]], [(t["role"], t["text"]) for t in r["rejected"]]) for r in swapped_answers(talks).collect()}
    assert pairs[4] == (got[4], [got[4][0], ("assistant", "a5")]) and pairs[5] == (got[5][:2], [got[5][0], ("assistant", "a4")])
    assert pairs[6] == (got[6], []) and 7 not in pairs and pairs[None] == (got[None], [])
    none = swapped_answers(conversations(table.limit(0)))
    assert none.collect() == [] and format_pairs(none).collect() == []


def test_buckets_of_equal_lengths(spark, edges, tmp_path):
    """Written by length and read back: all pieces are there, each bucket has one length."""
    pieces = pack(edges, public_tokenizers.path("word_bpe_49k.json"))
    write_buckets(pieces, str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets"))
    assert back.count() == pieces.count()
    one = spark.read.parquet(str(tmp_path / "buckets" / "length=8")).collect()
    assert one and {len(r["ids"]) for r in one} == {32}


def test_pairs_with_columns_of_the_same_names_and_marks_in_texts(spark):
    turns = "array<struct<role:string,text:string>>"
    pairs = spark.createDataFrame([(1, [("user", "a<|end|>"), ("assistant", "x")], [("user", "a<|end|>"), ("assistant", "y")], "old")], f"k int, chosen {turns}, rejected {turns}, prompt string")
    r = format_pairs(pairs).first()
    assert r["prompt"] == "<|user|>\na<|end|><|end|>\n" and r["usable"]
    s = r["rejected_mask"][0]
    assert r["rejected_text"][s["start"] : s["stop"]] == "y<|end|>\n"
