"""Licence scan by sentence rules: normalised sentences become identifiers of known licence sentences, and the
sequence of identifiers in a text is matched against ordered rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import chunks, text_of

# fixed values: sentences of public licences and notices, by identifier
SENTENCES = {
    "mit-notice": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "SPDX-License-Identifier: MIT"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "apache-notice": ["Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "apache-use": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at"],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Released under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl-share": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "mpl-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "ccby-notice": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "ccbysa-notice": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0"],
    "ccbync-notice": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0"],
    "cc0-notice": ["Licensed under CC0 1.0", "Released under the CC0 1.0 license"],
    "gpl2-notice": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "Released under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "gpl2-share": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "lgpl-notice": ["SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later", "Licensed under the GNU Lesser General Public License, version 2.1"],
    "lgpl-share": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "lgpl-hope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "agpl-notice": ["SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later", "Licensed under the GNU Affero General Public License, version 3"],
    "agpl-share": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "unlicense-free": ["This is free and unencumbered software released into the public domain"],
    "unlicense-any": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "boost-notice": ["Distributed under the Boost Software License, Version 1.0", "SPDX-License-Identifier: BSL-1.0"],
    "boost-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "epl-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "SPDX-License-Identifier: EPL-2.0"],
    "mpl-obtain": ["If a copy of the MPL was not distributed with this file, You can obtain one at", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "bsd-disclaimer": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"],
    "bsd-advert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl3-notice": ["SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later", "Licensed under the GNU Lesser General Public License, version 3"],
    "lgpl3-share": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "apache-grant": ["Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"],
    "gpl3-preamble": ["The GNU General Public License is a free, copyleft license for software and other kinds of works"],
    "gpl2-preamble": ["The licenses for most software are designed to take away your freedom to share and change it"],
    "gpl2-contrast": ["By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users"],
    "lgpl-contrast": ["By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users"],
    "agpl-preamble": ["The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"],
    "mpl-grant": ["Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license:"],
    "wtfpl-copy": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"],
    "ccbyncsa-notice": ["Licensed under CC BY-NC-SA 4.0", "This work is licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "ccbynd-notice": ["Licensed under CC BY-ND 4.0", "This work is licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "ccbyncnd-notice": ["Licensed under CC BY-NC-ND 4.0", "This work is licensed under CC BY-NC-ND 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
# fixed values: identifiers whose licences have no other notice above
SPDX = ["0BSD", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "EUPL-1.2", "ISC", "MPL-2.0", "Unlicense", "WTFPL", "Zlib"]
SENTENCES |= {f"spdx-{x.lower()}": [f"SPDX-License-Identifier: {x}"] for x in SPDX}
# fixed values: ordered rules (licence, identifiers in order)
RULES = [
    ("MIT", "notice", ["mit-notice"]),
    ("MIT", "text", ["mit-grant", "mit-condition", "as-is"]),
    ("ISC", "text", ["isc-grant"]),
    ("BSD-2-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("Apache-2.0", "notice", ["apache-notice"]),
    ("Apache-2.0", "header", ["apache-notice", "apache-use", "apache-copy"]),
    ("GPL-3.0", "notice", ["gpl3-notice"]),
    ("GPL-3.0", "header", ["gpl-share", "gpl-hope"]),
    ("MPL-2.0", "notice", ["mpl-notice"]),
    ("CC-BY-4.0", "notice", ["ccby-notice"]),
    ("CC-BY-SA-4.0", "notice", ["ccbysa-notice"]),
    ("CC-BY-NC-4.0", "notice", ["ccbync-notice"]),
    ("CC0-1.0", "notice", ["cc0-notice"]),
    ("GPL-2.0", "notice", ["gpl2-notice"]),
    ("GPL-2.0", "header", ["gpl2-share", "gpl-hope"]),
    ("LGPL-2.1", "notice", ["lgpl-notice"]),
    ("LGPL-2.1", "header", ["lgpl-share", "lgpl-hope"]),
    ("AGPL-3.0", "notice", ["agpl-notice"]),
    ("AGPL-3.0", "header", ["agpl-share", "gpl-hope"]),
    ("Unlicense", "text", ["unlicense-free", "unlicense-any"]),
    ("Zlib", "text", ["zlib-as-is", "zlib-grant"]),
    ("BSL-1.0", "notice", ["boost-notice"]),
    ("BSL-1.0", "text", ["boost-grant"]),
    ("EPL-2.0", "notice", ["epl-notice"]),
    ("MPL-2.0", "header", ["mpl-notice", "mpl-obtain"]),
    ("BSD-4-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse"]),
    ("0BSD", "text", ["0bsd-grant"]),
    ("LGPL-3.0", "notice", ["lgpl3-notice"]),
    ("LGPL-3.0", "header", ["lgpl3-share", "lgpl-hope"]),
    ("LGPL-3.0", "header", ["lgpl3-share", "gpl-hope"]),
    ("Apache-2.0", "text", ["apache-grant"]),
    ("GPL-3.0", "text", ["gpl3-preamble"]),
    ("GPL-2.0", "text", ["gpl2-preamble", "gpl2-contrast"]),
    ("LGPL-2.1", "text", ["gpl2-preamble", "lgpl-contrast"]),
    ("AGPL-3.0", "text", ["agpl-preamble"]),
    ("MPL-2.0", "text", ["mpl-grant"]),
    ("WTFPL", "text", ["wtfpl-copy"]),
    ("CC-BY-NC-SA-4.0", "notice", ["ccbyncsa-notice"]),
    ("CC-BY-ND-4.0", "notice", ["ccbynd-notice"]),
    ("CC-BY-NC-ND-4.0", "notice", ["ccbyncnd-notice"]),
    *((x, "notice", [f"spdx-{x.lower()}"]) for x in SPDX),
]
#: Every known sentence has one of the cue words, so texts without any are passed over.
CUES = "licen|permission|redistribut|provided|warranty|subject to|public domain|is free to copy|obtain one at|advertising materials"
#: Unknown sentences, and known ones of other rules, that may stand between two sentences of a rule.
GAP = 3


def sequence(ids: list[str]) -> str:
    """The pattern of a rule's identifiers in a text's sequence of them (>a>b>; | where too many unknown ones stand between)."""
    return ">" + f">([^|>]+>){{0,{GAP}}}".join(ids) + ">"


def normalise(s: str) -> str:
    return re.sub("[^a-z0-9]+", " ", s.lower()).strip()


def sentence_table() -> list[tuple[str, str]]:
    """(normalised sentence, identifier), each sentence once."""
    out = {}
    for name, variants in SENTENCES.items():
        for v in variants:
            out[normalise(v)] = name
    return sorted(out.items())


_WORD = re.compile("[a-z0-9]+")
_STOP = re.compile(r"[.!?;]+(?=\s|$)")
_COLON = re.compile(r":+(?=\s|$)")
_LINE = re.compile(r"[\r\n]+")
_ALNUM = re.compile("[A-Za-z0-9]")
#: A blank line (comment signs and list bullets don't fill a line), or the number or letter of a list item.
_BLANK = re.compile(r"(?:\r\n|\r|\n)[^A-Za-z0-9\r\n]*(?:\r\n|\r|\n)")
_LIST = re.compile(r"(?:^|[\r\n])[^A-Za-z0-9\r\n]*?(?:[-*\u2022]|\(?[A-Za-z0-9]{1,3}[.)])(?=\s)")


def lengths(table: list[tuple[str, str]]) -> dict[tuple[str, ...], list[int]]:
    """The numbers of words that the sentences with the same two words in front have."""
    out: dict[tuple[str, ...], set[int]] = {}
    for sentence, _ in table:
        words = sentence.split(" ")
        out.setdefault(tuple(words[:2]), set()).add(len(words))
    return {k: sorted(x) for k, x in out.items()}


#: What stands before a word: something that ends a sentence, a line break.
_END, _BREAK = 1, 2


def _gaps(body: str, lower: str) -> dict[int, int]:
    """What stands before the words of a text, by their starts, where anything does; the text's length stands for its end."""
    marks = dict.fromkeys((m.end() for m in _LINE.finditer(body)), _BREAK)
    for x in marks:
        if (m := _ALNUM.search(body, x)) and not m[0].islower():
            marks[x] |= _END
    for m in (m for x in (_STOP, _COLON, _BLANK, _LIST) for m in x.finditer(body)):
        marks[m.end()] = marks.get(m.end(), 0) | _END
    out, word = {}, -1
    for p in (0, *sorted(marks)):
        if p > word:
            m = _WORD.search(lower, p)
            word = m.start() if m else len(body)
        out[word] = out.get(word, 0) | marks.get(p, 0)
    out[len(body)] = _END | _BREAK
    first = _WORD.search(lower)
    if first:
        out[first.start()] = _END | _BREAK
    return out


def _known(body: str, table: dict[str, str], sizes: dict[tuple[str, ...], list[int]]) -> list[tuple[int, int, str]]:
    """(start, end, identifier) of the known sentences of a text, in order.

    A sentence begins and ends at the end of another, a colon, a blank line, a list marker, or a line break where the
    next line begins with a capital or a figure; one that is alone in its line ends there anyhow. Of two that overlap
    the longer stands. The text is cut once; a place where a sentence may begin takes one look-up of its first two words
    and one for each length that they allow, however many sentences are known.
    """
    lower = "".join(c if len(c) == 1 else " " for c in map(str.lower, body)) if len(body.lower()) != len(body) else body.lower()
    gaps = _gaps(body, lower)
    found = []
    for begin, mark in gaps.items():
        words = _WORD.finditer(lower, begin)
        run = [m for _, m in zip(range(2), words, strict=False)]
        for n in sizes.get(tuple(m[0] for m in run), ()) if mark else ():
            run += [m for _, m in zip(range(n + 1 - len(run)), words, strict=False)]
            sid = table.get(" ".join(m[0] for m in run[:n])) if len(run) >= n else None
            if sid:
                after = gaps.get(run[n].start() if len(run) > n else len(body), 0)
                alone = mark & after & _BREAK and not any(gaps.get(m.start(), 0) & _BREAK for m in run[1:n])
                if mark & after & _END or alone:
                    found.append((begin, run[n - 1].end(), sid))
    kept: list[tuple[int, int, str]] = []
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
        elif x[1] - x[0] > kept[-1][1] - kept[-1][0]:
            kept[-1] = x
    return kept


def _lines(table: list[tuple[str, str]]):
    known, sizes = dict(table), lengths(table)

    def unknown(between: str) -> int:
        pieces = [sum(bool(_ALNUM.search(p)) for p in x.split(between)) for x in (_STOP, _LINE)]
        return min(pieces)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "body"):
            rows, out = [], []
            for k, body in enumerate(batch.column(2).to_pylist()):
                line, end = ">", None
                for a, b, sid in _known(body, known, sizes):
                    line += ("|>" if end is not None and unknown(body[end:a]) > GAP else "") + sid + ">"
                    end = b
                if end is not None:
                    rows.append(k)
                    out.append(line)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(out, pa.string())], ["id", "fp", "line"])

    return lines


def licence_hits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs with a rule's match, licence and rule: id, licence, rule, n_sentences.

    Known sentences are found across line breaks (as in wrapped headers), between ends of sentences, colons, blank lines,
    list markers and line breaks, and make one sequence a text. Between two sentences of a rule at most GAP unknown ones
    (or lines, if they are fewer) and GAP known ones of other rules may stand. A rule whose sentences stand in
    a longer one matched in the text, in the same order, is left out. Null and empty texts match nothing; a null id stays null; rows that
    repeat an id give one row for each licence and rule.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("body")).where(F.lower("body").rlike(CUES))
    kind = docs.schema[id_column].dataType.simpleString()
    ordered = rows.select("id", F.xxhash64("body").alias("fp"), "body").mapInArrow(_lines(sentence_table()), f"id {kind}, fp bigint, line string")
    rules = F.broadcast(spark.createDataFrame([(a, b, ">" + ">".join(c) + ">", sequence(c), len(c)) for a, b, c in RULES], "licence string, rule string, pattern string, sequence string, n_sentences int"))  # fixed size
    found = ordered.join(rules, F.regexp_like("line", F.col("sequence"))).select("id", "fp", "licence", "rule", "pattern", "sequence", "n_sentences").distinct()
    best = found.groupBy("id", "fp").agg(F.collect_list(F.struct("licence", "rule", "pattern", "sequence", "n_sentences")).alias("all"))
    own = F.filter("all", lambda x: ~F.exists("all", lambda y: (y["n_sentences"] > x["n_sentences"]) & F.regexp_like(y["pattern"], x["sequence"])))
    return best.select("id", F.explode(own).alias("x")).select("id", "x.licence", "x.rule", "x.n_sentences").distinct().withColumnRenamed("id", id_column)
