"""Licence scan: an exact set-similarity join of text blocks with licence templates.

Blocks are all spans of a document's words that are twice as long as the template they are held
against.  A template matches a block where at least ``threshold`` of its distinct words occur in the
block (containment).  Words are ordered by their frequency in all documents, rarest first, and the
join is exact:

* prefix filter: of a template with n words of which m must be met, the n - m + 1 rarest must
  share a word with the document;
* length filter: the document must share at least m distinct words;
* positional filter: from a place on, the template words still to come must allow m in the block.

The block slides over the places of template words only, so a document costs its length once.
Documents without any prefix word, nearly all, are left after one set test.

Defined cases: a null text is an empty one; a very long text is scanned whole; a document shorter than
a span is one block; repeated rows are scanned alike; an empty table gives an empty result; ties in
frequency are ordered by the word; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migcheck.llm.shared import sliced

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

# Phrases that are looked up word by word, with their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Sentences and texts of well-known licences, with their labels.
TEMPLATES = {
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache": "Licensed under the Apache License, Version 2.0",
    "apache-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language '
    "governing permissions and limitations under the License.",
    "boost": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
    'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to '
    "prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met",
    "bsd-conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-sa": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "epl": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    "the above copyright notice and this permission notice appear in all copies.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
    "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files, to deal in the Software without restriction",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the '
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
    "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by "
    "any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely",
}

SCANNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "blocks",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("label", T.StringType()),
                        T.StructField("from_word", T.IntegerType()),
                        T.StructField("to_word", T.IntegerType()),
                        T.StructField("containment", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)


def words(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []  # lower() of bytes folds A-Z only


def frequencies(docs: DataFrame, templates: dict[str, str]) -> dict[bytes, int]:
    """In how many documents each template word occurs; one row for each word and task travels."""
    vocabulary = frozenset(w for t in templates.values() for w in words(t.encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()
        for batch in sliced(batches):
            for text in batch["text"].to_pylist():
                count.update(vocabulary.intersection(words(text)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"]
        )

    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, n long")
    found = counted.groupBy("word").agg(F.sum("n").alias("n")).collect()  # at most the templates' words
    return {w: 0 for w in vocabulary} | {bytes(r.word): r.n for r in found}


class Template:
    """A template's distinct words in global order, with the bounds of the join."""

    def __init__(self, label: str, text: str, order: dict[bytes, int], threshold: float):
        own = words(text.encode())
        self.label = label
        self.tokens = sorted(set(own), key=order.__getitem__)
        self.rank = {w: i for i, w in enumerate(self.tokens)}
        self.needed = max(1, math.ceil(threshold * len(self.tokens) - 1e-9))
        self.prefix = frozenset(self.tokens[: len(self.tokens) - self.needed + 1])
        self.span = 2 * len(own)

    def blocks(self, own: list[bytes], distinct: set[bytes]) -> Iterator[tuple[int, int, float]]:
        """(from, to, containment) of the matching blocks; those that start at consecutive words are one, with their best containment."""
        if len(distinct.intersection(self.rank)) < self.needed:
            return
        rank = self.rank
        last = max(0, len(own) - self.span)
        # a word enters the sliding block at one start and leaves it at another
        turns = []
        for at, w in enumerate(own):
            if w in rank:
                turns += [(max(0, at - self.span + 1), 1, rank[w]), (at + 1, -1, rank[w])]
        turns.sort()
        inside = [0] * len(self.tokens)
        met = best = first = 0
        left = len(turns) // 2
        begun = False
        for k, (start, change, word) in enumerate(turns):
            if start > last:
                break
            inside[word] += change
            met += (change > 0 and inside[word] == 1) - (change < 0 and inside[word] == 0)
            left -= change > 0
            if k + 1 < len(turns) and turns[k + 1][0] == start:
                continue
            if met >= self.needed:
                if not begun:
                    begun, first, best = True, start, 0
                best = max(best, met)
            elif begun:
                begun = False
                yield first, min(len(own), start - 1 + self.span), best / len(self.tokens)
            if not begun and met + left < self.needed:
                return
        if begun:
            yield first, min(len(own), last + self.span), best / len(self.tokens)


def phrase_places(own: list[bytes], joined: bytes) -> list[tuple[int, str]]:
    """(first word, label) of all places of the phrases; ``joined`` is ``own`` with single blanks around."""
    out = []
    for phrase, label in PHRASES.items():
        key = phrase.encode()
        if b" " + key + b" " in joined:
            parts = key.split(b" ")
            out += [(i, label) for i, w in enumerate(own) if w == parts[0] and own[i : i + len(parts)] == parts]
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """Rows of :data:`SCANNED`; ``blocks`` lists every block that meets the threshold.

    ``score`` is 1 where a phrase stands, else the largest containment found, else 0.
    """
    templates = TEMPLATES if templates is None else templates
    count = frequencies(docs, templates)
    order = {w: i for i, (w, _) in enumerate(sorted(count.items(), key=lambda x: (x[1], x[0])))}
    compiled = [Template(k, v, order, threshold) for k, v in templates.items()]
    rare = frozenset().union(*(t.prefix for t in compiled))

    def one(text: bytes | None) -> tuple:
        own = words(text)
        joined = b" " + b" ".join(own) + b" "
        places = phrase_places(own, joined)
        met = rare.intersection(own)
        distinct = set(own) if met else set()
        blocks = [(t.label, *b) for t in compiled if not met.isdisjoint(t.prefix) for b in t.blocks(own, distinct)] if met else []
        at = [p for p, _ in places]
        base = {label for _, label in places}
        return (
            len(own),
            len(at),
            min(at, default=None),
            max(at, default=None),
            ",".join(sorted(base)),
            ",".join(sorted(base | {b[0] for b in blocks})),
            1.0 if at else max((b[3] for b in blocks), default=0.0),
            [dict(zip(("label", "from_word", "to_word", "containment"), b)) for b in blocks],
        )

    block = pa.struct([("label", pa.string()), ("from_word", pa.int32()), ("to_word", pa.int32()), ("containment", pa.float64())])
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(block)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [(i, *one(t)) for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist())]
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=SCANNED.names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, SCANNED)
