"""License statements in documents: fixed phrases, and template passages found by a set-similarity join.

Templates are word sets. A text block is any run of up to ``STRETCH`` times a template's number
of words; it matches if it holds at least ``THRESHOLD`` of the template's distinct words
(containment). The join is exact: template words are ordered by their frequency over all
documents, rarest first; a matching block must hold one of the first m - needed + 1 of them
(prefix filter), must have ``needed`` words at all (length filter), and after the j-th word of
that order at most m - j can still be shared (positional filter). Only places that hold a prefix
word are looked at, each with the words around it.

Every match is a row of ``blocks``. Short templates of different licenses differ in a word or two,
so a match ``decides`` on its label only if it holds, of the template's words, all those that
``REQUIRED`` lists for the label (the words that name the license), and if no overlapping match that
does so for another label holds a larger share of its template, or as large a share of a longer one. At a place with several blocks over the
threshold, the best that holds the required words is reported, else the best.

Both passes (frequencies, then matches) read every text; nothing is shuffled but the frequencies
of template words, of which there are as many as the templates given have.

Defined cases: null and empty texts have no words and score 0; overlapping matches of one
template count as the best of them; overlapping matches of different labels that hold equally much
both decide; repeated rows are each reported; result columns replace document columns of the same name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haze.llm.common import ALNUM, LOWER, Words, chunks, text_buffers

THRESHOLD, STRETCH = 0.8, 1.5

#: Phrases that stand for a license wherever their words are consecutive.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Passages by which public licenses are recognised, with their labels.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike International License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("all-rights-reserved", "All rights reserved"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc0-1", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)

#: Words that a deciding block must hold where the template has them, by label: they name the license.
REQUIRED = {
    "mit": "mit",
    "apache-2": "apache 2",
    "gpl-3": "gnu 3",
    "gpl": "gnu",
    "lgpl": "gnu lesser",
    "agpl": "gnu affero",
    "unlicense": "unencumbered",
    "cc0-1": "waived",
    "cc-by-nc": "nc noncommercial",
    "cc-by-sa": "sa sharealike",
    "mpl-2": "mozilla public",
    "all-rights-reserved": "all rights reserved",
}


def _words(texts: pa.Array) -> tuple[Words, np.ndarray]:
    data, offsets = text_buffers(texts)
    words = Words(LOWER[data], offsets, ALNUM)
    return words, words.hashes(1)


class _Templates:
    """Templates as distinct word hashes in order of first use, and their phrases."""

    def __init__(self, templates, phrases, threshold: float, stretch: float):
        self.labels, self.sets, self.spans, self.needed, self.required = [], [], [], [], []
        for label, text in templates:
            _, h = _words(pa.array([text]))
            distinct = h[np.sort(np.unique(h, return_index=True)[1])]
            if len(distinct):
                self.labels.append(label)
                self.sets.append(distinct)
                self.spans.append(math.ceil(stretch * len(h)))
                self.required.append(np.intersect1d(distinct, _words(pa.array([REQUIRED.get(label, "")]))[1]))
                self.needed.append(math.ceil(threshold * len(distinct) - 1e-9))
        self.phrases = [(_words(pa.array([p]))[1], label) for p, label in phrases.items()]
        self.vocabulary = np.unique(np.concatenate([*self.sets, np.zeros(0, np.uint64)]))

    def ordered(self, counts: np.ndarray) -> None:
        """Put each template's words in order of frequency, rarest first."""
        self.sets = [s[np.lexsort((s, counts[np.searchsorted(self.vocabulary, s)]))] for s in self.sets]

    def index(self, h: np.ndarray) -> np.ndarray:
        """Place of each word in the vocabulary, -1 for other words."""
        if not len(self.vocabulary):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, -1)

    def base(self, h: np.ndarray, row: np.ndarray) -> list[tuple[np.ndarray, int, str]]:
        """(starts, words, label) of each phrase."""
        out = []
        for words, label in self.phrases:
            m, n = len(words), len(h) - len(words) + 1
            at = np.flatnonzero(h[:n] == words[0]) if n > 0 else np.zeros(0, np.int64)
            for i in range(1, m):
                at = at[(h[at + i] == words[i]) & (row[at + i] == row[at])]
            out.append((at, m, label))
        return out

    def matches(self, h: np.ndarray, row: np.ndarray) -> list[tuple[int, int, int, int, int, bool]]:
        """(row, template, start, words, template words held, are the required ones among them) of the best block at each place."""
        known, out = self.index(h), []
        hot = np.flatnonzero(known >= 0)
        if not len(hot):
            return out
        for t, words in enumerate(self.sets):
            m, needed, span = len(words), self.needed[t], self.spans[t]
            rank = np.full(len(self.vocabulary) + 1, -1)
            rank[np.searchsorted(self.vocabulary, words)] = np.arange(m)
            required = set(rank[np.searchsorted(self.vocabulary, self.required[t])].tolist())
            ranks = rank[known[hot]]
            mine = hot[ranks >= 0]
            ranks = ranks[ranks >= 0]
            prefix = mine[ranks <= m - needed]
            done = -1
            for p in prefix.tolist():
                if p < done:
                    continue
                # template words in reach of p, in its own text
                a, b = np.searchsorted(mine, (p - span + 1, p + span))
                near, r = mine[a:b], ranks[a:b]
                same = row[near] == row[p]
                near, r = near[same], r[same]
                if len(near) < needed or len(np.unique(r)) < needed:
                    continue
                best = (False, 0, 0, 0)
                for i in range(len(near)):
                    j = int(np.searchsorted(near, near[i] + span))
                    held = set(r[i:j].tolist())
                    if len(held) >= needed and (required <= held, len(held)) > best[:2]:
                        last = i + max(int(np.flatnonzero(r[i:j] == x)[0]) for x in held)
                        best = (required <= held, len(held), int(near[i]), int(near[last]) + 1)
                    if best[1] == m:
                        break
                if best[1]:
                    out.append((int(row[p]), t, best[2], best[3] - best[2], best[1], best[0]))
                    done = best[3]
        return out


def word_counts(docs: DataFrame, vocabulary: np.ndarray, text_col: str = "text") -> np.ndarray:
    """How often each word of the (small, given) vocabulary occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        known = shared.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for part in chunks(batch, text_col):
                _, h = _words(part.column(text_col))
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                total += np.bincount(at[known[at] == h], minlength=len(known))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["word", "c"])

    out = np.zeros(len(vocabulary), np.int64)
    if len(vocabulary):
        table = docs.select(text_col).mapInArrow(count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")).toArrow()
        out[table.column("word").to_numpy()] = table.column("c").to_numpy()
    return out


FOUND = "n_words long, base array<struct<label:string,start:long>>, blocks array<struct<label:string,start:long,words:long,containment:double,held:long,decides:boolean>>"


def _decide(blocks: list[dict]) -> None:
    """Of overlapping named matches with different labels, only those that hold the greatest share, then number, of words decide."""
    rank = lambda b: (b["containment"], b["held"])
    named = sorted((b for b in blocks if b["decides"]), key=lambda b: b["start"])
    most = max((b["words"] for b in named), default=0)
    beaten = []
    for i, b in enumerate(named):
        for other in named[i + 1:]:
            if other["start"] >= b["start"] + most:
                break
            if b["label"] != other["label"] and other["start"] < b["start"] + b["words"] and rank(b) != rank(other):
                beaten.append(min(b, other, key=rank))
    for b in beaten:
        b["decides"] = False


def license_blocks(docs: DataFrame, templates=TEMPLATES, phrases=None, threshold: float = THRESHOLD, stretch: float = STRETCH,
                   text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, base (phrase places) and blocks (best template matches, and whether they decide on a label)."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    given = _Templates(templates, PHRASES if phrases is None else phrases, threshold, stretch)
    given.ordered(word_counts(docs, given.vocabulary, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(given)
    types = T._parse_datatype_string(FOUND)
    rows = docs.drop(*types.names)
    schema = T.StructType([*rows.schema.fields, *types.fields])
    arrow = [pa.int64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())])),
             pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("containment", pa.float64()), ("held", pa.int64()),
                                  ("decides", pa.bool_())]))]

    def run(batches):
        known = shared.value
        for batch in batches:
            for part in chunks(batch, text_col):
                words, h = _words(part.column(text_col))
                base: list[list] = [[] for _ in range(words.rows)]
                blocks: list[list] = [[] for _ in range(words.rows)]
                for at, _, label in known.base(h, words.row):
                    for r, p in zip(words.row[at].tolist(), (at - words.first[words.row[at]]).tolist(), strict=True):
                        base[r].append({"label": label, "start": p})
                for r, t, start, n, held, named in known.matches(h, words.row):
                    blocks[r].append({"label": known.labels[t], "start": start - int(words.first[r]), "words": n,
                                      "containment": held / len(known.sets[t]), "held": held, "decides": named})
                for found in blocks:
                    _decide(found)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(words.count, arrow[0]), pa.array(base, arrow[1]), pa.array(blocks, arrow[2])], names=schema.names)

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    labels = lambda *x: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda y: y["label"]) for c in x]))), ",")
    starts = F.transform("base", lambda x: x["start"])
    found = found.withColumn("blocks", F.filter("blocks", lambda x: x["decides"]))
    best = F.coalesce(F.array_max(F.transform("blocks", lambda x: x["containment"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), labels("base").alias("base_labels"), labels("base", "blocks").alias("labels"),
                        F.when(F.size("base") > 0, 1.0).otherwise(best).alias("score"))
