"""Licence scans: an exact set-similarity join of text blocks with licence templates.

A block is any run of as many consecutive words as the template has (the whole text if it has fewer): line ends, wrapped or not, mean nothing, and words
scattered over a long text are no notice. A block meets a template if it holds at least `threshold` of the template's distinct words. The join finds every
such pair: template words are put in the order of their frequency over the whole corpus, rarest first; a block can only meet a template if it holds one
of the first few (prefix filter), has enough template words (length filter), and the words from its first common one on suffice (position
filter); what is left is counted. Words are looked up by hash for a whole batch, and verified in blocks that pass the filters.
Blocks that meet and overlap are one place, from the first word to the last.

Beside the templates, the places of fixed phrases are reported, as consecutive words of the text.

Defined results: null counts as empty text (no words, no labels, score 0); a template that shares its words with another is met along
with it; repeated rows are scanned each; other columns are not read. score: the best share of a template found in a block, 1 where a phrase stands.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Public licence notices: label and text.
TEMPLATES = (
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit-notice", "Released under the MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-header", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("gpl-3.0", "Licensed under the GNU General Public License, version 3"),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("all-rights-reserved", "All rights reserved"),
)
THRESHOLD = 0.8
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


def word_hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = C.spans_of(C.WORD_BYTE[data], np.array([0, len(data)]))
    return C.range_hash(C.BYTE_VALUE[data], starts, ends)


class Slice:
    """Words of some rows of a text column with their hashes and rows."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.low = C.LOWER[data]
        self.starts, self.ends, self.rows = C.spans_of(C.WORD_BYTE[self.low], offs)
        self.hashes = C.range_hash(C.BYTE_VALUE[self.low], self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.low[self.starts[i] : self.ends[i]].tobytes()


def slices(column: pa.Array):
    data, offs = C.text_buffer(column)
    for lo, hi in C.slices(offs):
        yield lo, hi, Slice(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])


def _lookup(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words whose hash is known, and the number of the hash."""
    small = np.zeros(1 << 16, bool)
    small[known & np.uint64(0xFFFF)] = True
    maybe = np.flatnonzero(small[hashes & np.uint64(0xFFFF)])
    at = np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)
    same = known[at] == hashes[maybe]
    return maybe[same], at[same]


def frequencies(docs: DataFrame, vocabulary: list[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many texts of the whole corpus each word of a (bounded) vocabulary stands."""
    hashes = word_hashes(vocabulary)
    order = np.argsort(hashes)
    known = hashes[order]

    def run(batches):
        for batch in batches:
            total = np.zeros(len(known), np.int64)
            for _, _, part in slices(batch.column(0)):
                at, which = _lookup(known, part.hashes)
                if len(at):
                    pairs = np.unique(part.rows[at] * len(known) + which)
                    total += np.bincount(pairs % len(known), minlength=len(known))
            have = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(order[have].astype(np.int64)), pa.array(total[have])], names=["word", "n"])

    counts = docs.select(text_col).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = {vocabulary[r.word]: r.n for r in counts.collect()}  # a row a template word
    return {w: found.get(w, 0) for w in vocabulary}


class Join:
    """Templates with their words in order of frequency."""

    def __init__(self, templates, phrases, counts: dict[bytes, int], threshold: float):
        self.labels = [label for label, _ in templates]
        self.widths = [len(words_of(text)) for _, text in templates]
        self.sets = [sorted({*words_of(text)}, key=lambda w: (counts.get(w, 0), w)) for _, text in templates]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.vocabulary = sorted({w for own in self.sets for w in own})
        hashes = word_hashes(self.vocabulary)
        order = np.argsort(hashes)
        self.known, self.words = hashes[order], [self.vocabulary[i] for i in order]
        number = {w: i for i, w in enumerate(self.words)}
        #: For each template: the place of every word of the vocabulary in its order, or -1.
        self.rank = np.full((len(self.sets), len(self.words)), -1)
        for k, own in enumerate(self.sets):
            self.rank[k, [number[w] for w in own]] = np.arange(len(own))
        self.phrases = [(words_of(p), label) for p, label in phrases]
        self.phrase_hashes = [word_hashes(p) for p, _ in self.phrases]

    def blocks(self, part: Slice):
        """(row, template, best share, first word, words) of all places of the slice where blocks meet a template."""
        at, which = _lookup(self.known, part.hashes)
        for k, (width, need) in enumerate(zip(self.widths, self.need)):
            rank = self.rank[k][which]
            own = rank >= 0
            pos, rank, word = at[own], rank[own], which[own]
            if not len(pos):
                continue
            row = part.rows[pos]
            # Blocks that start at a template word: all others meet it no better. Those near the row's end are shorter.
            until = np.searchsorted(pos, pos + width)
            until = np.minimum(until, np.searchsorted(row, row, side="right"))
            first = np.arange(len(pos))
            prefix = np.concatenate([[0], np.cumsum(rank <= len(self.sets[k]) - need)])
            place: list = []
            for i in np.flatnonzero((until - first >= need) & (prefix[until] > prefix[first])).tolist():
                j = int(until[i])
                ranks = np.unique(rank[i:j])
                if len(self.sets[k]) - ranks[0] < need or len(ranks) < need:
                    continue
                true = {w for w in np.unique(word[i:j]).tolist() if any(part.word(int(p)) == self.words[w] for p in pos[i:j][word[i:j] == w])}
                if len(true) < need:
                    continue
                share, end = len(true) / len(self.sets[k]), int(pos[j - 1]) + 1
                if place and place[0] == row[i] and int(pos[i]) < place[3]:
                    place[1], place[3] = max(place[1], share), max(place[3], end)
                    continue
                if place:
                    yield place[0], k, place[1], place[2], place[3] - place[2]
                place = [int(row[i]), share, int(pos[i]), end]
            if place:
                yield place[0], k, place[1], place[2], place[3] - place[2]

    def places(self, part: Slice):
        """(row, label, first word) of every phrase."""
        for (words, label), hashes in zip(self.phrases, self.phrase_hashes):
            n = len(words)
            if len(part.hashes) < n:
                continue
            at = np.flatnonzero(part.hashes[: len(part.hashes) - n + 1] == hashes[0])
            for j in range(1, n):
                at = at[part.hashes[at + j] == hashes[j]]
            for i in at[part.rows[at] == part.rows[at + n - 1]].tolist():
                if [part.word(i + j) for j in range(n)] == words:
                    yield int(part.rows[i]), label, i


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: n_words, phrase places, labels, score and blocks (label, share, first word, words)."""
    vocabulary = sorted({w for _, text in templates for w in words_of(text)})
    join = Join(templates, phrases, frequencies(docs, vocabulary, text_col), threshold)
    docs = docs.select(F.col(id_col), F.col(text_col))
    kind = docs.schema[0].dataType.simpleString()

    def run(batches):
        C.enter("licenses")
        for batch in batches:
            rows = []
            for lo, hi, part in slices(batch.column(1)):
                counts = np.bincount(part.rows, minlength=hi - lo)
                first = np.cumsum(counts) - counts
                places: dict[int, list] = {}
                blocks: dict[int, list] = {}
                for row, label, i in join.places(part):
                    places.setdefault(row, []).append((i - int(first[row]), label))
                for row, k, share, i, n in join.blocks(part):
                    blocks.setdefault(row, []).append({"label": join.labels[k], "share": share, "first_word": i - int(first[row]), "words": n})
                for row in range(hi - lo):
                    own, met = places.get(row, []), blocks.get(row, [])
                    base = {label for _, label in own}
                    rows.append((int(counts[row]), len(own), min(own)[0] if own else None, max(own)[0] if own else None, ",".join(sorted(base)), ",".join(sorted(base | {x["label"] for x in met})), 1.0 if own else max((x["share"] for x in met), default=0.0), met))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("share", pa.float64()), ("first_word", pa.int64()), ("words", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds))], names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    return docs.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, blocks array<struct<label:string,share:double,first_word:bigint,words:bigint>>")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents")).drop("blocks")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)


ORACLE_SQL = f"""
with docs as (select row_number() over () as rid, doc_id, {_LOWER.format("coalesce(text, '')")} as text from documents),
words as (select rid, doc_id, text, {_WORDS.format('text')} as w from docs),
phrases(p, label) as (values {_values(PHRASES)}),
places as (select rid, label, i - 1 as pos from (select rid, w, string_split(p, ' ') as p, label, unnest(range(1, len(w) - len(string_split(p, ' ')) + 2)) as i from words, phrases where len(w) >= len(string_split(p, ' ')) and contains(text, 'license')) where w[i : i + len(p) - 1] = p),
base as (select rid, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, string_agg(distinct label, ',' order by label) as base_labels, list(distinct label) as ls from places group by rid),
templates(label, t) as (values {_values(TEMPLATES)}),
template_words as (select label, count(*) over (partition by label) as size, word from (select distinct label, unnest({_WORDS.format(_LOWER.format('t'))}) as word from templates)),
widths as (select label, len({_WORDS.format(_LOWER.format('t'))}) as width from templates),
spoken as (select rid, w[i] as word, i as pos from (select rid, w, unnest(range(1, len(w) + 1)) as i from words)),
held as (select rid, label, size, width, word, pos from spoken join template_words using (word) join widths using (label)),
met as (select a.rid, a.label, a.pos, count(distinct b.word) / a.size as share from held a join held b on b.rid = a.rid and b.label = a.label and b.pos between a.pos and a.pos + a.width - 1 group by a.rid, a.label, a.pos, a.size having count(distinct b.word) * 5 >= a.size * 4),
method as (select rid, list(distinct label) as ls, max(share) as share from met group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word, coalesce(base_labels, '') as base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(method.ls, [])))), ',') as labels, case when n_base > 0 then 1.0 else coalesce(share, 0.0) end as score
from words left join base using (rid) left join method using (rid)
"""

QUERIES = {"op10_licenses": op10_licenses}
ORACLE = {"op10_licenses": ORACLE_SQL}
