"""License scan: positions of rare licence words propose places of licence templates, whose words and key phrases are then checked.

Words are maximal runs of digits, ASCII letters (lower-cased) and characters beyond ASCII. A template is a passage of a licence
with a label and key phrases that must stand in it. The weight of a word is its inverse document frequency over all documents
(plus one, so that no word is free). A template lies at an offset of a text with a share: the part of its weight whose words
stand there within ``slack`` of their place. A label is given where the share is at least ``least`` and all key phrases stand
within the template's stretch, ``slack`` words around it included.

The index holds, of each template, the (word, position) postings of its words of highest weight only: as many that a place
with the wanted share must hit two of them (one where the template is too short for two). A file looks up its words in that
index, which are its licence words of highest weight; each hit, less the position in the template, is a relative position, and
hits that meet at one offset, up to ``slack``, make a candidate. So nothing that reaches ``least`` is lost, and common words
are looked up only to weigh a candidate. All of it is done at once for the texts of an Arrow batch by numpy.

Plain phrases with labels of their own (``PHRASES``) count at all their places, with share 1, whatever the templates say.

The document frequencies are those of all documents, of the words of the templates only: one row per word, bounded by the
templates. Texts are read whole. No shuffle of texts.

Defined cases: a null or empty text has no words, no label, null places and score 0. Repeated rows and rows without doc_id give one row each.
Words are told apart by 64-bit hashes. Columns other than doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches
from .words import PUNCTUATION, Words, chunks


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]


#: Phrases that make a label wherever they stand.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices and opening passages of common licences, with phrases that none of their variants lacks.
TEMPLATES = (
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
             "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
             "sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "sublicense and or sell copies")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
             ("apache org licenses license 2 0",)),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
             "Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "version 3 of the license")),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
             "Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public license", "version 2 of the license")),
    Template("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
             ("gnu lesser general public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
             ("redistribution and use in source and binary forms", "conditions are met")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
             "copyright notice and this permission notice appear in all copies", ("with or without fee", "permission notice appear in all copies")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
    Template("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def hashes_of(words: list[str]) -> np.ndarray:
    return np.concatenate([w.hashes for w in chunks(pa.array([" ".join(words)]), gaps=PUNCTUATION)])


class Vocabulary:
    """The words of templates and phrases as numbers."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        own = [t.text for t in templates] + [p for t in templates for p in t.phrases] + list(phrases)
        words = sorted({w for x in own for w in words_of(x)})
        hashes = hashes_of(words)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.number = {words[k]: i for i, k in enumerate(order.tolist())}

    def of(self, text: str) -> np.ndarray:
        return np.array([self.number[w] for w in words_of(text)], np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def weights(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """1 + ln((documents + 1) / (documents with the word + 1)) of each word of the vocabulary, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vocabulary.hashes)
        counts = np.zeros(size + 1, np.int64)
        for batch in batches:
            for w in chunks(batch.column(0), lower=True, gaps=PUNCTUATION):
                known = vocabulary.find(w.hashes)
                at = np.flatnonzero(known >= 0)
                counts[:size] += np.bincount(np.unique(w.doc()[at].astype(np.int64) * size + known[at]) % max(size, 1), minlength=size)
                counts[size] += len(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(counts)], names=["word", "docs"])

    rows = small_batches(docs.select("text")).mapInArrow(run, "word long, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    counts = np.zeros(len(vocabulary.hashes) + 1)
    for r in rows.collect():
        counts[r["word"]] = r["docs"]
    return 1 + np.log((counts[-1] + 1) / (counts[:-1] + 1))


class Index:
    """Per template: all words with weights, the postings of its heaviest words, and how many of them a place must hit."""

    def __init__(self, vocabulary: Vocabulary, weight: np.ndarray, templates: tuple[Template, ...] = TEMPLATES, least: float = 0.75, slack: int = 3):
        self.vocabulary, self.templates, self.least, self.slack = vocabulary, templates, least, slack
        self.words = [vocabulary.of(t.text) for t in templates]
        self.phrases = [[vocabulary.of(p) for p in t.phrases] for t in templates]
        self.weights = [weight[w] for w in self.words]
        self.postings, self.needed = zip(*map(self._heaviest, self.weights)) if templates else ((), ())

    def _heaviest(self, own: np.ndarray) -> tuple[np.ndarray, int]:
        order = np.argsort(-own, kind="stable")
        sums, spare = np.cumsum(own[order]), (1 - self.least + 1e-8) * own.sum()
        for needed, most in ((2, own.max()), (1, 0.0)):
            if sums[-1] > spare + most:
                return order[:int(np.searchsorted(sums, spare + most, "right")) + 1], needed
        return order, 1

    def places(self, known: np.ndarray, doc: np.ndarray, begin: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and shares of the places of template k; ``begin`` are the borders of the documents among the words."""
        words, slack = self.words[k], self.slack
        order = np.argsort(known, kind="stable")
        ranked = known[order]

        def at(word: int) -> np.ndarray:
            return order[np.searchsorted(ranked, word):np.searchsorted(ranked, word, "right")]

        shifts, hits, span = np.arange(-slack, slack + 1), [], len(known) + 2 * (len(words) + slack) + 1
        for t in self.postings[k].tolist():
            p = at(words[t])
            offset = (p[:, None] - t + shifts).ravel() + len(words) + slack  # not negative
            hits.append(np.unique(np.repeat(doc[p].astype(np.int64), len(shifts)) * span + offset))
        keys, n = np.unique(np.concatenate(hits), return_counts=True)
        keys = keys[n >= self.needed[k]]
        d, offset = keys // span, keys % span - len(words) - slack
        first, last = begin[d], begin[d + 1]

        def within(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            low, high = np.maximum(low, first), np.minimum(high, last)
            i = np.searchsorted(p, low)
            return (i < len(p)) & (np.append(p, np.iinfo(np.int64).max)[i] < high)

        found = np.zeros(len(d))
        for t, (word, weight) in enumerate(zip(words.tolist(), self.weights[k].tolist())):
            found += weight * within(at(word), offset + t - slack, offset + t + slack + 1)
        share = found / self.weights[k].sum()
        good = share >= self.least - 1e-9
        for phrase in self.phrases[k]:
            good &= within(_phrase_starts(known, doc, phrase), offset - slack, offset + len(words) + slack - len(phrase) + 1)
        return d[good], share[good]


def _phrase_starts(known: np.ndarray, doc: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    n = len(known) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    start = np.flatnonzero(known[:n] == phrase[0])
    for j, word in enumerate(phrase.tolist()):
        start = start[(known[start + j] == word) & (doc[start + j] == doc[start])]
    return start


def _judged(w: Words, index: Index, phrases: dict[str, str]) -> list[pa.Array]:
    n, doc = len(w), w.doc()
    known = index.vocabulary.find(w.hashes)
    count, score = np.zeros(n, np.int64), np.zeros(n)
    first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    base: list[set[str]] = [set() for _ in range(n)]
    for phrase, label in phrases.items():
        start = _phrase_starts(known, doc, index.vocabulary.of(phrase))
        d, place = doc[start], start - w.word[doc[start]]
        np.add.at(count, d, 1)
        np.minimum.at(first, d, place)
        np.maximum.at(last, d, place)
        for i in np.unique(d).tolist():
            base[i].add(label)
    score[count > 0] = 1.0
    labels = [set(x) for x in base]
    some = np.flatnonzero(known >= 0)
    if len(some):
        for k, t in enumerate(index.templates):
            if np.isin(index.words[k][index.postings[k]], known[some]).any():
                d, share = index.places(known, doc, w.word, k)
                np.maximum.at(score, d, share)
                for i in np.unique(d).tolist():
                    labels[i].add(t.label)
    joined = [pa.array([",".join(sorted(x)) for x in sets], pa.string()) for sets in (base, labels)]
    return [pa.array(np.diff(w.word).astype(np.int64)), pa.array(count), pa.array(first, mask=count == 0), pa.array(last, mask=count == 0), *joined, pa.array(np.minimum(score, 1.0))]


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scanned(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES, least: float = 0.75, slack: int = 3) -> DataFrame:
    """Labels of every document: those of phrases, and those of templates besides; ``score`` is the best share of a place."""
    vocabulary = Vocabulary(templates, phrases)
    index = Index(vocabulary, weights(docs, vocabulary), templates, least, slack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in chunks(batch.column(1), lower=True, gaps=PUNCTUATION):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, len(w)), *_judged(w, index, phrases)], names=[x.split()[0] for x in SCANNED.split(", ")])

    return small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, SCANNED)
