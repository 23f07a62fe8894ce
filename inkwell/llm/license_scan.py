"""License scans through a positional index of rare license words.

Templates are license notices with a label and mandatory key phrases. Words
are runs of letters, digits and non-ASCII characters, A-Z lower-cased. The
scan has two passes over the texts:

1. Document frequencies of the templates' words, over all texts: partial
   counts per task, one sum per word. There are a few hundred words at most,
   whatever the corpus, so the result goes to the driver.
2. The index holds the template positions (postings) of each template's
   ``rare`` words of highest IDF. A text looks up every occurrence of an
   indexed word, which says where the template would begin (text position
   less template position). Where half of a template's postings meet with
   beginnings at most ``slack`` words apart, the notice may stand there, also
   with words inserted, left out or replaced. It is verified: an alignment
   within that band gives the most template words that stand there in order,
   of which there have to be ``least``; every mandatory key phrase has to stand
   there too, word for word and in the template's order. The score of a text is
   the best share of words in place.

Fixed base phrases are reported wherever their words stand consecutively.

Defined results: a null text is empty (no words, no labels, score 0); null
ids and repeated rows are kept as they are; all places with enough postings
are verified; a text of any length is held as its words, an alignment only as two
rows as wide as the band; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import map_arrow, text_of

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
RARE = 8
LEAST = 0.7
# words by which the beginnings that a notice's postings give may differ: these, or an eighth of its words
LOOSE = 2

# Fixed phrases and labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key_phrases: tuple[str, ...]


# Notices of public licenses.
TEMPLATES = (
    Template("mit", "released under the MIT License", ("mit license",)),
    Template("mit", "licensed under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
             "and associated documentation files (the \"Software\"), to deal in the Software without restriction",
             ("permission is hereby granted", "without restriction")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
             "fee is hereby granted", ("permission to use", "with or without fee is hereby granted")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
             "provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
             ("mozilla public license",)),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3",
             ("gnu general public license", "version 3")),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2",
             ("gnu general public license", "version 2")),
    Template("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
             "published by the Free Software Foundation", ("gnu general public license", "free software foundation")),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
             ("gnu lesser general public license",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License",
             ("creative commons attribution 4 0 international license",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights",
             ("to the extent possible under law", "waived all copyright")),
    Template("unlicense", "This is free and unencumbered software released into the public domain",
             ("free and unencumbered software",)),
)


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class Index:
    """Postings of the templates' rarest words, for given document frequencies."""

    def __init__(self, templates, frequency: dict[bytes, int], n_docs: int, rare: int = RARE):
        self.labels = [t.label for t in templates]
        self.words = [words_of(t.text) for t in templates]
        self.phrases = []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed, self.slack = [], []
        for t, (template, words) in enumerate(zip(templates, self.words)):
            idf = {w: math.log((1 + n_docs) / (1 + frequency.get(w, 0))) for w in words}
            chosen = set(sorted(idf, key=lambda w: (-idf[w], w))[:rare])
            n = 0
            for at, w in enumerate(words):
                if w in chosen:
                    self.postings[w].append((t, at))
                    n += 1
            self.needed.append((n + 1) // 2)
            self.slack.append(max(LOOSE, len(words) // 8))
            self.phrases.append(sorted(self._where(words, words_of(p)) for p in template.key_phrases))

    @staticmethod
    def _where(words: list[bytes], phrase: list[bytes]) -> tuple[int, list[bytes]]:
        for i in range(len(words) - len(phrase) + 1):
            if words[i:i + len(phrase)] == phrase:
                return i, phrase
        raise ValueError("a key phrase has to stand in its template")

    def scan(self, words: list[bytes], least: float) -> dict[str, float]:
        """Label to the best share of its template's words in place."""
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        postings = self.postings
        for p, w in enumerate(words):
            if w in postings:
                for t, at in postings[w]:
                    hits[t].append((p - at, at))
        found: dict[str, float] = {}
        for t, own in hits.items():
            if len(own) < self.needed[t]:
                continue
            for low, high in self._places(sorted(own), self.needed[t], self.slack[t]):
                share = self._verified(t, words, low - self.slack[t], high + self.slack[t], least)
                found[self.labels[t]] = max(share, found.get(self.labels[t], 0.0))
        return {label: share for label, share in found.items() if share >= least}

    @staticmethod
    def _places(hits: list[tuple[int, int]], needed: int, slack: int):
        """First and last beginning of each largest set of hits within ``slack``
        that has ``needed`` different postings; ``hits`` are sorted."""
        inside: Counter = Counter()
        a = b = 0
        while b < len(hits):
            grown = b
            while b < len(hits) and hits[b][0] <= hits[a][0] + slack:
                inside[hits[b][1]] += 1
                b += 1
            if b > grown and len(inside) >= needed:
                yield hits[a][0], hits[b - 1][0]
            # on to the next beginning that lets another hit in
            while b < len(hits) and hits[a][0] + slack < hits[b][0]:
                inside[hits[a][1]] -= 1
                if not inside[hits[a][1]]:
                    del inside[hits[a][1]]
                a += 1

    def _verified(self, t: int, words: list[bytes], low: int, high: int, least: float) -> float:
        """The share of the template's words in place with beginnings from ``low``
        to ``high``; 0 where a key phrase is missing or out of order."""
        at = 0
        for i, phrase in self.phrases[t]:
            at = max(at, low + i, 0)
            while at <= high + i and words[at:at + len(phrase)] != phrase:
                at += 1
            if at > high + i:
                return 0.0
            at += 1
        return in_place(self.words[t], words, low, high) / len(self.words[t])


def in_place(own: list[bytes], words: list[bytes], low: int, high: int) -> int:
    """The most words of ``own`` that stand in ``words`` in their order, the i-th of them
    between ``low + i`` and ``high + i``: longest common subsequence in a band."""
    width = high - low + 1
    # best[k]: with the text read up to place low + k (and i more) inclusive
    best = [0] * (width + 1)
    for i, w in enumerate(own):
        row, left = [], 0
        for k in range(width):
            p = low + i + k
            here = best[k + 1]                     # the word is left out
            if 0 <= p < len(words) and words[p] == w and best[k] + 1 > here:
                here = best[k] + 1
            left = max(left, here)
            row.append(left)
        # the band moves on by one word: place low + i is out of it
        best = [*row, row[-1]]
    return best[width]


def frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """Documents that hold each word of the (fixed, small) vocabulary, and all documents."""
    def count(batches):
        total, n = Counter(), 0
        for batch in batches:
            for text in batch.column("_text").to_pylist():
                total.update(vocabulary.intersection(words_of(text)))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([*total, None], pa.binary()), pa.array([*total.values(), n], pa.int64())],
                                         names=["word", "n"])

    rows = map_arrow(docs.select(text_of().alias("_text")), count, "word binary, n long")
    found = {bytes(r["word"]) if r["word"] is not None else None: r["n"]
             for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop(None, 0)


def scan(docs: DataFrame, templates=TEMPLATES, rare: int = RARE, least: float = LEAST, base=BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    vocabulary = {w for t in templates for w in words_of(t.text)}
    index = Index(templates, *frequencies(docs, vocabulary), rare)
    phrases: dict[bytes, list] = defaultdict(list)
    for phrase, label in base:
        first, *more = words_of(phrase)
        phrases[first].append((more, label))
    rows = docs.select("doc_id", text_of().alias("_text"))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
    schema = rows.select("doc_id", *[F.lit(None).cast(k).alias(n) for n, k in zip(names, (
        "long", "long", "long", "long", "string", "string", "double"))]).schema

    def one(text: str):
        words = words_of(text)
        # most texts have none of the index's and phrases' words
        places, base_labels = [], set()
        for p, w in enumerate(words):
            if w in phrases:
                for more, label in phrases[w]:
                    if words[p + 1:p + 1 + len(more)] == more:
                        places.append(p)
                        base_labels.add(label)
        found = index.scan(words, least)
        score = max([1.0 if base_labels else 0.0, *found.values()])
        return (len(words), len(places), min(places, default=None), max(places, default=None),
                ",".join(sorted(base_labels)), ",".join(sorted(base_labels | found.keys())), score)

    def run(batches):
        for batch in batches:
            out = list(zip(*map(one, batch.column("_text").to_pylist()))) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out, kinds)], names=["doc_id", *names])

    return map_arrow(rows, run, schema)
