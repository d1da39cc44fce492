"""License scans by a generalised suffix automaton of license texts.

All templates and phrases are read, word by word, into one automaton of their factors. A text is streamed
through it once: at each word the automaton knows the longest run of words up to it that
occurs in any template (its matching statistics) and where. Long runs that can't be
extended are chained, in order, into spans of a template; a template's coverage is the share of its words in the best chain.

Base phrases are templates that must be found whole: each place where one ends is a
hit. A license notice gives its label if enough of it is covered.

Words are maximal runs of digits, letters a-z and characters from U+0080 on, after A-Z are
lower-cased. Defined cases: a null or wordless text has no words, no label and score 0;
null ids, repeated rows and further columns stay; an empty table gives an empty table.
The automaton's size is that of the templates, a parameter; a text is held once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Phrases and the labels of the places where they stand.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Opening and operative passages of well-known public license notices, and short grants that name them.
NOTICES = {
    "mit": [
        "released under the MIT license",
        "licensed under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "apache-2.0": [
        "licensed under the Apache License, Version 2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "gpl-notice": [
        "licensed under the GNU General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "bsd": [
        "licensed under the BSD license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc-by-nc": ["licensed under CC BY-NC", "licensed under a Creative Commons Attribution-NonCommercial"],
    "cc-by-sa": ["licensed under CC BY-SA", "licensed under a Creative Commons Attribution-ShareAlike"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}
#: Words of a run that counts in a chain, words of the text that may lie between two runs, coverage that gives a notice's label.
LEAST_RUN, GAP, COVERED = 3, 12, 0.8

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


class Automaton:
    """Factors of all templates. A state stands for the factors that end at the same places of the templates."""

    def __init__(self, templates: list[list[bytes]]):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [[]]
        self.sizes = [len(t) for t in templates]
        for number, template in enumerate(templates):
            last = 0
            for end, word in enumerate(template):
                last = self._extend(last, self.ids.setdefault(word, len(self.ids)))
                self.places[last].append((number, end))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.places[self.link[state]] += self.places[state]
        self.places = [sorted(set(p)) for p in self.places]

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(dict(arcs))
        self.link.append(link)
        self.length.append(length)
        self.places.append([])
        return len(self.next) - 1

    def _twin(self, p: int, q: int, word: int) -> int:
        """q, or a copy of it that holds only the factors no longer than p's with the word."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, self.link[q], self.next[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._twin(last, self.next[last][word], word)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._twin(p, self.next[p][word], word)
        return new

    def statistics(self, text: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(place, length, state) for each word of the text that ends a run of template words: the longest such run."""
        state = length = 0
        before = -2
        arcs, link, size = self.next, self.link, self.length
        for place, word in [(i, w) for i, w in enumerate(map(self.ids.get, text)) if w is not None]:
            if place != before + 1:
                state = length = 0
            before = place
            while state and word not in arcs[state]:
                state = link[state]
                length = size[state]
            state = arcs[state].get(word, 0)
            length = length + 1 if state else 0
            yield place, length, state


class Scanner:
    """Finds phrases and notices; templates are the phrases first, then the notices."""

    def __init__(self, phrases: dict[str, str] | None = None, notices: dict[str, list[str]] | None = None):
        phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
        self.labels = [*phrases.values(), *(label for label, texts in notices.items() for _ in texts)]
        templates = [words(t) for t in [*phrases, *(t for texts in notices.values() for t in texts)]]
        self.phrases = len(phrases)
        self.automaton = Automaton(templates)
        self.ends = self._phrase_ends(templates[: self.phrases])

    def _phrase_ends(self, phrases: list[list[bytes]]) -> list[list[int]]:
        """For each state: the phrases that its factors end with."""
        a = self.automaton
        ends: list[list[int]] = [[] for _ in a.next]
        for n, phrase in enumerate(phrases):
            state = 0
            for word in phrase:
                state = a.next[state][a.ids[word]]
            if phrase:
                ends[state].append(n)
        for state in sorted(range(1, len(a.next)), key=a.length.__getitem__):
            ends[state] += ends[a.link[state]]
        return ends

    def __call__(self, text: list[bytes]) -> tuple[list[tuple[int, int]], dict[int, tuple[float, int, int]]]:
        """Places (start, phrase), and for each template reached: coverage, first and last word of its best chain."""
        sizes, ends, places = self.automaton.sizes, self.ends, self.automaton.places
        found, runs = [], []
        last = (-2, 0, 0)
        for place, length, state in self.automaton.statistics(text):
            for n in ends[state]:
                if sizes[n] <= length:
                    found.append((place - sizes[n] + 1, n))
            if last[1] >= LEAST_RUN and not (place == last[0] + 1 and length == last[1] + 1):
                runs.append(last)
            last = (place, length, state)
        if last[1] >= LEAST_RUN:
            runs.append(last)
        spans: dict[int, tuple[float, int, int]] = {n: (1.0, s, s + sizes[n] - 1) for s, n in reversed(found)}
        chains: dict[int, list[list[int]]] = {}  # of a template: [covered words, last of template, first and last of text]
        for place, length, state in runs:
            for n, end in places[state]:
                if n < self.phrases:
                    continue
                open_ = [c for c in chains.get(n, ()) if place - length - c[3] < GAP]
                best = [min(length, end + 1), end, place - length + 1, place]
                for c in open_:
                    more = min(length, end - c[1], place - c[3])
                    if more > 0 and c[0] + more > best[0]:
                        best = [c[0] + more, end, c[2], place]
                # A chain goes only where any run that extends it covers more when it extends the best one.
                chains[n] = [*(c for c in open_ if best[1] > c[1] or best[0] - c[0] <= place - c[3]), best]
                share = best[0] / sizes[n]
                if share > spans.get(n, (0.0, 0, 0))[0]:
                    spans[n] = (share, best[2], place)
        return found, spans


SPANS = "spans array<struct<label:string,first_word:bigint,last_word:bigint,covered:double>>"
SCHEMA = f"n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, {SPANS}"


def scan(docs: DataFrame, text: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, list[str]] | None = None, covered: float = COVERED) -> DataFrame:
    """docs with, in place of the text: n_words, places of base phrases, labels, score (largest coverage of a template) and the covered spans; columns of docs with these names are replaced."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.float64())]))]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            rows = []
            for one in batch.column(batch.num_columns - 1).to_pylist():
                w = words(one)
                places, spans = scanner(w)
                base = {scanner.labels[n] for _, n in places}
                more = {scanner.labels[n] for n, s in spans.items() if s[0] >= covered}
                starts = [s for s, _ in places]
                kept = [{"label": scanner.labels[n], "first_word": a, "last_word": b, "covered": c} for n, (c, a, b) in sorted(spans.items()) if c >= covered]
                rows.append((len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), max((s[0] for s in spans.values()), default=0.0), kept))
            new = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], *names])

    docs = docs.drop(*(part.split()[0] for part in SCHEMA.replace(SPANS, "spans").split(", ")))
    others = docs.drop(text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others.schema), SCHEMA])
    return docs.select(*others.columns, text).mapInArrow(scanned, schema)
