"""Licence scans: base phrases, and template spans from a generalised suffix automaton.

The templates are short public licence notices. One automaton holds the word sequences of all of
them. Texts are streamed through it: every word gets the length of the longest template substring
that ends there (its matching statistic). Maximal matches of ``LEAST`` or more words are chained in
template order with bounded gaps, and a chain that covers enough of a template gives its label.

Only words of the templates can take part in a match, so the automaton runs on stretches of at
least ``LEAST`` such words; the stretches are found by numpy on the hashes of all words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sigtide.llm.arrow import extended, map_arrow
from sigtide.llm.words import find_words, slices

# fixed values: base phrases and labels
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# fixed values: opening notices of public licences
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
           " software and associated documentation files (the \"Software\"), to deal in the"
           " Software without restriction, including without limitation the rights to use, copy,"
           " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use"
                " this file except in compliance with the License. You may obtain a copy of the"
                " License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2-short": "Licensed under the Apache License, Version 2.0",
    "mit-short": "Released under the MIT License",
    "mit-licensed": "This file is licensed under the MIT License",
    "gpl-3": "This program is free software: you can redistribute it and/or modify it under the"
             " terms of the GNU General Public License as published by the Free Software"
             " Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-3-short": "This work is licensed under the GNU General Public License, version 3",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are"
           " permitted provided that the following conditions are met",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0"
                " International License",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}
LEAST, GAP, COVER = 3, 4, 0.7
_SUFFIX = re.compile(r"-(?:short|licensed)$")


def words_of(text: str) -> list[str]:
    """Words of a text, A-Z lower-cased."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


class Automaton:
    """Generalised suffix automaton over integer tokens; states know where they first end."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (sequence, end) per state
        for s, tokens in enumerate(sequences):
            last = 0
            for i, token in enumerate(tokens):
                last = self._extend(last, token)
                self.ends[last].add((s, i + 1))
        # a state's substrings also end where those of the states it links from end
        for state in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):
            self.ends[self.link[state]] |= self.ends[state]

    def _add(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _clone(self, state: int, token: int, q: int) -> int:
        new = self._add(self.length[state] + 1)
        self.next[new], self.link[new] = dict(self.next[q]), self.link[q]
        self.link[q] = new
        while state >= 0 and self.next[state].get(token) == q:
            self.next[state][token] = new
            state = self.link[state]
        return new

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:  # another sequence has this prefix already
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, token, q)
        new, state = self._add(self.length[last] + 1), last
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state >= 0:
            q = self.next[state][token]
            self.link[new] = q if self.length[q] == self.length[state] + 1 else self._clone(
                state, token, q)
        return new

    def matches(self, tokens: list[int], least: int) -> list[tuple[int, int, int]]:
        """(start, length, state) of maximal matches of at least ``least`` tokens."""
        out, state, length = [], 0, 0
        for i, token in enumerate([*tokens, -1]):
            before = (i - length, length, state)
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(token, 0)
            length = length + 1 if state else 0
            if before[1] >= least and i + 1 - length > before[0]:
                out.append(before)
        return out


class Scanner:
    """Templates, phrases and automaton of a worker."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]) -> None:
        self.labels = [_SUFFIX.sub("", k) for k in templates]
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        sequences = [words_of(t) for t in templates.values()]
        every = sorted({w for s in sequences for w in s} | {w for p, _ in self.phrases for w in p})
        own = find_words(pa.array(every)).hashes
        order = np.argsort(own)
        self.hashes, self.ids = own[order], order
        number = {w: i for i, w in enumerate(every)}
        self.sizes = [len(s) for s in sequences]
        self.phrases = [(np.array([number[w] for w in p]), label) for p, label in self.phrases]
        self.automaton = Automaton([[number[w] for w in s] for s in sequences])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary number per word, -1 outside."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], -1)

    def covers(self, pieces: list[tuple[int, int, int]]) -> dict[str, float]:
        """Best covered share per label, over chains of one document's matches."""
        best: dict[str, float] = {}
        chains: dict[int, list[tuple[int, int, int]]] = {}  # template: (text end, end, covered)
        for start, length, state in pieces:
            for s, end in self.automaton.ends[state]:
                covered = length
                for text_end, t_end, so_far in chains.get(s, ()):
                    # the next match goes on in the template after a bounded gap in both
                    if 0 <= start - text_end <= GAP and 0 <= end - length - t_end <= GAP:
                        covered = max(covered, so_far + length)
                kept = [c for c in chains.get(s, ()) if start - c[0] <= GAP]
                chains[s] = [*kept, (start + length, end, covered)]
                label = self.labels[s]
                best[label] = max(best.get(label, 0.0), covered / self.sizes[s])
        return best

    def scan(self, texts: pa.Array) -> list[tuple]:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score) per text."""
        words = find_words(texts)
        number = self.numbers(words.hashes)
        n = words.n_docs
        places: list[list[int]] = [[] for _ in range(n)]
        base: list[set[str]] = [set() for _ in range(n)]
        for phrase, label in self.phrases:
            size = len(phrase)
            if len(number) < size:
                continue
            hit = words.doc[:len(number) - size + 1] == words.doc[size - 1:]
            for k, w in enumerate(phrase):
                hit &= number[k:len(number) - size + 1 + k] == w
            for at in np.flatnonzero(hit).tolist():
                d = int(words.doc[at])
                places[d].append(at - int(words.first[d]))
                base[d].add(label)
        # stretches of at least LEAST template words inside one document
        known = number >= 0
        cut = np.ones(len(number) + 1, bool)
        if len(number):
            cut[1:-1] = (known[1:] != known[:-1]) | (words.doc[1:] != words.doc[:-1])
        edge = np.flatnonzero(cut)
        long = np.flatnonzero((np.diff(edge) >= LEAST) & known[edge[:-1]]) if len(number) else []
        pieces: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        for a, b in zip(edge[:-1][long].tolist(), edge[1:][long].tolist(), strict=True) if len(
                number) else ():
            for start, length, state in self.automaton.matches(number[a:b].tolist(), LEAST):
                pieces[int(words.doc[a])].append((a + start, length, state))
        out = []
        for d, count in enumerate(words.counts.tolist()):
            cover = self.covers(pieces[d]) if pieces[d] else {}
            labels = base[d] | {label for label, c in cover.items() if c >= COVER}
            score = 1.0 if base[d] else max(cover.values(), default=0.0)
            at = places[d]
            out.append((count, len(at), min(at, default=None), max(at, default=None),
                        ",".join(sorted(base[d])), ",".join(sorted(labels)), score))
        return out


@cache
def _scanner(phrases: tuple, templates: tuple) -> Scanner:
    return Scanner(dict(phrases), dict(templates))


_FOUND = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long",
          "base_labels": "string", "labels": "string", "score": "double"}


def scan(docs: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES,
         templates: dict[str, str] = TEMPLATES, prefix: str = "") -> DataFrame:
    """The rows of ``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is 1 where a base phrase stands, else the largest covered share of a template.
    NULL texts count as empty: no words, NULL places, empty labels, score 0. Labels are distinct and
    sorted; repeated rows are scanned each. A new column whose name exists raises; choose a
    ``prefix``. Memory is that of one slice of texts.
    """
    names = [prefix + n for n in _FOUND]
    key = (tuple(phrases.items()), tuple(templates.items()))
    schema = extended(docs.schema, _FOUND, prefix)
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*key)
        for batch in batches:
            texts = batch.column(text)
            rows = [r for i, j in slices(texts) for r in scanner.scan(texts.slice(i, j - i))]
            added = [pa.array([r[k] for r in rows], types[kind])
                     for k, kind in enumerate(_FOUND.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added],
                                             [*batch.schema.names, *names])

    return map_arrow(docs, run, schema)
