"""Licence scan with a generalised suffix automaton of licence tokens.

The automaton holds every run of words of every template (notices, grants and
short phrases below). Texts stream through it: at each word it gives the length
of the longest run ending there that occurs in some template (the matching
statistics) and where. Runs that cannot grow are the matches; matches of
``MIN_MATCH`` words or more are chained per template, in the order of both texts,
and the words they cover, as a share of the template, decide its label.
The base phrases are templates too: a phrase stands where the statistics end in a
run that has the phrase as suffix, so every place is counted.

A word can lie in a match of two words only if it stands in a word pair that some
template has. Pairs are tested for whole batches at once; only stretches of such
pairs go through the automaton, which changes no result.

Null text is empty: no words, no label, score 0. Rows are judged one by one, so
repeated rows get equal results; null doc_ids are kept. An empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm import words as W

MIN_MATCH = 4
#: Share of a template's words that chained matches must cover for its label.
COVERED = 0.7
#: Words that may be missing or added between chained matches.
GAP = 12

# The base phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Notices and grants as their licences publish them.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
               "compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
               "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the Software), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation, either version 3 of the License, "
            "or (at your option) any later version"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
             "Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
]
_OUT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, spans array<struct<label:string,start:long,end:long,covered:double>>")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def template_words(text: str) -> list[str]:
    return _WORD.findall("".join(c.lower() if c.isascii() else c for c in text))


class Automaton:
    """Generalised suffix automaton over sequences of word hashes."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for i, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                self.ends[last].add((number, i + 1))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:  # a suffix ends wherever the longer run does
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """The state of exactly the runs of ``p`` followed by ``symbol``."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:  # an earlier sequence has this run
            return self._split(last, symbol, self.next[last][symbol])
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, symbol, self.next[p][symbol])
        return new

    def statistics(self, symbols: list[int]) -> list[tuple[int, int]]:
        """(length, state) of the longest run that ends at each symbol."""
        out, state, length = [], 0, 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
            out.append((length, state))
        return out


class Scanner:
    """Templates, their automaton, and the pair filter."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        texts = [t for t, _ in phrases] + [t for _, t in templates]
        self.labels = [label for _, label in phrases] + [label for label, _ in templates]
        column = pa.array([" ".join(template_words(t)) for t in texts])
        sequences, pairs = [], []
        for group in W.words_of(column, W.ALNUM):
            for lo, hi in zip(group.bounds[:-1], group.bounds[1:]):
                sequences.append(group.hashes[0][lo:hi].tolist())
                pairs.append(W.sequence_hashes(group.hashes[0][lo:hi], 2))
        self.sizes = [len(s) for s in sequences]
        if min(self.sizes) < 2:
            raise ValueError("templates have two words at least")
        self.pairs = np.unique(np.concatenate(pairs))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.pairs >> np.uint64(48)).astype(np.int64)] = True
        self.automaton = a = Automaton(sequences)
        self.phrases = len(phrases)
        own = defaultdict(list)  # state of a phrase -> (phrase, words)
        for i in range(self.phrases):
            (_, state) = a.statistics(sequences[i])[-1]
            own[state].append((i, self.sizes[i]))
        self.phrases_at = []
        for state in range(len(a.next)):
            found, s = [], state
            while s > 0:
                found += own.get(s, [])
                s = a.link[s]
            self.phrases_at.append(found)

    def stretches(self, words: np.ndarray, doc: np.ndarray):
        """(from, to) of stretches all of whose word pairs some template has."""
        pair = W.sequence_hashes(words, 2)
        live = np.flatnonzero(self.maybe[(pair >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.pairs, pair[live]), len(self.pairs) - 1)
        live = live[(self.pairs[at] == pair[live]) & (doc[live] == doc[live + 1])]
        if not len(live):
            return []
        new = np.flatnonzero(np.diff(live, prepend=live[0] - 2) > 1)
        first, last = live[new], live[np.append(new[1:], len(live)) - 1]
        cut = [(a, b + 2) for a, b in zip(first.tolist(), last.tolist())]
        return cut

    def scan(self, words: np.ndarray, cuts: list[tuple[int, int]], base: int):
        """Base places (start, phrase) and covered spans of one text."""
        places, matches = [], defaultdict(list)
        for a, b in cuts:
            stats = self.automaton.statistics(words[a:b].tolist())
            for i, (length, state) in enumerate(stats):
                end = a - base + i + 1
                places += [(end - size, phrase) for phrase, size in self.phrases_at[state] if size <= length]
                ended = i + 1 == len(stats) or stats[i + 1][0] != length + 1
                if length >= MIN_MATCH and ended:
                    for template, there in self.automaton.ends[state]:
                        matches[template].append((end - length, end, there - length))
        spans = []
        for template, found in matches.items():
            if template >= self.phrases:
                spans += self.chain(template, sorted(found))
        return places, spans

    def chain(self, template: int, found: list[tuple[int, int, int]]):
        """Chains of matches in the order of text and template, with what share
        of the template they cover."""
        size, open_chains, spans = self.sizes[template], [], []
        for start, end, there in found:
            best = None
            for c in open_chains:  # [start, end, template end, covered]
                skip, jump = start - c[1], there - c[2]
                if -GAP <= min(skip, jump) and max(skip, jump) <= GAP and end > c[1] and there + end - start > c[2]:
                    if best is None or c[3] > best[3]:
                        best = c
            if best is None:
                open_chains.append([start, end, there + end - start, end - start])
            else:
                overlap = max(0, best[1] - start, best[2] - there)
                best[3] += max(0, end - start - overlap)
                best[1], best[2] = end, there + end - start
            still = [c for c in open_chains if c[1] >= start - GAP]
            spans += [c for c in open_chains if c[1] < start - GAP]
            open_chains = still
        return [(self.labels[template], s, e, min(1.0, covered / size)) for s, e, _, covered in spans + open_chains]


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, covered: float = COVERED) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (largest covered share, 1 for a base phrase) and
    the covered spans."""

    def task(batches):
        scanner = Scanner(phrases, templates)
        for batch in batches:
            for group in W.words_of(batch.column(1), W.ALNUM):
                n, bounds, words = len(group.counts), group.bounds, group.hashes[0]
                doc = np.repeat(np.arange(n), group.counts)
                cuts = defaultdict(list)
                for cut in scanner.stretches(words, doc):
                    cuts[int(doc[cut[0]])].append(cut)
                empty = (0, None, None, "", "", 0.0, [])
                rows = [empty] * n
                for i, own in cuts.items():
                    places, spans = scanner.scan(words, own, int(bounds[i]))
                    spans = sorted(set(s for s in spans if s[3] >= covered))
                    base = sorted({scanner.labels[p] for _, p in places})
                    every = sorted({*base, *(s[0] for s in spans)})
                    starts = [s for s, _ in places]
                    rows[i] = (len(places), min(starts, default=None), max(starts, default=None), ",".join(base),
                               ",".join(every), 1.0 if base else max((s[3] for s in spans), default=0.0),
                               [dict(zip(("label", "start", "end", "covered"), s)) for s in spans])
                span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())])
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(group.first, n), pa.array(group.counts, pa.int64()),
                     *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(task, _OUT)
