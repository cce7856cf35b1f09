"""Licence scan with a generalised suffix automaton over the words of templates.

A document streams through the automaton, which gives its matching statistics: at
each word, how many words up to it occur together in some template. Matches that
cannot be extended are chained per template, in order in both texts, into covered
spans. Phrases are templates too; every place of a phrase is found on the way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Phrases and their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
# Public licence notices, as word sequences.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in "
     "compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("unless required by applicable law or agreed to in writing software distributed under the license "
     "is distributed on an as is basis without warranties or conditions of any kind", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files the software to deal in the software without restriction", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse "
     "or promote products derived from this software without specific prior written permission", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee "
     "is hereby granted", "isc"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license as published by the free software foundation", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("no rights reserved licensed under cc0 1 0 universal", "cc0"),
)
SHORTEST_MATCH = 3
LARGEST_GAP = 16
LEAST_COVERED = 0.75
# Lower-cases A-Z, keeps digits, letters and bytes from 0x80; the rest separates words.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32
              for b in range(256))


def words_of(body: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lower-cased."""
    return body.translate(_FOLD).split()


@dataclass
class Automaton:
    """States of the generalised suffix automaton; 0 is the root."""
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    longest: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, longest: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.longest.append(longest)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, at: int, word: int, target: int) -> int:
        """A copy of ``target`` for the strings that end at most one word after ``at``."""
        copy = self._state(self.longest[at] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _append(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.longest[known] == self.longest[last] + 1 else self._split(last, word, known)
        new, at = self._state(self.longest[last] + 1, 0, {}), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            target = self.next[at][word]
            self.link[new] = (target if self.longest[target] == self.longest[at] + 1
                              else self._split(at, word, target))
        return new

    def add(self, number: int, words: Sequence[int]) -> None:
        last = 0
        for end, word in enumerate(words, 1):
            last = self._append(last, word)
            self.ends[last].append((number, end))

    def close(self) -> None:
        """Every state learns all places (template, end) of its strings."""
        for state in sorted(range(1, len(self.link)), key=self.longest.__getitem__, reverse=True):
            self.ends[self.link[state]].extend(self.ends[state])
        self.ends[0] = []


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES, shortest: int = SHORTEST_MATCH,
                 gap: int = LARGEST_GAP, least: float = LEAST_COVERED):
        self.labels = [label for _, label in (*phrases, *templates)]
        self.n_phrases, self.shortest, self.gap, self.least = len(phrases), shortest, gap, least
        texts = [words_of(text.encode()) for text, _ in (*phrases, *templates)]
        self.sizes = [len(t) for t in texts]
        self.ids: dict[bytes, int] = {}
        coded = [[self.ids.setdefault(w, len(self.ids) + 1) for w in t] for t in texts]
        self.graph = Automaton()
        pairs = np.zeros((len(self.ids) + 1,) * 2, bool)
        for number, words in enumerate(coded):
            self.graph.add(number, words)
            pairs[words[:-1], words[1:]] = True
        self.graph.close()
        self.pairs = pairs
        # Phrases that a state's longest string ends with, all their words included.
        self.phrase_at = [[(n, end) for n, end in ends if n < self.n_phrases and end == self.sizes[n] <= longest]
                          for ends, longest in zip(self.graph.ends, self.graph.longest)]
        for state in sorted(range(1, len(self.phrase_at)), key=self.graph.longest.__getitem__):
            mine = dict(self.phrase_at[state])
            self.phrase_at[state] = list({**dict(self.phrase_at[self.graph.link[state]]), **mine}.items())

    def statistics(self, words: Sequence[int], offset: int = 0):
        """(position of the last word, matched words, state) for each word of a run."""
        move, link, longest = self.graph.next, self.graph.link, self.graph.longest
        state = length = 0
        for at, word in enumerate(words, offset):
            while state and word not in move[state]:
                state = link[state]
                length = longest[state]
            state = move[state].get(word, 0)
            length = length + 1 if state else 0
            yield at, length, state

    def scan(self, body: bytes | None):
        """(words, phrase places, spans): places are (phrase, first word), spans are
        (template, first word, word after the last, covered share)."""
        words = words_of(body or b"")
        if len(words) < 2:
            return len(words), [], []
        get = self.ids.get
        coded = np.fromiter((get(w, 0) for w in words), "int64", len(words))
        starts = np.flatnonzero(self.pairs[coded[:-1], coded[1:]])
        if not len(starts):
            return len(words), [], []
        places, matches = [], []
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            first, after = int(run[0]), int(run[-1]) + 2
            before = (0, 0, 0)
            for now in self.statistics(coded[first:after].tolist(), first):
                at, length, state = now
                for phrase, size in self.phrase_at[state]:
                    if size <= length:
                        places.append((phrase, at - size + 1))
                if before[1] >= self.shortest and length <= before[1]:
                    matches.append(before)
                before = now
            if before[1] >= self.shortest:
                matches.append(before)
        return len(words), sorted(places, key=lambda p: (p[1], p[0])), self.chain(matches)

    def chain(self, matches):
        """Best chains per template of matches in order in both texts, gaps bounded."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for at, length, state in matches:
            for number, end in self.graph.ends[state]:
                if number >= self.n_phrases and end >= length:
                    by_template.setdefault(number, []).append((at + 1 - length, end - length, length))
        spans = []
        for number, hits in by_template.items():
            hits.sort()
            size = self.sizes[number]
            best = []  # (covered, first word, word after the last) of the chain that ends at a hit
            for j, (text, place, length) in enumerate(hits):
                covered, first = length, text
                for i in range(j - 1, -1, -1):
                    t, p, n = hits[i]
                    if t + size + self.gap < text:
                        break
                    gap = text - t - n
                    if 0 <= gap <= self.gap and p + n <= place and best[i][0] + length > covered:
                        covered, first = best[i][0] + length, best[i][1]
                best.append((covered, first, text + length))
            spans += [(number, first, after, covered / size) for covered, first, after in best
                      if covered >= self.least * size]
        return self._disjoint(spans)

    @staticmethod
    def _disjoint(spans):
        """Per template, in order of their ends, spans that do not overlap; of those that
        share a start the one that covers most."""
        best: dict[tuple[int, int], tuple] = {}
        for span in spans:
            if span[3] > best.get(span[:2], (0, 0, 0, 0))[3]:
                best[span[:2]] = span
        kept, reached = [], {}
        for span in sorted(best.values(), key=lambda s: (s[2], s[0])):
            if span[1] >= reached.get(span[0], 0):
                kept.append(span)
                reached[span[0]] = span[2]
        return kept


_SCANNERS: dict[tuple, Scanner] = {}


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", phrases=PHRASES,
                  templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, ``places`` (label, word) of the phrases, ``spans`` (label, first, after,
    covered) of the templates, positions in words from 0.

    Null and empty texts have no words. Every row gives a row, also repeated ones.
    """
    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("after", pa.int64()),
                               ("covered", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (phrases, templates)
        scanner = _SCANNERS.get(key) or _SCANNERS.setdefault(key, Scanner(*key))
        labels = scanner.labels
        for batch in batches:
            found = [scanner.scan(b) for b in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([[{"label": labels[p], "word": w} for p, w in places]
                          for _, places, _ in found], place),
                pa.array([[{"label": labels[t], "first": a, "after": b, "covered": c} for t, a, b, c in spans]
                          for _, _, spans in found], span)],
                names=["doc_id", "n_words", "places", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(
        run, f"doc_id {kind}, n_words long, places array<struct<label:string,word:long>>, "
             "spans array<struct<label:string,first:long,after:long,covered:double>>")
