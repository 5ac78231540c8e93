"""License scans: an exact set-similarity join of text blocks with license templates, and a search for phrases.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z as a-z. Blocks are the lines of a text, and the text
as a whole, so that a notice that wraps over lines is met too; a line or text of more words than a template's span is cut
into windows of so many words, half of which the next window shares. A template's span is SPAN, doubled until half of it
holds the template's words, so that a notice of that length lies in one window wherever it begins. A block meets a
template if it has at least `percent` of the template's distinct words. The join is the usual filter chain, exact at each step:

* Global order. The templates' words are counted over all documents, rare to frequent.
* Prefix. Of a template's n words a block must have at least `need = ceil(percent * n / 100)`, so it has one of the
  template's `n - need + 1` rarest; only blocks around such a word are looked at.
* Length. A block of fewer than `need` distinct words of any template is dropped.
* Position. In the same order, a block whose first shared word is the template's i-th can share `n - i` at most.

The template and phrase tables are parameters of a fixed size, so they go to every task; documents never move.

A set has no order, so what the join finds is looked at once more: the block must have `percent` of the template's words
one behind the other as the template has them (a longest common subsequence), or words that are scattered over a sentence
would do. Of two templates that are met in places that overlap, one is passed over if all its words that its block has
are among those that the other's block has of the other one, and they are fewer, or a smaller part of it: a notice of the
lesser licence has the words of the plain one too, and one of version 3 nearly all of version 2's.

Defined cases: null or empty text has no words and no places; an empty table gives an empty result; repeated rows are
scanned alike. Other columns are not looked at; the results are named after doc_id only.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from exactdiff.llm.words import ALNUM, buffers, hashed

#: Phrases that are found wherever their words stand consecutively, and their labels. Fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices as licences and their steward's pages word them, and their labels. Fixed values.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "licensed under the gnu general public license version 2": "gpl-2",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu lesser general public license version 2 1": "lgpl-2.1",
    "licensed under the gnu lesser general public license version 3": "lgpl-3",
    "licensed under the gnu affero general public license version 3": "agpl-3",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by nd 4 0": "cc-by-nd-4.0",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-4.0",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd-4.0",
    "this work is licensed under a creative commons attribution license": "cc-by",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights": "cc0",
    "all rights reserved": "reserved",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits": "isc",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
}
#: The notice that the GNU licences ask for, by the words that differ, and their labels. Fixed values.
GNU = {("", "2"): "gpl-2", ("", "3"): "gpl-3", ("lesser", "2 1"): "lgpl-2.1", ("lesser", "3"): "lgpl-3", ("affero", "3"): "agpl-3"}
for (_kind, _version), _label in GNU.items():
    TEMPLATES[" ".join(f"you can redistribute it and or modify it under the terms of the gnu {_kind} general public license as published by the free software foundation either version {_version} of the license or at your option any later version".split())] = _label
#: Identifiers as they stand in SPDX tags, and their labels. Fixed values.
SPDX = {
    "mit": "mit", "apache 2 0": "apache-2.0", "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 1": "lgpl-2.1", "lgpl 3 0": "lgpl-3", "agpl 3 0": "agpl-3", "mpl 2 0": "mpl-2.0", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd",
    "isc": "isc", "unlicense": "unlicense", "cc0 1 0": "cc0", "cc by 4 0": "cc-by-4.0", "cc by sa 4 0": "cc-by-sa-4.0", "cc by nc 4 0": "cc-by-nc-4.0",
}
TEMPLATES |= {f"spdx license identifier {name}": label for name, label in SPDX.items()}
PERCENT = 90
SPAN = 16
_ROWS = 500


def _hashes(phrase: str) -> list[int]:
    raw = np.frombuffer(phrase.encode(), np.uint8)
    return hashed(raw, np.array([0, len(raw)]), ALNUM)[0].tolist()


class _Words:
    """The words of the phrases and templates, found among hashes by a table of 2**16 flags and a binary search."""

    def __init__(self, texts: list[str]) -> None:
        self.names = np.unique(np.array([h for t in texts for h in _hashes(t)], np.uint64))
        self.flag = np.zeros(1 << 16, bool)
        self.flag[(self.names >> np.uint64(48)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h of known words, and their numbers."""
        at = np.flatnonzero(self.flag[(h >> np.uint64(48)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.names, h[at]), len(self.names) - 1)
        ok = self.names[k] == h[at]
        return at[ok], k[ok]

    def number(self, phrase: str) -> list[int]:
        return np.searchsorted(self.names, np.array(_hashes(phrase), np.uint64)).tolist()


def word_counts(docs: DataFrame, words: _Words) -> np.ndarray:
    """How often each known word stands in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words.names), np.int64)
        for whole in batches:
            for lo in range(0, len(whole), _ROWS):
                h = hashed(*buffers(whole.column(0).slice(lo, _ROWS)), ALNUM)[0]
                total += np.bincount(words.find(h)[1], minlength=len(total))
        yield pa.RecordBatch.from_pydict({"word": pa.array(range(len(total)), pa.int32()), "n": pa.array(total)})

    found = docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").sum("n").collect()
    out = np.zeros(len(words.names), np.int64)
    for word, n in found:
        out[word] = n
    return out


def span_of(template: str) -> int:
    """The words of a window for a template."""
    span = SPAN
    while span // 2 < len(_hashes(template)):
        span *= 2
    return span


def _windows(i: int, a: int, b: int, span: int) -> list[tuple[int, int]]:
    """The blocks around word i of the words from a to b."""
    if b - a <= span:
        return [(a, b)]
    half = span // 2
    k = (i - a) // half
    return [(a + half * j, min(b, a + half * j + span)) for j in (k - 1, k) if j >= 0]


def reached(words: Iterable[int], masks: dict[int, int], n: int, target: int) -> int | None:
    """How many of some words it takes until their longest common subsequence with a template of n words, given as the
    places (bits) of each of its words, has the target's length; None if they never do."""
    rows = full = (1 << n) - 1
    for k, w in enumerate(words):
        if w in masks:
            hit = rows & masks[w]
            rows = ((rows + hit) | (rows - hit)) & full
            if n - rows.bit_count() >= target:
                return k + 1
    return None


class Scanner:
    """phrases and templates compiled for scanning; counts: of the words, by which templates' words are ordered."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str], percent: int, words: _Words, counts: np.ndarray) -> None:
        self.words, self.labels, self.percent = words, list(templates.values()), percent
        self.phrases = [(words.number(p), label) for p, label in phrases.items()]
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((words.names, counts))] = np.arange(len(counts))
        self.rank = rank
        self.sets, self.need = [], []
        self.masks: list[list[dict[int, int]]] = []  # forwards and backwards
        self.length = []
        self.span = [span_of(t) for t in templates]
        self.prefix: dict[int, list[tuple[int, int]]] = {}  # word -> (template, place in its order)
        for t, text in enumerate(templates):
            numbers = words.number(text)
            self.length.append(len(numbers))
            self.masks.append([{w: sum(1 << i for i, x in enumerate(some) if x == w) for w in set(numbers)} for some in (numbers, numbers[::-1])])
            order = sorted(set(numbers), key=lambda w: rank[w])
            need = math.ceil(percent * len(order) / 100)
            self.sets.append(frozenset(order))
            self.need.append(need)
            for place, w in enumerate(order[: len(order) - need + 1]):
                self.prefix.setdefault(w, []).append((t, place))
        self.spans = {w: sorted({self.span[t] for t, _ in found}) for w, found in self.prefix.items()}
        self.first = np.zeros(len(counts), bool)
        self.first[list(self.prefix)] = True

    def scan(self, raw: np.ndarray, at: np.ndarray) -> dict[str, list]:
        h, row, begin, _ = hashed(raw, at, ALNUM)
        n_rows = len(at) - 1
        first = np.searchsorted(row, np.arange(n_rows + 1))
        where, word = self.words.find(h)
        places: list[set] = [set() for _ in range(n_rows)]
        count = np.zeros(n_rows, np.int64)
        base: list[set] = [set() for _ in range(n_rows)]
        labels: list[set] = [set() for _ in range(n_rows)]
        score = [0.0] * n_rows
        known = np.full(len(h), -1, np.int64)
        known[where] = word
        for numbers, label in self.phrases:
            k = len(numbers)
            x = where[word == numbers[0]]
            x = x[x + k <= len(h)]
            for step in range(1, k):
                x = x[known[x + step] == numbers[step]]
            x = x[row[x] == row[x + k - 1]]
            for i, r in zip(x.tolist(), row[x].tolist()):
                places[r].add(i - first[r])
                base[r].add(label)
                labels[r].add(label)
                score[r] = 1.0
            count += np.bincount(row[x], minlength=n_rows)
        breaks = np.flatnonzero(raw == 10)
        done: set[tuple[int, int, int]] = set()
        met: dict[int, list[tuple[int, int, int, frozenset]]] = defaultdict(list)
        for i in where[self.first[word]].tolist():
            r = int(row[i])
            line = int(np.searchsorted(breaks, begin[i]))
            lo = max(int(at[r]), int(breaks[line - 1]) + 1 if line else 0)
            hi = min(int(at[r + 1]), int(breaks[line]) if line < len(breaks) else len(raw))
            a, b = int(np.searchsorted(begin, lo)), int(np.searchsorted(begin, hi))
            for block in {(*x, span) for span in self.spans[int(known[i])] for x in (*_windows(i, a, b, span), *_windows(i, int(first[r]), int(first[r + 1]), span))}:
                if block in done:
                    continue
                done.add(block)
                got = {int(x) for x in known[block[0] : block[1]] if x >= 0}
                for t in {t for w in got & self.prefix.keys() for t, place in self.prefix[w] if self.span[t] == block[2] and len(got) >= self.need[t] and len(self.sets[t]) - place >= self.need[t]}:
                    shared = self.sets[t] & got
                    if len(shared) < self.need[t]:
                        continue
                    run, n = known[block[0] : block[1]].tolist(), self.length[t]
                    target = math.ceil(self.percent * n / 100)
                    end = reached(run, self.masks[t][0], n, target)
                    if end is not None:
                        start = end - reached(reversed(run[:end]), self.masks[t][1], n, target)
                        met[r].append((t, block[0] + start, block[0] + end, shared))
        for r, some in met.items():
            for t, a, b, shared in some:
                over = lambda u, more: shared < more or (shared == more and len(self.sets[u]) < len(self.sets[t]))  # noqa: E731, B023
                if not any(over(u, more) for u, c, d, more in some if c < b and a < d):
                    labels[r].add(self.labels[t])
                    score[r] = max(score[r], len(shared) / len(self.sets[t]))
        ends = [(min(x), max(x)) if x else (None, None) for x in places]
        return {"n_words": np.diff(first).tolist(), "n_base": count.tolist(), "first_word": [x for x, _ in ends], "last_word": [x for _, x in ends],
                "base_labels": [",".join(sorted(x)) for x in base], "labels": [",".join(sorted(x)) for x in labels], "score": score}


_SCHEMA = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """doc_id; n_words; of the phrases n_base (places), first_word and last_word (the outermost), base_labels; labels
    (of phrases and templates); score (the largest share of a template's words in a block; 1 for a phrase)."""
    words = _Words([*phrases, *templates])
    scanner = Scanner(phrases, templates, percent, words, word_counts(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), _ROWS):
                b = whole.slice(lo, _ROWS)
                found = scanner.scan(*buffers(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(found[k], kind) for k, kind in _SCHEMA)], names=["doc_id", *(k for k, _ in _SCHEMA)])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
