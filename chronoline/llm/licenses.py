"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton holds every base phrase and every template.  A text's words stream
through it, which yields matching statistics (the longest suffix of the words so
far that stands somewhere in a template); maximal matches chain, in the order of
both text and template, into covered template spans.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import ALNUM, LOWER, Shipped, hash_spans, hash_word, sliced, text_bytes, word_spans

# Base phrases and short notices of public licences, by label.
BASE = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
_MIT = [
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
]
_BSD = [
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
]
_GPL = "you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation either version {version} of the license or at your option any later version"
TEMPLATES = {
    "agpl-3": ["gnu affero general public license version 3", _GPL.format(name="affero general public license", version=3)],
    "apache-2": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    ],
    "apache": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"],
    "bsd": [*_BSD, "licensed under the bsd 3 clause license", "licensed under the bsd 2 clause license"],
    "boost-1": ["boost software license version 1 0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"],
    "cc-by": ["creative commons attribution 4 0 international license", "licensed under cc by 4 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "cc0": ["cc0 1 0 universal public domain dedication"],
    "gpl-2": ["gnu general public license version 2", _GPL.format(name="general public license", version=2)],
    "gpl-3": ["gnu general public license version 3", _GPL.format(name="general public license", version=3)],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "lgpl": ["gnu lesser general public license version 3", "gnu lesser general public license version 2 1"],
    "mit": ["released under the mit license", *_MIT],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "subject to the terms of the mozilla public license v 2 0"],
    "proprietary": ["all rights reserved"],
    "unlicense": ["this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"],
}
#: Words of a match that counts towards a chain, words between two matches of a chain, and the share of a template that a chain must cover.
MIN_MATCH, MAX_GAP, COVER = 3, 24, 0.75


class Automaton:
    """Suffix automaton of several token sequences, with where each state's strings end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for s, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._extend(last, token, ends)
                ends[last].add((s, i + 1))
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            ends[self.link[v]] |= ends[v]
        self.ends = [tuple(sorted(e)) for e in ends]

    def _state(self, length: int, ends: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, token: int, ends: list) -> int:
        """The state of the strings of q that go through p; q itself where those are all."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, ends)
        self.next[clone], self.link[clone], self.link[q] = dict(self.next[q]), self.link[q], clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int, ends: list) -> int:
        if (q := self.next[last].get(token)) is not None:
            return self._split(last, q, token, ends)
        new = self._state(self.length[last] + 1, ends)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, self.next[p][token], token, ends)
        return new

    def step(self, state: int, length: int, token: int) -> tuple[int, int]:
        """State and matching statistic after one more token."""
        while state and token not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(token)
        return (0, 0) if to is None else (to, length + 1)


class Scanner:
    def __init__(self):
        names = [(k, v, True) for k, v in BASE.items()] + [(k, t, False) for k, v in TEMPLATES.items() for t in v]
        words = sorted({w for _, t, _ in names for w in t.split()})
        number = {w: i for i, w in enumerate(words)}
        hashes = np.array([hash_word(w.encode()) for w in words], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order.astype(np.int32)
        self.labels = [k for k, _, _ in names]
        self.sizes = [len(t.split()) for _, t, _ in names]
        self.base = [b for _, _, b in names]
        # How many numbers stand before each word of a template; a label with a version asks for all of them.
        dated = [re.search(r"-\d+$", k) is not None for k in self.labels]
        self.versions = [[0, *accumulate(int(d and w.isdigit()) for w in t.split())] for d, (_, t, _) in zip(dated, names)]
        self.automaton = Automaton([[number[w] for w in t.split()] for _, t, _ in names])
        # Base phrases that are suffixes of a state's strings: those that end with it, and those of its suffix links.
        a = self.automaton
        whole: list[set[int]] = [{s for s, e in a.ends[v] if self.base[s] and e == self.sizes[s] <= a.length[v]} for v in range(len(a.next))]
        for v in sorted(range(1, len(a.next)), key=lambda v: a.length[v]):
            whole[v] |= whole[a.link[v]] if a.link[v] else set()
        self.whole = [tuple(sorted(w)) for w in whole]
        self.whole[0] = ()

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers; -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], -1)

    def scan(self, numbers: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[str, int, int, float]]]:
        """Base places (phrase, first word) and covered spans (label, first, last word + 1, share of template) of one text."""
        known = numbers >= 0
        cuts = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]])))
        a = self.automaton
        places: list[tuple[int, int]] = []
        chains: dict[int, tuple[int, int, int, int, int]] = {}  # template: first word, last word + 1, template end, covered words and version numbers
        spans: list[tuple[str, int, int, float]] = []

        def close(s: int) -> None:
            lo, hi, _, covered, versions = chains.pop(s)
            if covered >= COVER * self.sizes[s] and versions == self.versions[s][-1]:
                spans.append((self.labels[s], lo, hi, covered / self.sizes[s]))

        def match(stop: int, state: int, length: int) -> None:
            """A match that cannot grow: words stop-length .. stop."""
            for s, e in a.ends[state]:
                n = min(length, e)
                if self.base[s] or n < min(MIN_MATCH, self.sizes[s]):
                    continue
                lo, t = stop - n, e - n
                if s in chains:
                    first, last, done, covered, versions = chains[s]
                    new = e - max(done, t)
                    if t >= done and lo >= last and lo - last <= MAX_GAP and new > 0:
                        chains[s] = (first, stop, e, covered + new, versions + self.versions[s][e] - self.versions[s][t])
                        continue
                    if lo >= last or n > covered:
                        close(s)
                    else:
                        continue
                chains[s] = (lo, stop, e, n, self.versions[s][e] - self.versions[s][t])

        for lo, hi in zip(cuts[::2].tolist(), cuts[1::2].tolist()):
            if hi - lo < MIN_MATCH:
                continue
            state = length = 0
            for i in range(lo, hi):
                was, had = state, length
                state, length = a.step(state, length, int(numbers[i]))
                if had >= MIN_MATCH and length <= had:
                    match(i, was, had)
                for s in self.whole[state]:
                    if length >= self.sizes[s]:
                        places.append((s, i + 1 - self.sizes[s]))
            if length >= MIN_MATCH:
                match(hi, state, length)
        for s in list(chains):
            close(s)
        return places, sorted(spans, key=lambda x: (x[1], x[2], x[0]))


_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, spans array<struct<label:string,start:long,stop:long,share:double>>, score double"
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("share", pa.float64())]))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base places, labels and covered template spans of every row.

    Base places are counted for all phrases, overlapping ones too.  score: 1 with a base
    place, else the largest covered share of a template (0 without any).  A null or empty
    text has no words, no labels and null first and last words.  Rows are taken one by one.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    given = Shipped(docs.sparkSession, Scanner())  # the templates above: fixed size

    def scan(batches):
        scanner = given.value
        for batch in batches:
            for piece in sliced(batch, "text"):
                raw, at = text_bytes(piece.column("text"))
                low = LOWER[raw]
                starts, stops, first = word_spans(low, at, ALNUM)
                numbers = scanner.numbered(hash_spans(low, starts, stops))
                found = [scanner.scan(numbers[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                base = [sorted({scanner.labels[s] for s, _ in p}) for p, _ in found]
                yield pa.record_batch(
                    [
                        piece.column("key"),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array([len(p) for p, _ in found], pa.int64()),
                        pa.array([min((i for _, i in p), default=None) for p, _ in found], pa.int64()),
                        pa.array([max((i for _, i in p), default=None) for p, _ in found], pa.int64()),
                        pa.array(base, pa.list_(pa.string())),
                        pa.array([sorted({*b, *(x[0] for x in s)}) for b, (_, s) in zip(base, found)], pa.list_(pa.string())),
                        pa.array([[dict(zip(("label", "start", "stop", "share"), x)) for x in s] for _, s in found], _SPAN),
                        pa.array([1.0 if p else max((x[3] for x in s), default=0.0) for p, s in found], pa.float64()),
                    ],
                    ["key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "spans", "score"],
                )

    return rows.mapInArrow(scan, f"key {rows.schema['key'].dataType.simpleString()}, {_SCHEMA}").withColumnRenamed("key", key)


def brute_base(words: list[str]) -> list[tuple[int, str]]:
    """Base places of one text by plain comparison, for tests."""
    return sorted((i, k) for k, t in BASE.items() for i in range(len(words)) if words[i : i + len(t.split())] == t.split())
