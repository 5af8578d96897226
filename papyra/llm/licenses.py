"""License scans: matching statistics of every text against a generalised suffix automaton of licence wording."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from papyra.llm import bytesops as B
from papyra.llm.common import ship, text_rows

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Well-known sentences of public licences, by label.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0",
    "cc0": "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide this software is distributed without any warranty",
}


class SuffixAutomaton:
    """All substrings of several token sequences.

    ``ends[v]`` maps a sequence to an end position of state v's strings in it,
    and ``phrase[v]`` is the set of base phrases that are suffixes of them.
    """

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for k, seq in enumerate(sequences):
            last = 0
            for at, token in enumerate(seq):
                last = self._extend(last, token)
                self.ends[last].setdefault(k, at + 1)
        for v in sorted(range(1, len(self.len)), key=lambda v: -self.len[v]):
            for k, at in self.ends[v].items():
                self.ends[self.link[v]].setdefault(k, at)

    def _new(self, length: int, link: int, to: dict[int, int]) -> int:
        self.next.append(to)
        self.len.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.len) - 1

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        cur, p = self._new(self.len[last] + 1, 0, {}), last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.ends[clone] = {}
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def walk(self, tokens: list[int]):
        """Matching statistics: after each token the state and length of the longest suffix that is a substring."""
        v = length = 0
        for t in tokens:
            while v and t not in self.next[v]:
                v = self.link[v]
                length = self.len[v]
            if t in self.next[v]:
                v = self.next[v][t]
                length += 1
            yield v, length


class LicenseScanner:
    """Templates and base phrases as an automaton over the words that occur in them."""

    def __init__(self, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, min_match: int = 6, max_gap: int = 40, least: float = 0.5):
        templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
        self.min_match, self.max_gap, self.least = min_match, max_gap, least
        self.labels, self.sizes = list(templates), [len(t.split()) for t in templates.values()]
        words = sorted({w for t in [*templates.values(), *phrases] for w in t.split()})
        data, offsets = B.utf8(pa.array(words, pa.large_string()))
        hashes = B.range_hashes(data, offsets[:-1], offsets[1:])
        order = np.argsort(hashes)
        self.keys, self.words = hashes[order], [words[i].encode() for i in order]
        ids = {w.decode(): i for i, w in enumerate(self.words)}
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.keys & B.U(0xFFFF)).astype(np.int64)] = True
        spelled = [[ids[w] for w in p.split()] for p in phrases]
        self.auto = a = SuffixAutomaton([[ids[w] for w in t.split()] for t in templates.values()] + spelled)
        self.base, self.base_labels = [len(s) for s in spelled], list(phrases.values())
        own: dict[int, list[int]] = {}
        for k, s in enumerate(spelled):
            v, _ = list(a.walk(s))[-1]
            own.setdefault(v, []).append(k)
        self.phrases: list[tuple[int, ...]] = [()] * len(a.len)
        for v in sorted(range(1, len(a.len)), key=lambda v: a.len[v]):
            self.phrases[v] = (*own.get(v, ()), *self.phrases[a.link[v]])

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """For each text: words, base places, first and last of them, base labels, all labels, score."""
        w = B.Words(data, offsets, B.ALNUM)
        h = w.hashes(lower=True)
        near = np.flatnonzero(self.bits[(h & B.U(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[near]), len(self.keys) - 1)
        good = self.keys[at] == h[near]
        near, token = near[good], at[good]
        owner = np.searchsorted(w.first, near, "right") - 1
        # Runs of known words inside one text; one word alone is no long match, and seldom a phrase.
        cut = np.flatnonzero((np.diff(near) != 1) | (np.diff(owner) != 0)) + 1 if len(near) else np.zeros(0, np.int64)
        begin, end = np.concatenate([[0], cut]).astype(np.int64), np.concatenate([cut, [len(near)]]).astype(np.int64)
        long = end - begin >= min([2, *self.base])
        base: dict[int, list[tuple[int, int]]] = {}
        match: dict[int, list[tuple[int, int, int]]] = {}
        for i, j in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            d, p0 = int(owner[i]), int(near[i] - w.first[owner[i]])
            tokens = [t if self.words[t] == w.data[w.start[x] : w.end[x]].tobytes().lower() else -1 for t, x in zip(token[i:j].tolist(), near[i:j].tolist(), strict=True)]
            before = (0, 0)
            for k, (v, length) in enumerate([*self.auto.walk(tokens), (0, 0)]):
                if before[1] >= self.min_match and length != before[1] + 1:
                    match.setdefault(d, []).append((p0 + k, *before))
                before = (v, length)
                for x in self.phrases[v] if length else ():
                    if self.base[x] <= length:
                        base.setdefault(d, []).append((p0 + k + 1 - self.base[x], x))
        out = []
        for d, n in enumerate(w.count.tolist()):
            places = base.get(d, [])
            first, labels = [p for p, _ in places], {self.base_labels[x] for _, x in places}
            cover = self.chain(match.get(d, []))
            more = {self.labels[t] for t, c in cover.items() if c >= self.least}
            out.append((n, len(places), min(first, default=None), max(first, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), max(cover.values(), default=0.0)))
        return out

    def chain(self, matches: list[tuple[int, int, int]]) -> dict[int, float]:
        """The largest share of each template that a chain of matches covers, in the template's order and with small gaps."""
        state: dict[int, tuple[int, int, int]] = {}
        best: dict[int, int] = {}
        for end, v, length in matches:
            for t, stop in self.auto.ends[v].items():
                if t >= len(self.labels):
                    continue
                doc_end, to, covered = state.get(t, (-self.max_gap * 2, 0, 0))
                if end - length - doc_end > self.max_gap or stop <= to:
                    to, covered = 0, 0
                covered += stop - max(to, stop - length)
                state[t] = end, stop, covered
                best[t] = max(best.get(t, 0), covered)
        return {t: min(1.0, c / self.sizes[t]) for t, c in best.items()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: LicenseScanner | None = None) -> DataFrame:
    """Licence labels of every text; a null or empty one has no words, no label and a score of 0."""
    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(scanner or LicenseScanner())
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches):
        for b in batches:
            data, offsets = B.utf8(b.column("text"))
            for i, j, piece, off in B.pieces(data, offsets):
                columns = zip(*known.value.scan(piece, off), strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
