"""License scan: matching statistics of a generalised suffix automaton, chained into template spans.

The automaton holds every run of words of the license templates.  Streaming a text through it gives,
at each word, the longest run ending there that some template contains (the matching statistics);
the suffix links name the shorter runs of the other places.  Runs of at least ``LEAST_MATCH`` words
that cannot be extended are chained per template, in order and with at most ``MOST_GAP`` words
between them, so that a chain covers as many words of its template as any chain could: a run that
fits worse is left out, and one that overlaps the run before it is cut.  A chain's span carries the
share of its template that it covers, and from ``COVER`` on the template's label.  The base phrases
are templates too: wherever one stands in full, the automaton's state says so.

Only stretches whose every pair of neighbours occurs in some template can hold a run of two words or
more, so numpy cuts those out first and just they are streamed.

Null or empty text: no words, no labels, score 0.  Very long texts are scanned whole.  Repeated rows
are each scanned; an empty table gives no rows; other columns are carried along.  Of chains that
cover the same, the one nearer in the text wins; spans of one template never overlap.  The templates
are a parameter; they, and with them the automaton, are small by nature.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from borgata.llm import ragged

LEAST_MATCH = 4
MOST_GAP = 8
COVER = 0.6

# Phrases of the contract; opening or notice lines, the clauses of short licenses (MIT, BSD, ISC)
# and single clauses of long ones (GPL, Apache).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = [
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
            "of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
            "the software the software is provided as is without warranty of any kind express or implied including but not "
            "limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event "
            "shall the authors or copyright holders be liable for any claim damages or other liability whether in an action "
            "of contract tort or otherwise arising from out of or in connection with the software or the use or other "
            "dealings in the software"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following "
            "disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and "
            "the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties "
            "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are "
            "disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental "
            "special exemplary or consequential damages"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all "
            "implied warranties of merchantability and fitness in no event shall the author be liable for any special direct "
            "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"),
    ("gpl", "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu "
            "general public license is intended to guarantee your freedom to share and change free software"),
    ("gpl-3", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache-2.0", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual "
                   "worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare "
                   "derivative works of publicly display publicly perform sublicense and distribute the work and such "
                   "derivative works in source or object form"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]


class Automaton:
    """Generalised suffix automaton over word ids, with the places of each state's runs."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].setdefault(k, []).append(at + 1)
        # A run ends wherever a longer run that it ends does: pass the places up, longest first.
        for v in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):
            for k, places in self.ends[v].items():
                above = self.ends[self.link[v]].setdefault(k, [])
                above[:] = sorted({*above, *places})

    def _state(self, length: int, link: int, steps: dict[int, int]) -> int:
        self.next.append(steps)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, p: int, word: int) -> int:
        """The state reached from p by the word, holding no run longer than p's plus one."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new

    def stream(self, sequence: list[int]):
        """(state, length) of the longest run that ends at each word."""
        state, length = 0, 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length


class Span(NamedTuple):
    label: str
    first: int
    end: int
    share: float


class Run(NamedTuple):
    """Words [first, end) of a text that equal words [begin, stop) of a template."""

    first: int
    end: int
    begin: int
    stop: int


def chained(runs: list[Run], gap: int) -> list[tuple[int, int, int]]:
    """(first, end, words covered) of the best chains of one template's runs, none sharing text.

    ``best[j]`` is the most that a chain ending in run j covers.  Only runs that end at most ``gap``
    words before j can precede it, so the work grows with the runs and not with their square.
    """
    runs = sorted(runs, key=lambda r: (r.end, r.first, r.begin))
    best, before, gain = [], [], []
    for j, r in enumerate(runs):
        size = r.end - r.first
        most, link, added = size, -1, size
        for i in range(j - 1, -1, -1):
            if runs[i].end < r.first - gap:
                break
            cut = max(0, runs[i].end - r.first, runs[i].stop - r.begin)
            if cut < size and r.first + cut - runs[i].end <= gap and best[i] + size - cut > most:
                most, link, added = best[i] + size - cut, i, size - cut
        best.append(most)
        before.append(link)
        gain.append(added)
    taken: list[tuple[int, int, int]] = []  # in text order

    def free(first: int, end: int) -> bool:
        k = bisect_right(taken, (first, end, 0))
        return not (k and taken[k - 1][1] > first) and not (k < len(taken) and taken[k][0] < end)

    for j in sorted(range(len(runs)), key=lambda j: (-best[j], runs[j].end)):
        first, covered, i = runs[j].end, 0, j
        while i >= 0 and free(runs[i].end - gain[i], runs[j].end):
            first, covered, i = runs[i].end - gain[i], covered + gain[i], before[i]
        if covered:
            taken.insert(bisect_right(taken, (first, runs[j].end, covered)), (first, runs[j].end, covered))
    return taken


def words_of(text: str) -> tuple[list[bytes], np.ndarray]:
    t = ragged.texts_of(pa.array([text]))
    data = ragged.LOWER[t.data]
    w = ragged.words(ragged.Texts(data, t.offsets), ragged.ALNUM)
    return ([data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)],
            ragged.Hasher(data).spans(w.start, w.end))


class Licenses:
    """Templates ready for scanning."""

    def __init__(self, base: dict[str, str] = BASE, templates: list[tuple[str, str]] = TEMPLATES,
                 least: int = LEAST_MATCH, gap: int = MOST_GAP, cover: float = COVER):
        self.least, self.gap, self.cover = least, gap, cover
        self.labels = [*base.values(), *[label for label, _ in templates]]
        self.n_base = len(base)
        ids: dict[bytes, int] = {}
        hashes: list[int] = []
        sequences = []
        for text in [*base, *[text for _, text in templates]]:
            found, h = words_of(text)
            for word, value in zip(found, h.tolist(), strict=True):
                if word not in ids:
                    ids[word] = len(ids)
                    hashes.append(value)
            sequences.append([ids[word] for word in found])
        self.lengths = [len(s) for s in sequences]
        order = np.argsort(np.array(hashes, np.uint64))
        self.keys, self.ids = np.array(hashes, np.uint64)[order], order
        self.pairs = np.zeros((len(ids) + 1, len(ids) + 1), bool)  # the last id: any other word
        self.base_pairs = self.pairs.copy()
        for k, s in enumerate(sequences):
            self.pairs[s[:-1], s[1:]] = True
            if k < self.n_base:
                self.base_pairs[s[:-1], s[1:]] = True
        self.automaton = a = Automaton(sequences)
        # Base phrases that end where a state's runs end: those that are a run of it or of a state up its links.
        full = {}
        for v in range(1, len(a.length)):
            for k in range(self.n_base):
                if self.lengths[k] in a.ends[v].get(k, ()) and a.length[a.link[v]] < self.lengths[k] <= a.length[v]:
                    full.setdefault(v, []).append(k)
        self.phrases: list[tuple[int, ...]] = [()] * len(a.length)
        for v in sorted(range(1, len(a.length)), key=lambda v: a.length[v]):
            self.phrases[v] = (*full.get(v, ()), *self.phrases[a.link[v]])
        # Places (template, end) of the runs up a state's links that are not places of a longer run.
        self.shorter: list[tuple[tuple[int, int, int], ...]] = [()] * len(a.length)
        for v in sorted(range(1, len(a.length)), key=lambda v: a.length[v]):
            up = a.link[v]
            if a.length[up] >= least:
                here = [(k, p, a.length[up]) for k, places in a.ends[up].items() if k >= self.n_base
                        for p in places if p not in a.ends[v].get(k, ())]
                self.shorter[v] = (*here, *self.shorter[up])

    def stretches(self, w: ragged.Words, h: np.ndarray):
        """First word and words' ids of the stretches worth streaming."""
        other = len(self.keys)
        if len(h) < 2:
            return
        place = np.minimum(np.searchsorted(self.keys, h), other - 1)
        word = np.where(self.keys[place] == h, self.ids[place], other)
        same = w.row[1:] == w.row[:-1]
        pair = self.pairs[word[:-1], word[1:]] & same
        edges = np.flatnonzero(np.diff(np.concatenate([[False], pair, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2] + 1
        based = np.zeros(len(h), np.int64)
        np.cumsum(self.base_pairs[word[:-1], word[1:]] & pair, out=based[1:])
        worth = (ends - starts >= self.least) | (based[ends - 1] > based[starts])
        for a, b in zip(starts[worth].tolist(), ends[worth].tolist(), strict=True):
            yield a, word[a:b].tolist()

    def matches(self, start: int, sequence: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, Run]]]:
        """Full base phrases (phrase, first word); runs that cannot be extended (template, run)."""
        phrases, runs = [], []
        open_runs: dict[tuple[int, int], int] = {}  # length by (template, place) of the runs that end here
        for at, (state, length) in enumerate(self.automaton.stream(sequence), start + 1):
            phrases += [(k, at - self.lengths[k]) for k in self.phrases[state] if self.lengths[k] <= length]
            now = {}
            if length >= self.least:
                now = {(k, p): length for k, places in self.automaton.ends[state].items() if k >= self.n_base for p in places}
            now.update(((k, p), size) for k, p, size in self.shorter[state])
            runs += [(k, Run(at - 1 - n, at - 1, p - n, p)) for (k, p), n in open_runs.items() if (k, p + 1) not in now]
            open_runs = now
        end = start + len(sequence)
        return phrases, runs + [(k, Run(end - n, end, p - n, p)) for (k, p), n in open_runs.items()]

    def chains(self, runs: list[tuple[int, Run]]) -> list[Span]:
        """Runs in text order, chained per template."""
        by_template: dict[int, list[Run]] = {}
        for k, run in runs:
            by_template.setdefault(k, []).append(run)
        return [Span(self.labels[k], first, end, covered / self.lengths[k])
                for k, mine in by_template.items() for first, end, covered in chained(mine, self.gap)]

    def scan(self, t: ragged.Texts) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], list[Span]]]]:
        """Words of each text; base phrases and spans of the texts that have any."""
        data = ragged.LOWER[t.data]
        w = ragged.words(ragged.Texts(data, t.offsets), ragged.ALNUM)
        h = ragged.Hasher(data).spans(w.start, w.end)
        found: dict[int, tuple[list, list]] = {}
        for start, sequence in self.stretches(w, h):
            row = int(w.row[start])
            phrases, runs = self.matches(start - int(w.first[row]), sequence)
            if phrases or runs:
                mine = found.setdefault(row, ([], []))
                mine[0].extend(phrases)
                mine[1].extend(runs)
        return w.count, {row: (p, self.chains(r)) for row, (p, r) in found.items()}


_SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()),
                      T.StructField("end", T.LongType()), T.StructField("share", T.DoubleType())])
_ARROW_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])
RESULT = {
    "n_words": (T.LongType(), pa.int64()), "n_base": (T.LongType(), pa.int64()), "first_word": (T.LongType(), pa.int64()),
    "last_word": (T.LongType(), pa.int64()), "base_labels": (T.StringType(), pa.string()),
    "labels": (T.StringType(), pa.string()), "score": (T.DoubleType(), pa.float64()),
    "spans": (T.ArrayType(_SPAN), pa.list_(_ARROW_SPAN)),
}


def scan_licenses(docs: DataFrame, text: str = "text", keep: list[str] | None = None, prefix: str = "",
                  licenses: Licenses | None = None) -> DataFrame:
    """The columns ``keep`` (default all) of every row, and what was found in its text."""
    keep = docs.columns if keep is None else keep
    known = docs.sparkSession.sparkContext.broadcast(licenses or Licenses())
    fields = [T.StructField(prefix + name, kind) for name, (kind, _) in RESULT.items()]
    schema = T.StructType([*[docs.schema[c] for c in keep], *fields])

    def run(batches):
        kinds = [kind for _, kind in RESULT.values()]
        lic = known.value
        for batch, t in ragged.slices(batches, text):
            n_words, found = lic.scan(t)
            rows = []
            for row in range(t.rows):
                phrases, spans = found.get(row, ((), ()))
                places = [p for _, p in phrases]
                base = {lic.labels[k] for k, _ in phrases}
                spans = [*[Span(lic.labels[k], p, p + lic.lengths[k], 1.0) for k, p in phrases], *spans]
                rows.append((
                    int(n_words[row]), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(base)), ",".join(sorted(base | {s.label for s in spans if s.share >= lic.cover})),
                    max((s.share for s in spans), default=0.0),
                    [s._asdict() for s in sorted(spans, key=lambda s: (s.first, s.end, s.label)) if s.share >= lic.cover]))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs, keep=["doc_id"]).drop("spans")
