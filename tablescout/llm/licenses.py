"""Licence scans with a generalised suffix automaton of licence words.

The automaton holds every run of consecutive words of all templates and base phrases. Texts
are streamed through it: after each word the state is the longest run of template words that
ends there (its length is the matching statistic). Matches of ``LEAST_MATCH`` words or more
are chained, in the order of the template, into covered spans: each match continues the chain of
most words that ended earlier in the template and within reach. A template covered by
``LEAST_COVER`` labels the text. A base phrase stands wherever its state is that of the match,
or one above it on the suffix links.

Words of a text outside the templates, and pairs of neighbours that no template has, break
every match of two words, so only runs between them are streamed. The automaton is as large
as the templates, which are a parameter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import bounded, chunks, lowered, prefix_hashes, stretch_hashes, words

LEAST_MATCH = 3
LEAST_COVER = 0.7

# Phrases that count wherever they stand, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# The notices by which works name their licence.
TEMPLATES = {
    "agpl": ["gnu affero general public license",
             "under the terms of the gnu affero general public license as published by the free "
             "software foundation"],
    "apache": ["licensed under the apache license version 2 0", "apache license version 2 0",
               "you may not use this file except in compliance with the license you may obtain a "
               "copy of the license at http www apache org licenses license 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met",
            "released under the bsd license"],
    "cc-by-nc": ["licensed under cc by nc 4 0",
                 "creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0",
                 "creative commons attribution sharealike 4 0 international license"],
    "cc0": ["cc0 1 0 universal public domain dedication"],
    "gpl": ["licensed under the gnu general public license version 3",
            "this program is free software you can redistribute it and or modify it under the "
            "terms of the gnu general public license as published by the free software foundation"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with "
            "or without fee is hereby granted"],
    "lgpl": ["gnu lesser general public license"],
    "mit": ["released under the mit license", "licensed under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files the software to deal in the software "
            "without restriction"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}

_SEPARATORS = np.ones(256, dtype=bool)
_SEPARATORS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class SuffixAutomaton:
    """All factors of several word sequences.

    ``ends[state]`` is one (sequence, last place) of the state's runs. ``add`` starts each
    sequence at the root, so no run crosses two.
    """

    def __init__(self) -> None:
        self.following: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [(-1, -1)]

    def _state(self, length: int, following: dict[int, int], link: int, end: tuple[int, int]):
        self.following.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(end)
        return len(self.length) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        copy = self._state(self.length[state] + 1, dict(self.following[target]),
                           self.link[target], self.ends[target])
        while state != -1 and self.following[state].get(word) == target:
            self.following[state][word] = copy
            state = self.link[state]
        self.link[target] = copy
        return copy

    def add(self, sequence: Sequence[int], number: int) -> None:
        last = 0
        for place, word in enumerate(sequence):
            there = self.following[last].get(word)
            if there is not None:
                last = (there if self.length[there] == self.length[last] + 1
                        else self._split(last, word, there))
                continue
            new = self._state(self.length[last] + 1, {}, 0, (number, place))
            state = last
            while state != -1 and word not in self.following[state]:
                self.following[state][word] = new
                state = self.link[state]
            if state != -1:
                target = self.following[state][word]
                self.link[new] = (target if self.length[target] == self.length[state] + 1
                                  else self._split(state, word, target))
            last = new

    def find(self, sequence: Sequence[int]) -> int:
        state = 0
        for word in sequence:
            state = self.following[state][word]
        return state

    def stream(self, run: Sequence[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest match) after each word."""
        state = size = 0
        for word in run:
            while state and word not in self.following[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.following[state]:
                state = self.following[state][word]
                size += 1
            else:
                size = 0
            yield state, size


class Scanner:
    """The automaton with what is read off its states."""

    def __init__(self, base: Mapping[str, str], templates: Mapping[str, Sequence[str]]) -> None:
        self.sequences: list[list[int]] = []
        self.labels: list[str] = []
        self.phrases: list[tuple[int, int, str]] = []       # state, words, label
        ids: dict[str, int] = {}

        def numbers(text: str) -> list[int]:
            return [ids.setdefault(w, len(ids)) for w in _WORD.findall(text.lower())]

        for label, texts in templates.items():
            for text in texts:
                self.sequences.append(numbers(text))
                self.labels.append(label)
        whole = [(numbers(text), label) for text, label in base.items()]
        if any(len(s) < 2 for s in [*self.sequences, *(w for w, _ in whole)]):
            raise ValueError("a phrase or template needs two words at least")
        self.automaton = SuffixAutomaton()
        for k, sequence in enumerate(self.sequences):
            self.automaton.add(sequence, k)
        for sequence, _ in whole:
            self.automaton.add(sequence, -1)
        self.phrases = [(self.automaton.find(s), len(s), label) for s, label in whole]
        # where each run of a template stands in it, by state: all places, along the links
        self.places: dict[int, set[tuple[int, int]]] = {}
        for k, sequence in enumerate(self.sequences):
            state = 0
            for place, word in enumerate(sequence):
                state = self.automaton.following[state][word]
                above = state
                while above > 0:
                    self.places.setdefault(above, set()).add((k, place))
                    above = self.automaton.link[above]
        self.standing = [self._standing(s) for s in range(len(self.automaton.link))]
        hashes = []
        for word in ids:
            data = np.frombuffer(word.encode(), np.uint8)
            hashes.append(int(stretch_hashes(prefix_hashes(data), np.array([0]),
                                             np.array([len(data)]))[0]))
        order = np.argsort(np.array(hashes, np.uint64))
        self.hashes, self.ids = np.array(hashes, np.uint64)[order], order
        self.size = len(ids) + 1
        self.pairs = np.unique([a * self.size + b for s in [*self.sequences, *(w for w, _ in whole)]
                                for a, b in zip(s, s[1:])])

    def _standing(self, state: int) -> list[int]:
        """Base phrases that end wherever a match is in this state, if it is long enough."""
        above = set()
        while state > 0:
            above.add(state)
            state = self.automaton.link[state]
        return [k for k, (s, _, _) in enumerate(self.phrases) if s in above]

    def runs(self, hashes: np.ndarray, number: np.ndarray):
        """(text, first word, ids) of the runs whose neighbours all stand in some template."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        ids = np.where(self.hashes[at] == hashes, self.ids[at], -1)
        if len(ids) < 2:
            return
        good = ((ids[1:] >= 0) & (ids[:-1] >= 0) & (number[1:] == number[:-1]))
        candidates = np.flatnonzero(good)
        good[candidates] = np.isin(ids[candidates] * self.size + ids[candidates + 1], self.pairs)
        edge = np.diff(np.concatenate([[0], good.astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            yield number[a], a, ids[a:b + 1].tolist()

    def scan(self, found: list[tuple[int, list[int]]]):
        """Base places [(start, label)], {label: (cover, first, last word)} of a text's runs."""
        base, matches = [], []
        for start, run in found:
            previous = None
            for i, (state, size) in enumerate(self.automaton.stream(run)):
                for k in self.standing[state]:
                    _, width, label = self.phrases[k]
                    if size >= width:
                        base.append((start + i - width + 1, label))
                if previous is not None and size <= previous[2]:
                    matches.append(previous)
                previous = (start + i, state, size)
            if previous is not None:
                matches.append(previous)
        cover: dict[str, tuple[float, int, int]] = {}
        # template -> place -> chains that end there: [(end, words, first)], ends grow, words fall
        chains: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
        for end, state, size in matches:
            if size < LEAST_MATCH and size < 2:
                continue
            made = []
            for k, place in self.places.get(state, ()):
                sequence = self.sequences[k]
                if size < min(LEAST_MATCH, len(sequence)):
                    continue
                low, reach = place - size + 1, end - 3 * len(sequence) - 20
                count, first = size, end - size + 1
                for at, ended in chains.get(k, {}).items():
                    near = [c for c in ended if c[0] >= reach] if at < low else ()
                    if near and (near[0][1] + size, near[0][2]) > (count, first):
                        count, first = near[0][1] + size, near[0][2]
                made.append((k, place, reach, (end, count, first)))
            for k, place, reach, chain in sorted(made):
                ended = chains.setdefault(k, {}).setdefault(place, [])
                ended[:] = [c for c in ended if c[0] >= reach and c[1] > chain[1]] + [chain]
                share = chain[1] / len(self.sequences[k])
                label = self.labels[k]
                if share > cover.get(label, (0.0,))[0]:
                    cover[label] = (share, chain[2], end)
        return base, cover


def scan(docs: DataFrame, base: Mapping[str, str] = BASE,
         templates: Mapping[str, Sequence[str]] = TEMPLATES) -> DataFrame:
    """``docs`` with what its texts hold of licences; columns so named are replaced.

    ``n_words``; ``n_base`` places of base phrases, ``first_word`` and ``last_word`` the smallest
    and largest start of one (words from 0, else null), ``base_labels`` and ``labels`` distinct,
    sorted and joined by commas (``labels`` also has templates covered by ``LEAST_COVER``),
    ``score`` the largest share of a template or phrase that is covered, and ``spans``
    (label, first word, last word, cover). Null and empty texts have no words and score 0.
    Each row is scanned for itself, whole. A phrase or template of fewer than two words is an
    error.
    """
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
             "spans"]
    columns = [c for c in docs.columns if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(base, templates))

    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, "
                  "base_labels string, labels string, score double, "
                  "spans array<struct<label:string,first:long,last:long,cover:double>>")
    def scanned(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = shared.value
        for texts in series:
            rows = []
            for a, b, data, offsets in chunks(pa.array(texts, pa.string())):
                data = lowered(data)
                starts, ends, number = words(data, offsets, _SEPARATORS)
                counts = np.bincount(number, minlength=b - a)
                before = np.cumsum(counts) - counts
                found: dict[int, list] = {}
                hashes = stretch_hashes(prefix_hashes(data), starts, ends)
                for text, first, run in scanner.runs(hashes, number):
                    found.setdefault(text, []).append((int(first - before[text]), run))
                for i in range(b - a):
                    places, cover = scanner.scan(found[i]) if i in found else ([], {})
                    at = [p for p, _ in places]
                    named = {label for _, label in places}
                    spans = [{"label": k, "first": v[1], "last": v[2], "cover": v[0]}
                             for k, v in sorted(cover.items()) if v[0] >= LEAST_COVER]
                    score = max([v[0] for v in cover.values()] + [1.0] * bool(at), default=0.0)
                    rows.append((int(counts[i]), len(at), min(at, default=None),
                                 max(at, default=None), ",".join(sorted(named)),
                                 ",".join(sorted(named | {s["label"] for s in spans})),
                                 min(score, 1.0), spans))
            out = pd.DataFrame(rows, columns=added)
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            yield out

    named = [F.col(f"`{c}`") for c in columns]
    return bounded(docs).select(*named, scanned(F.col("text")).alias("_scan")).select(*named, "_scan.*")
