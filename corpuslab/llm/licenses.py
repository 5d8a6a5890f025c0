"""Licence scans with a generalised suffix automaton of licence words.

The automaton holds the words of notice templates and of short phrases that name a licence. A text is
streamed through it once. Matching statistics give the places of whole phrases, and, by the suffix links of
the state reached, how long a match ends at each place of every template, however long another one's match is. Long
matches that follow each other in the text and in a template are chained, and the best chains that cover
enough of their template are licence spans.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame

from corpuslab.llm.automaton import SuffixAutomaton
from corpuslab.llm.common import with_judgement, words

# Phrases and the label each stands for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# The licences' own public notices.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "cc-by": """This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this
license, visit http://creativecommons.org/licenses/by/4.0/""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means.""",
}

LEAST_MATCH = 5  # words of a template match that enters a chain
COVERED = 0.5  # of a template's words, for a label
GAP = 32  # words between two matches of one chain


Match = tuple[int, int, list[int]]  # start and end in the text, ends of its places in the template


class Licences:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES):
        items = [(("phrase", label), words(text.encode())) for text, label in phrases.items()]
        items += [(("template", label), words(text.encode())) for label, text in templates.items()]
        self.sizes = [len(w) for _, w in items]
        self.labels = [label for (_, label), _ in items]
        self.phrase = [kind == "phrase" for (kind, _), _ in items]
        self.least = min([LEAST_MATCH, *(n for n, p in zip(self.sizes, self.phrase) if p)])
        self.auto = a = SuffixAutomaton(items)
        self.whole: list[list[int]] = [[] for _ in a.length]  # phrases that end here, by state
        for v in sorted(range(1, len(a.length)), key=a.length.__getitem__):
            up = a.link[v]
            own = [i for i, end in a.ends[v].items() if self.phrase[i] and end == self.sizes[i] - 1 and a.length[up] < self.sizes[i] <= a.length[v]]
            self.whole[v] = self.whole[up] + own
        self.places: list[dict[int, list[int]]] = [{} for _ in a.length]  # by state and template: ends of all places of its runs
        for item, (_, w) in enumerate(items):
            v = 0
            for end, word in enumerate([] if self.phrase[item] else w, 1):
                v = a.step[v][a.vocab[word]]
                self.places[v].setdefault(item, []).append(end)
        for v in sorted(range(1, len(a.length)), key=a.length.__getitem__, reverse=True):
            up = a.link[v]
            if a.length[up] >= LEAST_MATCH:
                for item, ends in self.places[v].items():
                    self.places[up][item] = sorted({*self.places[up].get(item, ()), *ends})

    def scan(self, text: bytes | None) -> dict:
        w = words(text)
        found: list[tuple[int, str]] = []
        parts: dict[int, list[Match]] = defaultdict(list)
        live: dict[tuple[int, int], int] = {}  # start in the text of each match, by template and place less position
        at = -1

        def end(gone: Iterable[tuple[int, int]]) -> None:
            for item, shift in gone:
                parts[item].append((live.pop((item, shift)), at + 1, [at + 1 + shift]))

        for i, v, n in self.auto.matches(w, self.least):
            found += ((i + 1 - self.sizes[p], self.labels[p]) for p in self.whole[v] if self.sizes[p] <= n)
            now = self._places(v, n, i)
            end(list(live) if i > at + 1 else [m for m in live if m not in now])
            for m, size in now.items():
                live.setdefault(m, i + 1 - size)
            at = i
        end(list(live))
        spans = self._chains(parts)
        starts = [s for s, _ in found]
        base = sorted({label for _, label in found})
        return {"n_words": len(w), "n_base": len(found), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                "base_labels": ",".join(base), "labels": ",".join(sorted({*base, *(s["label"] for s in spans)})),
                "score": 1.0 if found else max((s["covered"] for s in spans), default=0.0), "spans": spans}

    def _places(self, v: int, n: int, i: int) -> dict[tuple[int, int], int]:
        """How many words match up to position i, ``LEAST_MATCH`` or more, by template and place less position."""
        out: dict[tuple[int, int], int] = {}
        while n >= LEAST_MATCH:
            for item, ends in self.places[v].items():
                for e in ends:
                    out.setdefault((item, e - i - 1), n)
            v = self.auto.link[v]
            n = self.auto.length[v]
        return out

    def _chains(self, parts: dict[int, list[Match]]) -> list[dict]:
        """Per template, the best chains of matches whose starts and ends all move on, with short gaps."""
        out = []
        for item, matches in parts.items():
            for start, end, covered in best_chains(matches, COVERED * self.sizes[item]):
                out.append({"label": self.labels[item], "start": start, "end": end, "covered": covered / self.sizes[item]})
        return sorted(out, key=lambda s: (s["start"], s["label"]))


def best_chains(matches: list[Match], least: float) -> list[tuple[int, int, int]]:
    """Disjoint (start, end, covered) of matches in order of their ends in the text, those that cover most of the template first.

    In a chain, starts and ends move on both in the text and in the template, so what a match adds to
    the covered words depends only on the one before it. What lies between the chains taken is searched again.
    """
    out, todo = [], [matches]
    while todo:
        part = todo.pop()
        taken: list[tuple[int, int, int]] = []
        for covered, start, end in sorted(_ending_chains(part, least), key=lambda c: (-c[0], c[2] - c[1], c[1])):
            k = bisect(taken, (start,))
            if (not k or taken[k - 1][1] <= start) and (k == len(taken) or end <= taken[k][0]):
                taken.insert(k, (start, end, covered))
        out += taken
        if taken:
            free: list[list[Match]] = [[] for _ in range(len(taken) + 1)]
            for m in part:
                k = bisect(taken, (m[0] + 1,))
                if (not k or taken[k - 1][1] <= m[0]) and (k == len(taken) or m[1] <= taken[k][0]):
                    free[k].append(m)
            todo += filter(None, free)
    return out


def _ending_chains(matches: list[Match], least: float) -> list[tuple[int, int, int]]:
    """(covered, start, end) of the best chain that ends with each place of a match, if it covers ``least``."""
    best: list[list[tuple[int, int, int, int]]] = []  # per match and place: start and end in the template, covered, start of the chain
    out = []
    for j, (start, end, places) in enumerate(matches):
        here = []
        for b in places:
            a = b - (end - start)
            top = (b - a, start)
            for k in range(j - 1, -1, -1):
                if matches[k][1] + GAP < start:
                    break
                if matches[k][0] >= start or matches[k][1] >= end:
                    continue
                for a0, b0, covered, first in best[k]:
                    if a0 < a and b0 < b:
                        top = max(top, (covered + b - max(a, b0), first))
            here.append((a, b, *top))
            if top[0] >= least:
                out.append((*top, end))
        best.append(here)
    return out


@lru_cache(maxsize=1)
def licences() -> Licences:
    return Licences()


_KIND = ("struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,"
         "spans:array<struct<label:string,start:bigint,end:bigint,covered:double>>>")


def scan_licences(df: DataFrame, text_col: str = "text", columns: list[str] | None = None) -> tuple[DataFrame, str]:
    """``columns`` of ``df`` (default: all) and a struct column, whose name is the second result: n_words,
    n_base, first_word, last_word (of phrase places, by word from 0; null without any), base_labels,
    labels (with the templates'), score (1 with a phrase, else the largest covered share of a template
    span), spans (label, word range [start, end), covered share of the template).

    Null, empty and wordless texts have no words, no labels and score 0; whole texts are read, however
    long; repeated rows are judged alike, and an empty table gives an empty result.
    """
    return with_judgement(df, text_col, _KIND, lambda texts: [licences().scan(t) for t in texts], columns, "licences", as_bytes=True)
