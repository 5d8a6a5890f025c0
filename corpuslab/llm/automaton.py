"""Generalised suffix automaton over sequences of words, and matching statistics of a stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat

import numpy as np


class SuffixAutomaton:
    """Of ``items`` (id, words): every run of words that occurs in an item is a path from state 0.

    ``length[v]`` is the longest run of state v, ``link[v]`` the state of its longest shorter class,
    and ``ends[v]`` maps item indexes to the smallest word index where the state's runs end in them.
    """

    def __init__(self, items: Iterable[tuple[object, Sequence[bytes]]], keep_ends: int = 1):
        """``keep_ends``: ends are kept for states whose longest run has at least so many words."""
        self.ids: list[object] = []
        self.sizes: list[int] = []
        self.vocab: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        ends: list[dict[int, int]] = [{}]
        for ident, words in items:
            item = len(self.ids)
            self.ids.append(ident)
            self.sizes.append(len(words))
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)), ends)
                ends[last].setdefault(item, i)
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = ends[self.link[v]]
            if self.length[self.link[v]] >= keep_ends:
                for item, at in ends[v].items():
                    up[item] = min(at, up.get(item, at))
        self.ends = [e if n >= keep_ends else {} for e, n in zip(ends, self.length)]

    def _new(self, length: int, step: dict[int, int], link: int, ends: list[dict[int, int]]) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        ends.append({})
        return len(self.length) - 1

    def _split(self, v: int, w: int, ends: list[dict[int, int]]) -> int:
        """The state that v leads to by w, cut to runs of one word more than v's."""
        q = self.step[v][w]
        if self.length[q] == self.length[v] + 1:
            return q
        copy = self._new(self.length[v] + 1, dict(self.step[q]), self.link[q], ends)
        self.link[q] = copy
        while v != -1 and self.step[v].get(w) == q:
            self.step[v][w] = copy
            v = self.link[v]
        return copy

    def _extend(self, last: int, w: int, ends: list[dict[int, int]]) -> int:
        if w in self.step[last]:
            return self._split(last, w, ends)
        new, v = self._new(self.length[last] + 1, {}, 0, ends), last
        while v != -1 and w not in self.step[v]:
            self.step[v][w] = new
            v = self.link[v]
        if v != -1:
            self.link[new] = self._split(v, w, ends)
        return new

    def known(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int32, len(words))

    def matches(self, words: list[bytes], least: int) -> Iterator[tuple[int, int, int]]:
        """(position, state, matching length) wherever the longest run of item words that ends at the
        position has ``least`` words or more. Words that no item has restart the automaton, so runs
        between them that are shorter than ``least`` need no steps."""
        ids = self.known(words)
        gaps = np.flatnonzero(ids < 0)
        starts, stops = np.append(0, gaps + 1), np.append(gaps, len(ids))
        step, link, length = self.step, self.link, self.length
        for k in np.flatnonzero(stops - starts >= least):
            a = int(starts[k])
            v = n = 0
            for i, w in enumerate(ids[a : int(stops[k])].tolist(), a):
                while w not in step[v]:
                    if not v:
                        n = 0
                        break
                    v = link[v]
                    n = length[v]
                else:
                    v = step[v][w]
                    n += 1
                if n >= least:
                    yield i, v, n
