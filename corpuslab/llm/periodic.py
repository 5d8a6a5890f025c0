"""Periodic run detection by online dyadic square catching.

Words are appended; whenever a block of ``2**k`` words is complete, a catcher waits for it to come again
``q`` words later, ``2 * 2**k - 1 <= q <= 4 * 2**k - 2``: a square of period q holds a whole aligned block in
its first half, so every period belongs to one level k, and at any time two catchers of a level watch the
newest words. A block that comes again is a suffix comparison of the words before and after it: it goes back
as far as the words q apart agree, and on with each appended word while they do. Squares of one period that
overlap by a period or more merge into a run, and multiples of a run's period inside it are not followed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from corpuslab.llm.common import with_judgement

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
APPEND = 1 << 14  # words appended at a time; any number gives the same runs

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Catchers:
    """Runs of a sequence of word numbers that comes by ``append``. Blocks are compared by a hash of their
    words first and then word by word, so a collision costs time only."""

    def __init__(self, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT):
        self.least_length, self.least_exponent = least_length, least_exponent
        self.n = 0
        self.w, self.prefix = np.empty(0, np.int64), np.zeros(1, np.uint64)
        self.seen: list[int] = []  # by level: second blocks that start before it have been compared
        self.last: dict[int, tuple[int, int]] = {}  # by period: the latest stretch whose words agree q apart
        self.open: set[int] = set()  # periods whose latest stretch ends at the newest word
        self.squares: dict[tuple[int, int], int] = {}  # (start, period): end of stretches of two periods or more
        self.late: dict[int, dict[tuple[int, int], int]] = {}  # those that the next blocks may lie in, by bits of their length

    def append(self, words: np.ndarray) -> None:
        m = len(words)
        if not m:
            return
        if self.n + m > len(self.w):
            room = max(self.n + m, 2 * len(self.w))
            self.w = np.concatenate([self.w[: self.n], np.zeros(room - self.n, np.int64)])
            self.prefix = np.concatenate([self.prefix[: self.n + 1], np.zeros(room - self.n, np.uint64)])
        new = slice(self.n, self.n + m)
        self.w[new] = words
        power, _ = _powers(self.n + m)
        with np.errstate(over="ignore"):
            sums = np.cumsum(_mixed(words.astype(np.uint64) + np.uint64(1)) * power[new])
            self.prefix[self.n + 1 : self.n + m + 1] = sums + self.prefix[self.n]
        self.n += m
        for q in list(self.open):
            start, end = self.last[q]
            self._keep(q, start, self._right(end, q))
        for bits, found in self.late.items():  # the blocks of a level that fits in them have gone past the others
            self.late[bits] = {x: end for x, end in found.items() if end >= self.n - m - (2 << bits)}
        k = 0
        while self.n >= self.least_exponent * (2 * (1 << k) - 1):
            if k == len(self.seen):
                self.seen.append(0)
            self._catch(k)
            k += 1

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) so far, by start and period; each stretch under its smallest period."""
        least: dict[tuple[int, int], int] = {}
        for (start, q), end in self.squares.items():
            if end - start >= max(self.least_length, self.least_exponent * q):
                least[start, end] = min(q, least.get((start, end), q))
        return sorted((start, end - start, q) for (start, end), q in least.items())

    def _catch(self, k: int) -> None:
        """Compares the two watched blocks of level k with each block that the newest words complete."""
        size, n = 1 << k, self.n
        first, stop = max(self.seen[k], 2 * size - 1), n - size + 1
        if first >= stop:
            return
        self.seen[k] = stop
        base = max(0, ((first - 4 * size + 2) >> k) << k)
        _, inverse = _powers(n)
        with np.errstate(over="ignore"):
            block = (self.prefix[base + size : n + 1] - self.prefix[base:stop]) * inverse[base:stop]
        at = np.arange(first, stop)
        near = ((at - 2 * size + 1) >> k) << k
        now = block[first - base :]
        one = np.flatnonzero(block[near - base] == now)
        far = np.searchsorted(near, size)  # from here on there is a second watched block
        two = np.flatnonzero(block[near[far:] - size - base] == now[far:]) + far
        if not len(one) and not len(two):
            return
        a, j = np.concatenate([near[one], near[two] - size]), np.concatenate([at[one], at[two]])
        order = np.argsort(j, kind="stable")
        a, j = a[order], j[order]
        free = np.ones(len(a), bool)
        if len(a) > 8:
            for (start, q), end in (x for bits, found in self.late.items() if 1 << bits > 3 * size - 1 for x in found.items()):
                if end - start >= 3 * size - 1:
                    part = slice(np.searchsorted(j, start), np.searchsorted(j, end - size, "right"))
                    free[part] &= (a[part] < start) | ((j[part] - a[part]) % q != 0)
            a, j = a[free], j[free]
        order = np.lexsort((j, j - a))
        for x, y in zip(a[order].tolist(), j[order].tolist()):
            self._compare(x, y, size)

    def _compare(self, a: int, j: int, size: int) -> None:
        q = j - a
        for known in (q, q // 2) if q % 2 == 0 else (q,):
            start, end = self.last.get(known, (0, 0))
            if start <= a and j + size <= end:
                return
        if size > 1 and not np.array_equal(self.w[a : a + size], self.w[j : j + size]):
            return
        if size == 1 and self.w[a] != self.w[j]:
            return
        self._keep(q, self._left(a, q), self._right(j + size, q))

    def _keep(self, q: int, start: int, end: int) -> None:
        self.last[q] = start, end
        (self.open.add if end == self.n else self.open.discard)(q)
        if end - start >= 2 * q:
            self.late.get((self.squares.get((start, q), start) - start).bit_length(), {}).pop((start, q), None)
            self.squares[start, q] = end
            self.late.setdefault((end - start).bit_length(), {})[start, q] = end

    def _right(self, end: int, q: int) -> int:
        step = 16
        while end < self.n:
            m = min(step, self.n - end)
            odd = self.w[end : end + m] != self.w[end - q : end - q + m]
            stop = int(odd.argmax())
            if odd[stop]:
                return end + stop
            end, step = end + m, step * 2
        return end

    def _left(self, start: int, q: int) -> int:
        step = 16
        while start:
            m = min(step, start)
            odd = (self.w[start - m : start] != self.w[start - m + q : start + q])[::-1]
            stop = int(odd.argmax())
            if odd[stop]:
                return start - stop
            start, step = start - m, step * 2
        return start


def find_runs(words: list[bytes], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT,
              step: int = APPEND) -> list[tuple[int, int, int]]:
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    catchers = Catchers(least_length, least_exponent)
    for i in range(0, len(ids), step):
        catchers.append(ids[i : i + step])
    return catchers.runs()


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Each run's first period only; a word that any run repeats goes."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def _judge(texts: list[bytes | None]) -> list[dict]:
    out = []
    for t in texts:
        words = (t or b"").split()  # bytes: only \x20 and \x09-\x0D
        runs = find_runs(words)
        out.append({"n_words": len(words), "runs": runs, "collapsed": b" ".join(collapse(words, runs)).decode()})
    return out


def periodic_runs(df: DataFrame, text_col: str = "text", columns: list[str] | None = None) -> tuple[DataFrame, str]:
    """``columns`` of ``df`` (default: all) and a struct column, whose name is the second result: n_words, runs
    (start, length, period in words), collapsed (the text's words, each run cut to its first period).

    A run is a stretch of at least ``max(6, 4 * period)`` words, under its smallest period, that no word beside it
    extends. Null, empty and wordless texts have no words, no runs and an empty collapsed text. Whole texts count:
    time grows as n log n and memory as n. Repeated rows are judged alike, an empty table gives an empty
    result, and other columns pass through whatever they are called.
    """
    kind = "struct<n_words:long,runs:array<struct<start:long,length:long,period:long>>,collapsed:string>"
    return with_judgement(df, text_col, kind, _judge, columns, "periodic", as_bytes=True)
