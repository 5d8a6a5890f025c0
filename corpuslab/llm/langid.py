"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood is
the sum over all its segmentations into pieces, by the forward algorithm; a text's is the product
over its words. The probabilities are learned by expectation-maximisation over the words of the
labelled documents, which Spark counts per language.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import small_batches, with_judgement
from corpuslab.session import stage

LETTERS = re.compile(r"[^\W\d_]+")
ROUNDS = 2
SMOOTHING = 1e-4  # of each language's probability is spread evenly over all pieces, so none favours what it has not met
MAX_LANGUAGES = 1000
RESCALE = 8  # forward and backward sums are brought back to 1 after so many characters
WORDS_KEPT = 400_000  # words a worker remembers
FLUSH = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """Pieces of a sentencepiece vocabulary as they occur in words: ``\\u2581`` marks a word's start.
    A character that is no piece stands for the unknown piece.

    Pieces are found by a 64-bit rolling hash of their characters in an open-addressing table, for all
    spans of many words at once.
    """

    FACTOR, SLOTS = np.uint64(0x9E3779B97F4A7C15), 1 << 17

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = sorted({p.lower() for p in (model.id_to_piece(i) for i in range(model.get_piece_size()))
                         if LETTERS.fullmatch(p.removeprefix("▁"))})
        self.longest = max(map(len, pieces))
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.unknown, self.none = len(pieces), len(pieces) + 1
        self.size = len(pieces) + 2
        if 2 * len(pieces) > self.SLOTS:
            raise ValueError(f"more than {self.SLOTS // 2} pieces")
        self.keys, self.values = np.zeros(self.SLOTS, np.uint64), np.full(self.SLOTS, self.none, np.int32)
        for p, i in self.ids.items():
            h = np.zeros(1, np.uint64)
            for c in p:
                h = self._longer(h, np.uint64(ord(c)))
            at = self._slot(h)[0]
            while self.keys[at]:
                at = (at + 1) % self.SLOTS
            self.keys[at], self.values[at] = h[0], i

    def _longer(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (h + c + np.uint64(1)) * self.FACTOR

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(40)).astype(np.int64) % self.SLOTS

    def _find(self, h: np.ndarray) -> np.ndarray:
        at = self._slot(h)
        out = np.where(self.keys[at] == h, self.values[at], self.none)
        left = np.flatnonzero((self.keys[at] != h) & (self.keys[at] != 0))
        at = at[left]
        while len(left):
            at = (at + 1) % self.SLOTS
            key = self.keys[at]
            hit = key == h[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (key != 0)
            left, at = left[on], at[on]
        return out

    def arcs(self, words: list[str]) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For marked words of one length: by end, the arcs (start, words that have it, their pieces)."""
        n = len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).T.astype(np.uint64)
        out: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(n + 1)]
        h = np.zeros_like(chars)
        for size in range(1, min(n, self.longest) + 1):
            h = self._longer(h[: n - size + 1], chars[size - 1 :])
            found = self._find(h.ravel()).reshape(h.shape)
            if size == 1:
                found = np.where(found == self.none, self.unknown, found)
            for start, row in enumerate(found):
                at = np.flatnonzero(row != self.none)
                if len(at):
                    out[start + size].append((start, at, row[at]))
        return out


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def split_words(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def by_length(words: list[str]) -> Iterator[list[int]]:
    groups = defaultdict(list)
    for k, w in enumerate(words):
        groups[len(w)].append(k)
    for at in groups.values():
        for i in range(0, len(at), 4096):
            yield at[i : i + 4096]


class Sums:
    """Sums of segmentations by position, each as ``value * exp(log)``: every ``RESCALE`` positions, those that
    the next ones can reach are divided by the newest, so that words of any length stay in range."""

    def __init__(self, first: np.ndarray, reach: int):
        self.reach, self.values, self.logs = reach, [first], [np.zeros_like(first)]
        self.shift = np.zeros_like(first)

    def append(self, value: np.ndarray) -> None:
        self.values.append(value)
        self.logs.append(self.shift)
        if len(self.values) % RESCALE == 0:
            self.shift = self.shift + np.log(value)
            for t in range(max(0, len(self.values) - self.reach), len(self.values)):
                self.values[t] = self.values[t] / value
                self.logs[t] = self.shift


def forward(prob: np.ndarray, arcs: list, words: int, reach: int) -> Sums:
    """Per end: total probability, by [word, language], of all segmentations so far."""
    alpha = Sums(np.ones((words, prob.shape[1])), reach)
    for j in range(1, len(arcs)):
        total = np.zeros_like(alpha.values[0])
        for i, at, piece in arcs[j]:
            total[at] += alpha.values[i][at] * prob[piece]
        alpha.append(total)
    return alpha


def backward(prob: np.ndarray, arcs: list, words: int, reach: int) -> Sums:
    """Per start, from the last one on: total probability of all segmentations from there."""
    n = len(arcs) - 1
    leaving: list[list] = [[] for _ in range(n + 1)]
    for j in range(1, n + 1):
        for i, at, piece in arcs[j]:
            leaving[i].append((j, at, piece))
    beta = Sums(np.ones((words, prob.shape[1])), reach)
    for i in range(n - 1, -1, -1):
        total = np.zeros_like(beta.values[0])
        for j, at, piece in leaving[i]:
            total[at] += beta.values[n - j][at] * prob[piece]
        beta.append(total)
    return beta


def log_likelihood(prob: np.ndarray, grid: Lattice, words: list[str]) -> np.ndarray:
    out = np.empty((len(words), prob.shape[1]))
    for at in by_length(words):
        alpha = forward(prob, grid.arcs(["▁" + words[k] for k in at]), len(at), grid.longest)
        out[at] = np.log(alpha.values[-1]) + alpha.logs[-1]
    return out


def expected_counts(prob: np.ndarray, grid: Lattice, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Per piece, how often the segmentations of ``words`` use it on average; ``prob`` is one language's."""
    total = np.zeros(grid.size)
    for group in by_length(words):
        arcs = grid.arcs(["▁" + words[k] for k in group])
        n, weight = len(arcs) - 1, counts[group]
        alpha = forward(prob[:, None], arcs, len(group), grid.longest)
        beta = backward(prob[:, None], arcs, len(group), grid.longest)
        whole, base = alpha.values[n][:, 0], alpha.logs[n][:, 0]
        for j in range(1, n + 1):
            ahead, log = beta.values[n - j][:, 0], beta.logs[n - j][:, 0] - base
            for i, at, piece in arcs[j]:
                flow = alpha.values[i][at, 0] * prob[piece] * ahead[at] / whole[at]
                if n + 1 >= RESCALE:
                    flow *= np.exp(alpha.logs[i][at, 0] + log[at])
                total += np.bincount(piece, flow * weight[at], grid.size)
    return total


def _smooth(counts: np.ndarray, grid: Lattice) -> np.ndarray:
    """The unknown piece has the evenly spread part only: as much in every language, however much text each has."""
    even = np.ones(grid.size)
    even[grid.none] = 0
    p = np.array(counts, float)
    p[[grid.none, grid.unknown]] = 0
    return (1 - SMOOTHING) * p / p.sum() + SMOOTHING * even / even.sum() if p.sum() else even / even.sum()


class Model:
    """Piece probabilities, by [piece, language], of the sorted ``languages``."""

    def __init__(self, path: str, languages: list[str], prob: np.ndarray):
        self.path, self.languages, self.prob, self.key = path, languages, prob, uuid.uuid4().hex


def word_counts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, word, n) over whole texts; tasks add up their own words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def rows() -> pa.RecordBatch:
            flat = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            counts.clear()
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*flat) if flat else ((), (), ()), (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

        for b in small_batches(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[lang].update(split_words(text or ""))
            if sum(map(len, counts.values())) > FLUSH:
                yield rows()
        yield rows()

    given = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(df: DataFrame, vocabulary: str, text_col: str = "text", lang_col: str = "lang", rounds: int = ROUNDS) -> Model:
    """Learns from all rows of ``df`` whose language is not null; the driver gets one number per piece and
    language, at most ``MAX_LANGUAGES`` languages."""
    counted = stage(word_counts(df.where(F.col(lang_col).isNotNull()), text_col, lang_col), "words")
    languages = [r[0] for r in counted.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages.sort()
    grid = lattice(vocabulary)
    prob = np.repeat(_smooth(np.ones(grid.size), grid)[:, None], max(1, len(languages)), axis=1)
    for _ in range(rounds if languages else 0):
        shared = df.sparkSession.sparkContext.broadcast(prob)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            here, total = lattice(vocabulary), np.zeros((lattice(vocabulary).size, len(languages)))
            for b in small_batches(batches, 1 << 15):
                langs, words, n = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy().astype(float)
                for k, lang in enumerate(languages):
                    at = [i for i, x in enumerate(langs) if x == lang]
                    total[:, k] += expected_counts(shared.value[:, k], here, [words[i] for i in at], n[at])
            piece, k = np.nonzero(total)
            yield pa.record_batch([pa.array(x) for x in (piece, k, total[piece, k])], names=["piece", "k", "n"])

        rows = counted.mapInArrow(expect, "piece long, k long, n double").groupBy("piece", "k").agg(F.sum("n").alias("n"))
        got = rows.toPandas()
        total = np.zeros((grid.size, len(languages)))
        total[got["piece"], got["k"]] = got["n"]
        prob = np.column_stack([_smooth(total[:, k], grid) for k in range(len(languages))])
    return Model(vocabulary, languages, prob)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.grid = model, lattice(model.path)
        self.cache: dict[str, int] = {}
        self.rows = np.empty((0, model.prob.shape[1]))

    def _learn(self, new: list[str]) -> None:
        self.cache.update(zip(new, range(len(self.cache), len(self.cache) + len(new))))
        self.rows = np.concatenate([self.rows, log_likelihood(self.model.prob, self.grid, new)])

    def totals(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, int]]:
        """Per text: log likelihood by language, and the number of words."""
        split = [split_words(t or "") for t in texts]
        ids = [list(map(self.cache.get, ws)) for ws in split]
        new = list({w for ws, ks in zip(split, ids) if None in ks for w, k in zip(ws, ks) if k is None})
        if len(self.cache) + len(new) > WORDS_KEPT and self.cache:
            self.cache, self.rows = {}, self.rows[:0]
            new, ids = list({w for ws in split for w in ws}), [[None]] * len(ids)
        if new:
            self._learn(new)
        for ws, ks in zip(split, ids):
            if None in ks:
                ks = map(self.cache.__getitem__, ws)
            yield self.rows[np.fromiter(ks, np.int64, len(ws))].sum(axis=0), len(ws)

    def judge(self, texts: list[str | None]) -> list[dict]:
        out = []
        for text, (total, n) in zip(texts, self.totals(texts)):
            if not n or not self.model.languages or not any(map(str.isalpha, text)):
                out.append({"lang_pred": "und", "score": 0.0})
                continue
            p = np.exp(total - total.max())
            k = int(np.argmax(total))
            out.append({"lang_pred": self.model.languages[k], "score": float(p[k] / p.sum())})
        return out


_SCORERS: dict[str, Scorer] = {}


def scorer(model: Model) -> Scorer:
    """A worker keeps the scorer of the model it used last, with the words it has met."""
    if model.key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.key] = Scorer(model)
    return _SCORERS[model.key]


def identify(df: DataFrame, model: Model, text_col: str = "text", columns: list[str] | None = None) -> tuple[DataFrame, str]:
    """``columns`` of ``df`` (default: all) and a struct column, whose name is the second result: lang_pred,
    score (posterior of the predicted language under even priors, 0 to 1).

    Null, empty and letterless texts are ``und`` with score 0, and so is every text if nothing was
    learned. Whole texts count, however long; equal scores go to the first language by name; repeated
    rows are judged alike, and an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    return with_judgement(df, text_col, "struct<lang_pred:string,score:double>",
                          lambda texts: scorer(shared.value).judge(texts), columns, "language")


def train_and_identify(df: DataFrame, learn: Column, vocabulary: str, columns: list[str] | None = None) -> tuple[DataFrame, str]:
    """Learns from the rows where ``learn`` holds and predicts all."""
    return identify(df, train(df.where(learn), vocabulary), columns=columns)
