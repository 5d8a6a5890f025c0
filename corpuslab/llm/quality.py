"""Quality classifier: histogram gradient-boosted trees over document statistics.

Spark computes the statistics of every document in Arrow batches and scores them there. The trees are
fitted by numpy on a bounded sample of labelled rows, and flattened into arrays: all rows of a batch
walk down all trees together.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuslab.llm.common import with_judgement
from corpuslab.session import stage

SAMPLE = 20_000  # most labelled rows used for the fit, the first by hash of the document's id
HASH_BITS = 16
HASH_RANGES = 1 << HASH_BITS
TREES, DEPTH, BINS, RATE, RIDGE = 80, 4, 32, 0.15, 5.0
THRESHOLD = 0.3
PACKED = 1 << 16  # a text is compressed in parts of so many bytes to see how repetitive it is

STATISTICS = (
    "log_chars", "log_words", "mean_word", "upper", "digits", "spaces", "punctuation", "symbols", "not_ascii", "sentence_ends",
    "log_lines", "mean_line", "repeated_lines", "short_lines", "distinct_words", "top_word", "top_five_words", "one_letter_words",
    "long_words", "words_ending_in_marks", "capitalised_words", "compressed", "repeated_trigrams", "marks_per_word",
)
CLASSES = bytes.maketrans(bytes(range(128)), bytes(
    0x41 if 0x41 <= c <= 0x5A else 0x61 if 0x61 <= c <= 0x7A else 0x30 if 0x30 <= c <= 0x39 else 0x20 if c in (9, 10, 11, 12, 13, 32)
    else 0x2E if chr(c) in ".?!" else 0x2C if chr(c) in ",;:'\"()-" else 0x23 for c in range(128)))


def statistics(text: bytes | None) -> list[float]:
    """The numbers named by ``STATISTICS``; all zero for null and empty texts."""
    if not text:
        return [0.0] * len(STATISTICS)
    n = len(text)
    kinds = text.translate(CLASSES)
    upper, lower, digits, spaces, ends, marks, symbols = (kinds.count(c) for c in b"Aa0 .,#")
    wide = n - upper - lower - digits - spaces - ends - marks - symbols
    words = text.split()
    w = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    counts = Counter(words)
    top = [c for _, c in counts.most_common(5)] or [0]
    trigrams = len(set(zip(words, words[1:], words[2:])))
    shapes = kinds.split()
    return [
        np.log1p(n), np.log1p(len(words)), (n - spaces) / w, upper / n, digits / n, spaces / n, marks / n, symbols / n, wide / n, ends / n,
        np.log1p(len(lines)), np.log1p(n / k), 1 - len(set(lines)) / k, sum(len(x) < 30 for x in lines) / k, len(counts) / w, top[0] / w, sum(top) / w,
        sum(len(x) == 1 for x in words) / w, sum(len(x) > 12 for x in words) / w, sum(s[-1] == 0x23 or s[-2:] == b".." for s in shapes) / w,
        sum(s[0] == 0x41 for s in shapes) / w, sum(len(zlib.compress(text[i : i + PACKED], 1)) for i in range(0, n, PACKED)) / n,
        1 - trigrams / max(1, len(words) - 2) if len(words) > 2 else 0.0, (ends + marks + symbols) / w,
    ]


class Trees:
    """Complete binary trees as arrays [tree, node]; node i's children are 2i + 1 and 2i + 2. A row goes
    right if its statistic exceeds the cut."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, tree = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(DEPTH if len(self.feature) else 0):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.cut[tree, node])
        total = self.base + self.leaf[tree, node - (2**DEPTH - 1)].sum(axis=1) if len(self.feature) else np.full(len(x), self.base)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss, second-order gains. No rows: score 0.5; one class: near that class, without trees."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    shape = (TREES, 2**DEPTH - 1)
    if len(np.unique(y)) < 2:
        return Trees(base, np.empty((0, shape[1]), int), np.empty((0, shape[1])), np.empty((0, 2**DEPTH)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    feature, cut, leaf = np.zeros(shape, int), np.full(shape, np.inf), np.zeros((TREES, 2**DEPTH))
    total = np.full(len(y), base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h, node = p - y, p * (1 - p), np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, n = 2**depth - 1, 2**depth
            best = np.full(n, 1e-9)
            for f, e in enumerate(edges):
                at = (node - first) * BINS + binned[:, f]
                gs, hs = (np.bincount(at, v, n * BINS).reshape(n, BINS).cumsum(axis=1) for v in (g, h))
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + RIDGE) + (ga - gs) ** 2 / (ha - hs + RIDGE) - ga**2 / (ha + RIDGE)
                gain = gain[:, : len(e)]
                if not gain.size:
                    continue
                k = gain.argmax(axis=1)
                better = gain[np.arange(n), k] > best
                best[better] = gain[better, k[better]]
                feature[t, first + np.flatnonzero(better)], cut[t, first + np.flatnonzero(better)] = f, e[k[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > cut[t, node])
        at = node - (2**DEPTH - 1)
        leaf[t] = -RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + RIDGE)
        total += leaf[t][at]
    return Trees(base, feature, cut, leaf)


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): statistics of whole texts. Other columns are not read."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out, x = with_judgement(docs, "text", "array<double>", lambda texts: [statistics(t) for t in texts], ["doc_id"], "x", as_bytes=True)
    return out.select("doc_id", F.col(x).alias("x"))


def train(stats: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Trees:
    """Fits on at most ``sample`` of the rows where ``learn`` (over doc_id) holds and quality is not null,
    in order of a hash of doc_id. ``labels``: (doc_id, quality).

    Counts by the hash's leading bits, at most ``HASH_RANGES``, tell up to which range rows are needed, so that only
    those are joined to their statistics and sorted. They are staged, and the driver gets ``sample`` rows at most."""
    given = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where(F.col("y").isNotNull() & learn)
    place = (F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - HASH_BITS).bitwiseXOR(F.lit(HASH_RANGES // 2))).cast("int")  # in order of the signed hash
    counts = stats.select("doc_id").join(given, "doc_id").groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()
    last, found = -1, 0
    for r in sorted(counts):
        if found >= sample:
            break
        last, found = r.place, found + r.n
    needed = place <= last
    rows = stats.where(needed).join(given.where(needed), "doc_id").orderBy(F.xxhash64("doc_id"), "y", "x").limit(sample).select("x", "y")
    rows = stage(rows, "labelled").collect()
    rows.sort(key=lambda r: (r.y, r.x))  # files may be read in any order
    return fit(np.array([r.x for r in rows], float).reshape(-1, len(STATISTICS)), np.array([r.y for r in rows], float))


def score_quality(df: DataFrame, labels: DataFrame, learn: Column, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1; higher: label 1 likelier), predicted (1 from ``threshold`` on).

    Null and empty texts have statistics of zero and are scored by them. Without labelled rows every
    score is 0.5. Repeated rows score alike; rows with a null doc_id are scored, but never learned
    from. An empty table gives an empty result; other columns of ``df`` are ignored.
    """
    stats = stage(document_statistics(df), "statistics")
    trees = df.sparkSession.sparkContext.broadcast(train(stats, labels, learn, sample))

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(STATISTICS))
            yield pa.record_batch([b.column(0), pa.array(trees.value.score(x))], names=["doc_id", "score"])

    schema = StructType([stats.schema["doc_id"]]).add("score", "double")
    scored = stats.mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
