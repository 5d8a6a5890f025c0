"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are computed per document in Arrow batches. Equal fingerprints collapse first. Two
fingerprints within ``radius`` bits agree on at least two of ``radius + 2`` blocks of bits, so every
pair of blocks is a key under which they meet. The fingerprints under a key are laid out as 64
vertical bit planes; a tile of queries is compared with all of them at once by adding plane after
plane into bitwise counters that overflow beyond the radius, and is abandoned once every lane has.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpuslab.llm.common import join_hot, small_batches, text_bytes
from corpuslab.llm.components import components
from corpuslab.session import stage

SHINGLE, RADIUS = 3, 2
CELL = 4096  # fingerprints compared in one block; a key with more is split into pairs of chunks
TILE = 256
BLOCK = 1 << 16  # shingles hashed at a time, so long texts need bounded memory
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles' XXH64 (seed 42); no words: zero."""
    w = (text or b"").lower().split()  # bytes: only A-Z, and only \x20 \x09-\x0D
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        part = w[i : i + BLOCK + shingle - 1]
        hashed = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(part[j:] for j in range(min(shingle, len(w)))))), repeat(42))
        h = np.fromiter(hashed, np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long. A doc_id is a long, or a struct as it is."""
    kind = df.schema[id_col].dataType
    kind = kind if isinstance(kind, StructType) else LongType()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            fp = np.fromiter((fingerprint(t, shingle) for t in text_bytes(b, "text")), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    docs = df.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, StructType([StructField("doc_id", kind), StructField("fp", LongType())]))


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, lanes / 64) words: bit l of plane b is bit b of fingerprint l. Lanes past the end are zero."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = np.zeros((64, -(-len(fps) // 64) * 64), np.uint8)
    lanes[:, : len(fps)] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view(np.uint64)


def near_lanes(planes: np.ndarray, queries: np.ndarray, first: int, lanes: int, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query, lanes beyond it within ``radius``) for queries that stand at lanes first, first + 1, ..."""
    k = radius.bit_length()
    start = (1 << k) - 1 - radius  # so that the count overflows k bits exactly when it exceeds the radius
    at = first + np.arange(len(queries))
    shut = np.arange(planes.shape[1] * 64)[None, :] <= at[:, None]
    shut[:, lanes:] = True
    over = np.packbits(shut, axis=1, bitorder="little").view(np.uint64)
    counter = [np.full_like(over, ALL if start >> j & 1 else 0) for j in range(k)]
    for b in range(64):
        mask = np.where(queries >> np.uint64(b) & np.uint64(1), ALL, np.uint64(0))
        carry = planes[b][None, :] ^ mask[:, None]
        for c in counter:
            c ^= carry  # sum bit
            carry &= ~c  # carry: was set and added to
        over |= carry
        if b % 4 == 3:
            live = (over != ALL).any(axis=1)
            if not live.any():
                return
            if live.mean() < 0.5:
                at, queries, over, counter = at[live], queries[live], over[live], [c[live] for c in counter]
    near = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")
    for q, row in zip(at, near):
        if row.any():
            yield int(q), np.flatnonzero(row)


def forest(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Star links (fp, least-placed fp) that join exactly the components of ``fps`` under ``radius``."""
    planes, label = bit_planes(fps), np.arange(len(fps))
    for i in range(0, len(fps), TILE):
        for q, lanes in near_lanes(planes, fps[i : i + TILE], i, len(fps), radius):
            roots = np.unique(np.append(label[lanes], label[q]))
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def _cells(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; the last cell of a batch may go on in the next."""
    rest = np.empty((0, 5), np.int64)

    def links(rows: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
        found = [forest(np.unique(c[:, 4]).view(np.uint64), radius) for c in np.split(rows, new) if len(c) > 1]
        a, b = (np.concatenate([np.empty(0, np.uint64), *x]).view(np.int64) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        rows = np.concatenate([rest, np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])])
        if len(rows):
            last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            rest = rows[cut:]
            if cut:
                yield links(rows[:cut])
    if len(rest):
        yield links(rest)


def links(distinct: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Edges (a, b) that connect what lies within ``radius`` bits; at most a spanning forest per cell.

    ``distinct`` (fp) has every fingerprint once. A key with m fingerprints is split into
    k = ceil(m / cell) chunks, and each pair of chunks is one cell, so no task holds more than about
    2 * cell of a key's fingerprints however many there are.
    """
    edges = np.linspace(0, 64, radius + 3).astype(int)
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(radius + 2)]
    keys = [F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(int(np.uint64(masks[i] | masks[j]).view(np.int64)))).alias("key"))
            for t, (i, j) in enumerate(combinations(range(radius + 2), 2))]
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.t", "k.key", "fp")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    k = F.ceil(F.col("m") / cell)
    placed = keyed.join(sizes, ["t", "key"]).withColumn("chunk", F.pmod(F.xxhash64("fp"), k))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), k - 1)))
    cells = paired.select("t", "key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "fp")
    dealt = cells.repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi")
    return dealt.mapInArrow(lambda batches: _cells(batches, radius), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits,
    itself included. Null, empty and wordless texts have fingerprint zero and link like any other.
    Rows with a null doc_id link their neighbours, and get a null component_id only where the whole
    component has no doc_id. Repeated rows are rows of one fingerprint. An empty table gives an empty
    result; other columns of ``df`` are ignored, whatever they are called.
    """
    fps = stage(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "n", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = stage(rooted, "rooted")
    tops = stage(rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("fps")), "tops")
    classes = join_hot(rooted.select("fp", "n", "root"), tops, "root", "fps", "fp").select("fp", "n", "component_id")
    out = join_hot(fps, stage(classes, "classes"), "fp", "n", "doc_id")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
