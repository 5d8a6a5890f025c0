"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.dataset as pads
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import DataType, StructType

from corpuslab.llm.automaton import SuffixAutomaton
from corpuslab.llm.common import free_name, small_batches, text_bytes, with_judgement, words
from corpuslab.llm.token_files import _open
from corpuslab.session import checkpoint_root, stage

WINDOW, SHARE = 13, 20  # a document is contaminated if hit words are at least 1 / SHARE of its words
BLOCK_WORDS = 500_000  # item words of one automaton (0.4 GB or so); more items make more blocks
BRANCHES = 64  # blocks of one Spark job


class Windows:
    """The windows of a block of items: runs of ``size`` words, or a whole shorter item."""

    def __init__(self, items: list[tuple[object, bytes]], size: int = WINDOW):
        split = [(i, w) for i, w in ((i, words(t)) for i, t in items) if w]
        self.size = size
        self.least = min([size, *(len(w) for _, w in split)])
        self.auto = a = SuffixAutomaton(split, keep_ends=self.least)
        n = len(a.length)
        self.at = [-1] * n  # the state of the last ``size`` words, once so many match
        self.short: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (words, item) of short items that end here
        for v in sorted(range(1, n), key=a.length.__getitem__):
            up = a.link[v]
            if a.length[v] >= size:
                self.at[v] = v if a.length[up] < size else self.at[up]
            own = [(a.sizes[i], i) for i, end in a.ends[v].items()
                   if end == a.sizes[i] - 1 and a.length[up] < a.sizes[i] <= a.length[v] and a.sizes[i] < size]
            self.short[v] = self.short[up] + own if own else self.short[up]

    def hits(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Disjoint spans [start, end) of the words inside window occurrences, and the items met."""
        spans: list[list[int]] = []
        items: set[int] = set()
        if not self.auto.ids:
            return [], items
        for i, v, n in self.auto.matches(text, self.least):
            reach = 0
            if n >= self.size:
                reach = self.size
                items.update(self.auto.ends[self.at[v]])
            for k, item in self.short[v]:
                if k <= n:
                    reach = max(reach, k)
                    items.add(item)
            if reach:
                start = i + 1 - reach
                while spans and start <= spans[-1][1]:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return [(a, b) for a, b in spans], items


def write_blocks(benchmark: DataFrame, window: int, block_words: int) -> tuple[str, list[str]]:
    """A folder of the items by block, and the blocks' names. Nothing but the names comes to the driver.

    Items longer than a block are cut into pieces that overlap by ``window`` - 1 words, so that each
    window lies whole in one piece. A block has at most ``block_words`` + ``window`` - 1 words.
    """
    spark = benchmark.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 64):
            rows = []
            for ident, text in zip(b.column("item_id").to_pylist(), text_bytes(b, "text")):
                w = words(text)
                if len(w) < window:
                    rows += [(ident, b" ".join(w), len(w))] if w else []
                else:
                    parts = (w[i : i + block_words + window - 1] for i in range(0, len(w) - window + 1, block_words))
                    rows += [(ident, b" ".join(p), len(p)) for p in parts]
            ids, texts, sizes = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(texts, pa.binary()), pa.array(sizes, pa.int64())], names=["item_id", "text", "n"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, size = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            names = []
            for n in b.column("n").to_pylist():
                if size and size + n > block_words + window - 1:
                    k, size = k + 1, 0
                size += n
                names.append(f"b{part}_{k}")
            yield pa.record_batch([*b.columns[:2], pa.array(names, pa.string())], names=["item_id", "text", "block"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    pieces = stage(items.mapInArrow(cut, "item_id string, text binary, n long"), "benchmark-pieces")
    total = pieces.agg(F.sum("n")).first()[0]
    if not total:
        return "", []
    schema = "item_id string, text binary, block string"
    path = f"{checkpoint_root(spark).rstrip('/')}/staged/benchmark-blocks-{uuid.uuid4().hex}"
    pieces.repartition(math.ceil(total / block_words)).mapInArrow(number, schema).write.partitionBy("block").parquet(path)
    return path, sorted(r.block for r in spark.read.schema(schema).parquet(path).select("block").distinct().collect())


_held: dict[tuple[str, str, int], Windows] = {}


def held(path: str, block: str, window: int) -> Windows:
    """The block's automaton, built where it is used. A Python worker lets go of one before it builds the next."""
    key = (path, block, window)
    if key not in _held:
        _held.clear()
        fs, name = _open(path)
        t = pads.dataset(f"{name}/block={block}", filesystem=fs, format="parquet").to_table(columns=["item_id", "text"])
        _held[key] = Windows(list(zip(t["item_id"].to_pylist(), t["text"].to_pylist())), window)
    return _held[key]


def mark(df: DataFrame, benchmark: DataFrame, text_col: str = "text", columns: list[str] | None = None,
         window: int = WINDOW, share: int = SHARE, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, str]:
    """``columns`` of ``df`` (default: all) and a struct column, whose name is the second result:
    n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A word is one of ``[0-9a-z]`` and code points from U+0080 on, after lower-casing A-Z. Hit words
    stand inside an occurrence of ``window`` consecutive item words, or of a whole shorter item.
    Null, empty and wordless texts have no words and are not contaminated; null, empty and wordless
    items have no window; an empty benchmark hits nothing. Repeated rows are judged alike. Items with
    the same item_id count once, a null item_id as an empty one. Spans are word ranges [start, end).

    The items are written in blocks under the checkpoint folder, and the tasks build the automata. One
    block takes one pass over ``df``. With more, ``df`` is staged with row numbers, each task reads a
    partition of it with one block's automaton, and what they find is merged by row.
    """
    path, blocks = write_blocks(benchmark, window, block_words)
    if len(blocks) < 2:
        return with_judgement(df, text_col, _HIT, lambda texts: [_judge(t, [held(path, b, window) for b in blocks], share) for t in texts],
                              columns, "hit", as_bytes=True)
    keep, name = df.columns if columns is None else columns, free_name(df, "hit")
    text, row = free_name(df, "_text"), free_name(df, "_row")
    given = stage(df.select(*keep, F.col(text_col).cast("string").alias(text), F.monotonically_increasing_id().alias(row)), "rows")
    found = []
    for i in range(0, len(blocks), BRANCHES):
        branches = [_found(given.select(F.col(row).alias("row"), F.col(text).alias("text")), path, b, window, b == blocks[0]) for b in blocks[i : i + BRANCHES]]
        found.append(stage(reduce(DataFrame.union, branches), "hits"))
    merged = reduce(DataFrame.union, found).groupBy("row").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    judged = merged.mapInArrow(_judge_merged(share), f"row long, hit {_HIT}").select(F.col("row").alias(row), F.col("hit").alias(name))
    return given.join(judged, row).select(*keep, name), name


_SPANS = "array<struct<start:bigint,end:bigint>>"
_FOUND = f"row bigint, n_words bigint, spans {_SPANS}, items array<string>"


def _found(texts: DataFrame, path: str, block: str, window: int, every: bool) -> DataFrame:
    """What one block's automaton finds in the rows: a row for each row with hits, or for ``every`` row."""
    schema = to_arrow_schema(StructType.fromDDL(_FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            made = []
            for row, text in zip(b.column("row").to_pylist(), text_bytes(b, "text")):
                n, spans, items = _met(text, [held(path, block, window)])
                if every or spans:
                    made.append({"row": row, "n_words": n, "spans": [{"start": a, "end": z} for a, z in spans], "items": sorted(items)})
            yield pa.RecordBatch.from_pylist(made, schema)

    return texts.mapInArrow(run, _FOUND)


def _judge_merged(share: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = to_arrow_type(DataType.fromDDL(_HIT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            made = [_verdict(r["n_words"], [(s["start"], s["end"]) for s in r["spans"]], set(r["items"]), share) for r in b.to_pylist()]
            yield pa.record_batch([b.column("row"), pa.array(made, kind)], names=["row", "hit"])

    return run


_HIT = "struct<n_words:bigint,n_hit:bigint,n_items:bigint,items_sha256:string,contaminated:boolean,spans:array<struct<start:bigint,end:bigint>>>"


def _judge(text: bytes | None, blocks: list[Windows], share: int) -> dict:
    return _verdict(*_met(text, blocks), share)


def _met(text: bytes | None, blocks: Iterable[Windows]) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words of the text, spans inside window occurrences and the ids of the items met."""
    w, found, items = words(text), [], set()
    for b in blocks:
        spans, met = b.hits(w)
        found += spans
        items.update("" if (x := b.auto.ids[i]) is None else x for i in met)
    return len(w), found, items


def _verdict(n_words: int, found: list[tuple[int, int]], items: set[str], share: int) -> dict:
    merged: list[list[int]] = []
    for a, z in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(z, merged[-1][1])
        else:
            merged.append([a, z])
    n_hit = sum(z - a for a, z in merged)
    return {"n_words": n_words, "n_hit": n_hit, "n_items": len(items),
            "items_sha256": hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
            "contaminated": n_hit > 0 and share * n_hit >= n_words, "spans": [{"start": a, "end": z} for a, z in merged]}


def decontaminate(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` that are not contaminated, in its own columns."""
    marked, hit = mark(df, benchmark, **options)
    return marked.where(~F.col(hit)["contaminated"]).select(*df.columns)
