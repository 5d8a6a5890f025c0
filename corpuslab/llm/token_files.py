"""Token ids in Arrow IPC files of fixed-size-list batches.

Documents are tokenized once, in Arrow batches, and dealt out by ranges of doc_id to shards. A shard's
file holds its documents' ids one after another in ascending doc_id order, cut into sequences of equal
length: per row ``ids`` (fixed-size list of uint16 or uint32) and ``mask`` (fixed-size list of booleans,
one bit each, false where the shard's last sequence is padded). The buffers of an uncompressed Arrow file are flat, so a
memory-mapped file gives sequence i as a view, without copying. Beside it stands the shard's document
index (doc_id, start in the shard, n_tokens), in the same format.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import small_batches
from corpuslab.session import checkpoint_root, stage

SEQ_LEN, BATCH_ROWS = 1024, 512
SHARD_BYTES = 32 << 20  # text bytes of a shard, on average
END_ID = 0
CACHE = 800_000  # chunks whose ids a worker remembers
PIECES = 1 << 18  # chunks of a text handled at a time

#: Texts of these characters, with single spaces and line ends between words, are cut into chunks.
PLAIN = re.compile("[\n\x20-\x7eÀ-ÖØ-öø-ſ]*+")
GAPS = ("  ", " \n", "\n ", "\n\n")
#: Byte-level BPE's pattern of pre-tokens, for the characters of plain texts.
LETTER = "A-Za-zÀ-ÖØ-öø-ſ"
PRETOKEN = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTER}]+| ?[0-9]+| ?[^ \n{LETTER}0-9]+|\n")
#: Byte-level BPE writes a byte as its own character if that prints, else as the next free one from U+0100.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: 0x100 + i for i, b in enumerate(sorted({*range(256)} - {*PRINTED}))}


class Encoder:
    """Ids of texts by the tokenizers library.

    Byte-level BPE never merges across the space or line end before a word. A plain text is therefore
    cut there, the library's model tokenizes each distinct chunk once, and the ids are joined. Any
    other text, and one that holds an added token, goes to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)")
        parts = json.loads(self.tokenizer.to_str())
        kind = parts["pre_tokenizer"] or {}
        self.chunked = (kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
                        and not parts["normalizer"] and parts["model"]["type"] == "BPE" and not parts["model"].get("dropout"))
        self.cache: dict[str, bytes] = {}
        self.short: dict[str, bytes] = {}  # pre-tokens of one or two characters: punctuation and digits

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        if (found := self.short.get(piece)) is not None:
            return found
        written = piece.encode().decode("latin-1").translate(BYTE_CHARS)
        ids = array("H" if self.dtype.itemsize == 2 else "I", [t.id for t in self.model.tokenize(written)])
        if sys.byteorder == "big":
            ids.byteswap()
        if len(piece) <= 2:
            self.short[piece] = ids.tobytes()
        return ids.tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if (not self.chunked or PLAIN.match(text).end() < len(text) or any(g in text for g in GAPS) or text[0] in " \n" or text[-1] in " \n"
                or self.added.search(text)):
            return self._ids(text)
        first, *chunks = text.replace("\n", " \n").split(" ")
        out = [self._ids(first)]
        for i in range(0, len(chunks), PIECES):
            part = chunks[i : i + PIECES]
            ids = list(map(self.cache.get, part))
            if None in ids:
                if len(self.cache) > CACHE:
                    self.cache.clear()
                for j, c in enumerate(part):
                    if ids[j] is None:
                        if (found := self.cache.get(c)) is None:
                            found = self.cache[c] = b"".join(map(self._piece, PRETOKEN.findall(c if c[0] == "\n" else f" {c}")))
                        ids[j] = found
            out += ids
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


class _Writer:
    """A file that appears under its name only when whole, so a lost or repeated task leaves no torn one."""

    def __init__(self, path: str, schema: pa.Schema):
        self.fs, self.path = _open(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.sink = self.fs.open_output_stream(self.part)
        self.file = pa.ipc.new_file(self.sink, schema)

    def close(self) -> None:
        self.file.close()
        self.sink.close()
        self.fs.move(self.part, self.path)


class ShardWriter:
    """Appends documents; holds at most one batch of sequences."""

    def __init__(self, folder: str, shard: int, dtype: np.dtype, seq_len: int):
        self.name, self.dtype, self.seq_len = f"{folder}/shard-{shard:08d}", dtype, seq_len
        ids = pa.list_(pa.field("item", pa.from_numpy_dtype(dtype.newbyteorder("=")), nullable=False), seq_len)
        mask = pa.list_(pa.field("item", pa.bool_(), nullable=False), seq_len)
        self.schema = pa.schema([pa.field("ids", ids, False), pa.field("mask", mask, False)])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.data, self.index = _Writer(f"{self.name}.arrow", self.schema), _Writer(f"{self.name}.index.arrow", self.index_schema)
        self.tokens, self.held, self.size, self.docs = 0, [], 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.tokens, len(ids)))
        self.tokens += len(ids)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.seq_len * BATCH_ROWS:
            self._flush(self.size // self.seq_len * self.seq_len)
        if len(self.docs) >= 1 << 16:
            self._flush_docs()

    def _flush(self, n: int) -> None:
        flat = np.concatenate([*self.held, np.empty(0, self.dtype)]).astype(self.dtype, copy=False)
        whole = -(-n // self.seq_len) * self.seq_len
        ids, mask = np.zeros(whole, self.dtype), np.arange(whole) < n
        ids[:n] = flat[:n]
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((ids, mask), self.schema)]
        if n:
            self.data.file.write_batch(pa.record_batch(lists, schema=self.schema))
        self.held, self.size = [flat[n:]], len(flat) - n

    def _flush_docs(self) -> None:
        if self.docs:
            cols = [pa.array(x, pa.int64()) for x in zip(*self.docs)]
            self.index.file.write_batch(pa.record_batch(cols, schema=self.index_schema))
            self.docs = []

    def close(self) -> int:
        self._flush(self.size)
        self._flush_docs()
        self.data.close()
        self.index.close()
        return self.tokens


class TokenFile:
    """Random access to a shard: ``sequence(i)`` and ``mask(i)`` are views of the mapped file."""

    def __init__(self, path: str):
        fs, name = _open(path)
        self.source = pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name)
        self.file = pa.ipc.open_file(self.source)
        self.batches = [self.file.get_batch(i) for i in range(self.file.num_record_batches)]
        self.rows = np.cumsum([0, *(b.num_rows for b in self.batches)])

    def __len__(self) -> int:
        return int(self.rows[-1])

    def _row(self, i: int, column: int) -> pa.Array:
        k = int(np.searchsorted(self.rows, i, side="right")) - 1
        lists = self.batches[k].column(column)
        n = lists.type.list_size
        return lists.values.slice((int(i - self.rows[k]) + lists.offset) * n, n)

    def sequence(self, i: int) -> np.ndarray:
        return self._row(i, 0).to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> pa.BooleanArray:
        return self._row(i, 1)

    def tokens(self) -> Iterator[np.ndarray]:
        """The shard's ids without padding, a batch at a time."""
        for b in self.batches:
            yield b.column(0).values.to_numpy(zero_copy_only=True)[: b.column(1).values.true_count]


def write_token_files(df: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                      seq_len: int = SEQ_LEN, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Tokenizes ``df`` into files under ``folder`` (default: a new one beside the staged tables).

    Returns one row per shard: shard, path, docs, tokens, base (tokens of the shards before it). Shards
    are ranges of doc_id, ascending; their number follows the text's size, and they are dealt to tasks
    by hash. Null and empty texts consist of ``end_id`` alone. Null doc_ids come first; rows with one
    doc_id stand in order of their ids, and go to one shard, which is written as it is read. An empty
    table writes no file. Other columns of ``df`` are ignored, whatever they are called.
    """
    spark = df.sparkSession
    folder = folder or f"{checkpoint_root(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    fs, where = _open(folder)
    fs.create_dir(where, recursive=True)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    n = -(-int(size) // shard_bytes)
    bounds = np.array([] if n < 2 else sorted(set(docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] or [])), np.int64)
    dtype = encoder(tokenizer).dtype

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in small_batches(batches):
            keys = [0 if k is None else int(np.searchsorted(bounds, k, side="left")) for k in b.column(0).to_pylist()]
            ids = [enc.encode(t) + end for t in b.column(1).to_pylist()]
            yield pa.record_batch([pa.array(keys, pa.int32()), b.column(0), pa.array(ids, pa.binary())], names=["shard", "doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, at, docs_in = None, None, 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"shard": at, "path": f"{writer.name}.arrow", "docs": docs_in, "tokens": writer.close()}],
                                              schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

        for b in small_batches(batches):
            for shard, doc_id, ids in zip(*(c.to_pylist() for c in b.columns)):
                if shard != at:
                    if writer:
                        yield done()
                    writer, at, docs_in = ShardWriter(folder, shard, dtype, seq_len), shard, 0
                writer.add(doc_id, np.frombuffer(ids, dtype))
                docs_in += 1
        if writer:
            yield done()

    dealt = docs.mapInArrow(tokenize, "shard int, doc_id long, ids binary").repartition("shard")
    dealt = dealt.sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    shards = stage(dealt.mapInArrow(write, "shard int, path string, docs long, tokens long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_token_files(shards: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start (over all shards), n_tokens, ids_crc32 (of the
    ids as little-endian unsigned 32-bit integers), shard."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, path, base in zip(*(c.to_pylist() for c in b.columns)):
                yield from _documents(shard, path, base)

    dealt = shards.select("shard", "path", "base").repartition("shard")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def _documents(shard: int, path: str, base: int) -> Iterator[pa.RecordBatch]:
    index = TokenFile(path.removesuffix(".arrow") + ".index.arrow")
    stream, held = TokenFile(path).tokens(), np.empty(0, "<u4")
    for b in index.batches:
        crcs = []
        for n in b.column(2).to_pylist():
            crc = 0
            while n:
                if not len(held):
                    held = next(stream)
                take, held = held[:n], held[n:]
                crc = zlib.crc32(take.astype("<u4").tobytes(), crc)
                n -= len(take)
            crcs.append(crc)
        start = pa.array(b.column(1).to_numpy() + base)
        yield pa.record_batch([b.column(0), start, b.column(2), pa.array(crcs, pa.int64()), pa.array([shard] * b.num_rows, pa.int32())],
                              names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
