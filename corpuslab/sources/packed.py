"""Packed token shards as a Spark data source (S7): ``packed_shards``.

Writing: each task streams its sequences, little-endian int32 records of one length, into a file of its own under
``_writing``; only when all tasks are done does the commit name the files ``shard-00000.bin`` and so on, in order of their
first ``seq_id``, and put ``index.json`` beside them last. A task that fails or is run twice leaves nothing a reader
sees: readers go by the index alone. Reading: a partition a shard, in batches of bounded size.

Rows are (seq_id long, tokens array<int>); sort them by ``seq_id`` (``repartitionByRange`` and ``sortWithinPartitions``)
for shards that are consecutive pieces of the reference's ``packed.bin``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as ST
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

BATCH = 4096  # sequences of a batch read
SCHEMA = "seq_id long, tokens array<int>"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _uri(path: str) -> str:
    """``file:/x`` as Spark writes it to ``file:///x``."""
    return f"file:///{path[5:].lstrip('/')}" if path.startswith("file:") else path


@dataclass
class Written(WriterCommitMessage):
    name: str
    first: int
    last: int
    n: int
    length: int


@dataclass
class Shard(InputPartition):
    name: str
    first: int
    n: int
    length: int


class PackedWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, root = _files(self.path)
        name, first, last, n, length, out = f"{uuid.uuid4().hex}.bin", 0, -1, 0, 0, None
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                ids, tokens = b.column(0).to_numpy(), b.column(1)
                sizes = np.diff(tokens.offsets.to_numpy())
                if tokens.null_count or (sizes != (length or sizes[0])).any():
                    raise ValueError("packed sequences have one length")
                if out is None:
                    files.create_dir(f"{root}/_writing", recursive=True)
                    out, first, last, length = files.open_output_stream(f"{root}/_writing/{name}"), int(ids[0]), int(ids[0]) - 1, int(sizes[0])
                if (np.diff(np.append(last, ids)) != 1).any():
                    raise ValueError("a task's sequences are consecutive and sorted by seq_id")
                out.write(tokens.flatten().to_numpy().astype("<i4").tobytes())
                last, n = int(ids[-1]), n + len(ids)
        finally:
            if out is not None:
                out.close()
        return Written(name, first, last, n, length)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _files(self.path)
        files.create_dir(root, recursive=True)
        shards = []
        for i, m in enumerate(sorted((m for m in messages if m and m.n), key=lambda m: m.first)):
            files.move(f"{root}/_writing/{m.name}", f"{root}/shard-{i:05d}.bin")
            shards.append({"name": f"shard-{i:05d}.bin", "first": m.first, "n": m.n, "length": m.length})
        with files.open_output_stream(f"{root}/_index") as out:
            out.write(json.dumps({"sequences": sum(s["n"] for s in shards), "shards": shards}).encode())
        files.move(f"{root}/_index", f"{root}/index.json")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        files, root = _files(self.path)
        if files.get_file_info(f"{root}/_writing").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/_writing")


class PackedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Shard]:
        files, root = _files(self.path)
        with files.open_input_stream(f"{root}/index.json") as f:
            return [Shard(**s) for s in json.loads(f.read())["shards"]] or [Shard("", 0, 0, 1)]

    def read(self, shard: Shard) -> Iterator[pa.RecordBatch]:
        if not shard.n:
            return
        files, root = _files(self.path)
        with files.open_input_stream(f"{root}/{shard.name}") as f:
            for at in range(0, shard.n, BATCH):
                m = min(BATCH, shard.n - at)
                flat = np.frombuffer(f.read(4 * m * shard.length), "<i4")
                ids = np.arange(shard.first + at, shard.first + at + m, dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * shard.length), pa.array(flat))
                yield pa.record_batch([pa.array(ids), lists], names=["seq_id", "tokens"])


class PackedShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PackedReader:
        return PackedReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> PackedWriter:
        files, root = _files(self.options["path"])
        if files.get_file_info(f"{root}/index.json").is_file:
            raise ValueError(f"{root} holds packed shards already")
        return PackedWriter(self.options["path"])


def _byte_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq_id, binary) to (seq_id, tokens)."""
    for b in batches:
        rows = b.column(1).to_pylist()
        ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        flat = np.frombuffer(b"".join(rows), np.uint8).astype(np.int32)
        yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["seq_id", "tokens"])


def _token_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq_id, tokens), each below 256, to (seq_id, binary)."""
    for b in batches:
        lists = b.column(1)
        flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        if len(flat) and (flat.min() < 0 or flat.max() > 255):
            raise ValueError("a byte token is 0 to 255")
        whole = flat.astype(np.uint8).tobytes()
        rows = [whole[lo:hi] for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.record_batch([b.column(0), pa.array(rows, pa.binary())], names=["seq_id", "packed"])


def token_bytes(packed: DataFrame) -> DataFrame:
    """(seq_id, packed binary) of byte tokens (seq_id, tokens)."""
    return packed.select("seq_id", "tokens").mapInArrow(_token_bytes, "seq_id long, packed binary")


def write_packed(packed: DataFrame, path: str, shards: int) -> None:
    """``packed`` (seq_id, tokens), every seq_id once and without gaps, as ``shards`` consecutive shards. ``tokens`` may be
    binary, a byte a token: it is sampled and shuffled as such and becomes integers in the task that writes them."""
    packed.sparkSession.dataSource.register(PackedShards)
    ranged = packed.select("seq_id", "tokens").repartitionByRange(shards, "seq_id").sortWithinPartitions("seq_id")
    if isinstance(packed.schema["tokens"].dataType, ST.BinaryType):
        ranged = ranged.mapInArrow(_byte_tokens, SCHEMA)
    ranged.write.format("packed_shards").mode("append").save(_uri(path))


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PackedShards)
    return spark.read.format("packed_shards").load(_uri(path))
