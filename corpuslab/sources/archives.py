"""Crawl-archive sources.

* ``archive_paths``: a gzipped path list, trimmed, blank lines dropped, numbered in file order (S1).
* ``probe_archives``: per file size, SHA-256 and gzip readability (S2, S4). A truncated or corrupt
  archive is rejected whole and counted once, as in the reference; Spark's ``ignoreCorruptFiles``
  would keep the readable prefix instead.
* ``raw_inventory``: the raw-input manifest's rows: where each archive came from, under which licence (S2).
* ``read_wet``: records of readable archives (S3), split where ``WARC/1.0`` ends its line. Invalid UTF-8 is
  replaced (C10). Order key: (file_index, record_no).

Spark lists the files; tasks stream them, a chunk of ``CHUNK`` bytes at a time, so that an archive may have any size and
only one record is held whole. An archive is read by one task (gzip can't be split), twice: once by the probe, which
decides about it as a whole, and once for its records. Paths are opened by ``pyarrow.fs``: local-style mounts, ``s3://``,
``gs://`` or ``hdfs://``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators.ordering import dense_positions
from corpuslab.session import stage

BREAK = re.compile(rb"WARC/1\.0\r?\n")
LONGEST_BREAK = 10
BLANK_LINE = r"(?:\A|\n)\r*+(?:\n|\z)"  # with the line ends around it
CHUNK = 1 << 18
BATCH_BYTES = 1 << 20  # text of an Arrow batch, but for its last record
READ_BYTES = 16 << 20  # archive bytes that a task reads, on average
LICENSE = "https://commoncrawl.org/terms-of-use/"


def archive_paths(spark: SparkSession, path: str) -> DataFrame:
    """(path_index, path) from a (gzipped) text list of archive paths, in file order."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("_i"), F.trim("value").alias("path"))
    # ids grow along the file
    numbered = dense_positions(lines.filter(F.col("path") != ""), ["_i"], "_n", persist_input=True)
    return numbered.select((F.col("_n") + 1).alias("path_index"), "path").orderBy("path_index")


def _stream(path: str):
    from pyarrow import fs

    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem().open_input_stream("/" + path.removeprefix("file:").lstrip("/"), compression=None)
    files, where = fs.FileSystem.from_uri(path)
    return files.open_input_stream(where, compression=None)


def _raw(stream) -> Iterator[bytes]:
    while chunk := stream.read(CHUNK):
        yield chunk


def decoded(raw: Iterable[bytes]) -> Iterator[bytes]:
    """Content of whole gzip members up to the last byte, in pieces of at most ``CHUNK`` bytes; ``zlib.error`` if there
    is anything else. Zero padding after the last member is refused too."""
    member = None
    for chunk in raw:
        while chunk:
            member = member or zlib.decompressobj(wbits=31)
            more = True
            while more:  # output may be left when the input is used up
                out = member.decompress(chunk, CHUNK)
                chunk = member.unconsumed_tail
                if out:
                    yield out
                more = bool(out) and not member.eof
            if member.eof:  # its tail is in unused_data, whatever unconsumed_tail holds
                chunk, member = member.unused_data, None
    if member is not None:
        raise zlib.error("the last gzip member is cut short")


def blocks(pieces: Iterable[bytes]) -> Iterator[str]:
    """The texts between separators, blank ones left out."""
    held, searched = bytearray(), 0
    for piece in pieces:
        held += piece
        at = 0
        for m in BREAK.finditer(held, max(0, searched - LONGEST_BREAK + 1)):
            yield held[at : m.start()].decode("utf-8", "replace")
            at = m.end()
        held = held[at:] if at else held
        searched = len(held)
    yield held.decode("utf-8", "replace")


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests, readable = [], []
        for path in b.column(0).to_pylist():
            digest = hashlib.sha256()
            with _stream(path) as stream:

                def hashed():
                    for chunk in _raw(stream):
                        digest.update(chunk)
                        yield chunk

                raw = hashed()
                try:
                    for _ in decoded(raw):
                        pass
                    readable.append(True)
                except zlib.error:
                    readable.append(False)
                for chunk in _raw(stream):  # what a damaged archive has left
                    digest.update(chunk)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests), pa.array(readable)],
                                         names=[*b.schema.names, "raw_checksum_sha256", "readable"])


def probe_archives(spark: SparkSession, path_glob: str) -> DataFrame:
    """S2 + S4: (path, size_bytes, modified_at, raw_checksum_sha256, readable), each file read once, whatever its size."""
    listed = spark.read.format("binaryFile").load(path_glob).select(  # without content: names and sizes only
        "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    return listed.mapInArrow(_probe, "path string, size_bytes long, modified_at timestamp, raw_checksum_sha256 string, readable boolean")


def raw_inventory(files: DataFrame, crawl_id: str, base_url: str, source_name: str = "common_crawl", license: str = LICENSE) -> DataFrame:
    """The raw-input manifest's rows of probed ``files``: source_name, crawl_id, source_url (``base_url`` and the
    ``rel_path`` that the path list names; null where ``files`` has none), retrieved_at, license, raw_checksum_sha256,
    artifact_location, size_bytes."""
    rel = F.col("rel_path") if "rel_path" in files.columns else F.lit(None).cast("string")
    return files.select(
        F.lit(source_name).alias("source_name"), F.lit(crawl_id).alias("crawl_id"), F.concat(F.lit(base_url), rel).alias("source_url"),
        F.col("modified_at").alias("retrieved_at"), F.lit(license).alias("license"), "raw_checksum_sha256",
        F.col("path").alias("artifact_location"), "size_bytes")


def _header(lines, key: str):
    named = F.filter(lines, lambda x: x.contains(":") & (F.lower(T.py_strip(F.substring_index(x, ":", 1))) == F.lit(key)))
    return T.py_strip(F.regexp_extract(F.try_element_at(named, F.lit(-1)), r"^[^:]*:(.*)$", 1))


def parse_records(raw: DataFrame) -> DataFrame:
    """F1-F3 on (file_index, record_no, block) rows: header block up to the first blank line
    (lines right-stripped of '\\r'), keys lower-cased and trimmed, last duplicate wins; keep
    ``warc-type = conversion`` with a non-empty body; URI defaults to ''. A block without a blank
    line is taken whole as body."""
    # cut at the first blank line; the body's lines are never taken apart
    cut = F.split(F.col("block"), BLANK_LINE, 2)
    headers = F.transform(F.split(cut[0], "\n", -1), lambda x: F.regexp_replace(x, "\r+$", ""))
    parsed = raw.select(
        "file_index", "record_no",
        F.coalesce(_header(headers, "warc-type"), F.lit("")).alias("warc_type"),
        F.coalesce(_header(headers, "warc-target-uri"), F.lit("")).alias("uri"),
        T.py_strip(F.element_at(cut, -1)).alias("content"),
    )
    return parsed.filter((F.col("warc_type") == "conversion") & (F.length("content") > 0)).drop("warc_type")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                           pa.array([r[2] for r in rows], pa.string())], names=["file_index", "record_no", "block"])

    rows, size = [], 0
    for b in batches:
        for path, file_index in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            with _stream(path) as stream:
                for i, block in enumerate(x for x in blocks(decoded(_raw(stream))) if x and not x.isspace()):
                    rows.append((file_index, i, block))
                    size += len(block)
                    if size >= BATCH_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
    if rows:
        yield batch(rows)


def read_wet(spark: SparkSession, files: DataFrame) -> DataFrame:
    """S3: (file_index, record_no, uri, content) of the readable files of ``files`` (path, size_bytes, readable,
    file_index). ``record_no`` counts a file's blocks that are not blank, from 0."""
    good = files.filter("readable").select("path", F.col("file_index").cast("long").alias("file_index"), "size_bytes")
    size = good.agg(F.sum("size_bytes")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // READ_BYTES))  # by number: rows of a few bytes would be coalesced
    # by range, which deals consecutive archives out evenly; a hash would give some tasks several and others none
    dealt = good.select("path", "file_index").repartitionByRange(tasks, "file_index", "path")
    return parse_records(dealt.mapInArrow(_records, "file_index long, record_no long, block string"))


def normalize_archives(spark: SparkSession, path_glob: str) -> tuple[DataFrame, DataFrame]:
    """The reference's normalize phase over archives: (passed records, per-file stats incl. the
    ``rejected_malformed`` count of unreadable files)."""
    from corpuslab.operators import quality

    # one row per file, read by all branches below
    numbered = dense_positions(probe_archives(spark, path_glob), ["path"], "_n", persist_input=True)
    files = stage(numbered.withColumn("file_index", F.col("_n") + 1).drop("_n"), "archives")
    recs = read_wet(spark, files)
    cls = quality.classify(recs, "content")
    passed = cls.filter(F.col("reason") == "passed").select("file_index", "record_no", "uri",
                                                            F.col("norm_text").alias("text"), "content_hash")
    key = F.when(F.col("reason") == "passed", F.lit("passed")).otherwise(F.concat(F.lit("rejected_"), F.col("reason")))
    # one pass for the counts by verdict and in all
    rolled = cls.select("file_index", key.alias("reason")).groupingSets([["file_index", "reason"], ["file_index"]], "file_index", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("reason").alias("_all"))
    counts = rolled.select("file_index", F.when(F.col("_all") == 1, "total").otherwise(F.col("reason")).alias("reason"), "n")
    malformed = files.filter(~F.col("readable")).select("file_index", F.lit("rejected_malformed").alias("reason"),
                                                        F.lit(1).cast("long").alias("n"))
    stats = counts.unionByName(malformed).join(files.select("file_index", "path"), on="file_index")
    return passed, stats
