"""Crawl-archive round trip over data derived from ``documents``.

Every document is written as a WARC ``conversion`` record into gzipped archives under the
checkpoint folder (one archive per input split), then read back through the archive probe, the
``WARC/1.0`` split, the header parse, the quality filter and normalization: the reference's
normalize phase, run over the whole table.

The ``archive_*`` queries run over a second set, an archive of every ``PER_ARCHIVE`` documents, in which
``doc_id % 10`` picks a record's form (see ``_record``) and every fifth archive isn't gzip at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import constants as K
from corpuslab.sources import archives
from corpuslab.session import checkpoint_root, read_table, spread, stage


def write_wet_archives(spark: SparkSession, sf_dir: str) -> str:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    block = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: conversion\r\nWARC-Target-URI: doc://"), F.col("source"), F.lit("/"),
        F.col("doc_id").cast("string"), F.lit("\r\nContent-Type: text/plain\r\nContent-Length: "),
        F.octet_length("text").cast("string"), F.lit("\r\n\r\n"), F.col("text"), F.lit("\r\n\r\n"),
    )
    path = f"{checkpoint_root(spark).rstrip('/')}/staged/wet-{uuid.uuid4().hex}"
    docs.select(block.alias("value")).write.option("compression", "gzip").text(path)
    return path


def wet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_wet_archives(spark, sf_dir)
    passed, _stats = archives.normalize_archives(spark, f"{path}/*.gz")
    return passed.select("uri", "content_hash", F.octet_length("text").cast("long").alias("n_bytes"))


PER_ARCHIVE = 250  # ids in one archive, so that their number grows with the table


def _record() -> F.Column:
    """1: not a conversion. 2: LF line ends. 3: the separator's words inside a line. 4: a header given twice.
    5: no URI. 6: empty. 7: boilerplate lines. 8: too short once blanks are collapsed. 9: a combining accent,
    tabs and a run of newlines. Others: plain."""
    form = F.pmod("doc_id", F.lit(10))
    eol = F.when(form == 2, "\n").otherwise("\r\n")
    lines = F.lit("\n".join(K.BOILERPLATE_LINES * 2))
    body = (
        F.when(form == 3, F.concat(F.lit("About WARC/1.0 records. "), "text"))
        .when(form == 6, "").when(form == 7, lines)
        .when(form == 8, "ab" * 40 + " " * 60 + "ab" * 40)
        .when(form == 9, F.concat(F.lit("e\u0301\t\tx\n\n\n\n"), "text")).otherwise(F.col("text")))
    uri = F.concat(F.lit("WARC-Target-URI: doc://"), F.col("doc_id").cast("string"))
    headers = F.array_compact(F.array(
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(form == 1, "request").otherwise("conversion")),
        F.when(form == 4, "WARC-Target-URI: old://"),
        F.when(form != 5, uri), F.lit("")))
    # Spark's text writer ends the record with a line feed
    return F.concat(F.array_join(F.transform(headers, lambda h: F.concat(h, eol)), ""), F.coalesce(body, F.lit("")), eol)


def write_mixed_archives(spark: SparkSession, sf_dir: str) -> str:
    docs = read_table(spark, sf_dir, "documents")
    archive = F.floor(F.col("doc_id") / PER_ARCHIVE)
    records = docs.select(archive.alias("archive"), "doc_id", _record().alias("value"))
    path = f"{checkpoint_root(spark).rstrip('/')}/staged/mixed-{uuid.uuid4().hex}"
    bad = F.pmod("archive", F.lit(5)) == 3
    for name, rows, codec in (("gzip", records.where(~bad), "gzip"), ("plain", records.where(bad), "none")):
        rows.repartition("archive").sortWithinPartitions("archive", "doc_id").select("archive", "value") \
            .write.partitionBy("archive").option("compression", codec).text(f"{path}/{name}")
    return f"{path}/*/archive=*/part-*"


def _archive(path: str = "path") -> F.Column:
    return F.regexp_extract(path, r"archive=(\d+)/", 1).cast("long").alias("archive")


def archive_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every archive, whether its checksum is there and whether it can be read."""
    found = archives.probe_archives(spark, write_mixed_archives(spark, sf_dir))
    return found.select(_archive(), "readable", (F.length("raw_checksum_sha256") == 64).alias("has_checksum"),
                        (F.col("size_bytes") > 0).alias("has_bytes"))


def raw_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw-input manifest: each archive's address, licence and checksum, and the totals of all."""
    found = archives.probe_archives(spark, write_mixed_archives(spark, sf_dir))
    found = stage(found.withColumn("rel_path", F.concat(F.lit("archive-"), F.regexp_extract("path", r"archive=(\d+)/", 1), F.lit(".wet.gz"))), "inventory")
    rows = archives.raw_inventory(found, "CL-2026-01", "https://archives.example/")
    key = ["source_name", "crawl_id", "license"]
    files = rows.select(*key, "source_url", F.lit(1).cast("long").alias("file_count"), (F.length("raw_checksum_sha256") == 64).alias("complete"))
    total = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("file_count"), F.bool_and(F.col("size_bytes") > 0).alias("complete"))
    return files.unionByName(total.withColumn("source_url", F.lit("*")))


def archive_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passed records of the readable archives."""
    passed, _stats = archives.normalize_archives(spark, write_mixed_archives(spark, sf_dir))
    return passed.select("uri", "content_hash", F.octet_length("text").cast("long").alias("n_bytes"))


def archive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of an archive by verdict, and the archives that can't be read."""
    _passed, stats = archives.normalize_archives(spark, write_mixed_archives(spark, sf_dir))
    return stats.select(_archive(), "reason", "n")
