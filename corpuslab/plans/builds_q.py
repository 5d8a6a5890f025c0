"""Queries over whole builds: what differs between two, packed shards on disk, published versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators import tokens as TK
from corpuslab.operators.builds import diff_builds
from corpuslab.plans.tokenize import SEQ_LEN, corpus_docs
from corpuslab.session import checkpoint_root, stage
from corpuslab.sources import files
from corpuslab.sources.packed import read_packed, token_bytes, write_packed


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def build_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deduplicated corpus against a second build that lost, changed and gained documents."""
    build = corpus_docs(spark, sf_dir)
    text = F.when(F.col("doc_id") % 89 == 7, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    other = build.where(F.col("doc_id") % 97 != 5).select("doc_id", text.alias("text"))
    added = build.where(F.col("doc_id") % 211 == 3).select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "text")
    return diff_builds(build, other.union(added), "doc_id", ["text"])


def packed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus written as shards of int32 records and read back from them."""
    packed = TK.pack_bytes(corpus_docs(spark, sf_dir), SEQ_LEN)
    # a byte is a token; staged, since the range partitioner reads it twice
    packed = stage(packed.select("seq_id", F.col("packed").alias("tokens")), "packed")
    path = _folder(spark, "packed")
    write_packed(packed, path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return token_bytes(read_packed(spark, path)).select("seq_id", F.sha2("packed", 256).alias("seq_digest"))


def published_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader of ``latest`` gets after each publish of a dataset or a model, and after a return to the first."""
    docs = corpus_docs(spark, sf_dir)
    root = _folder(spark, "published")
    even = docs.where(F.col("doc_id") % 2 == 0)

    def seen(step: int, kind: str) -> DataFrame:
        rows, version = files.read_latest(spark, root, kind)
        return rows.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(step).alias("step"), F.lit(kind).alias("kind"), F.lit(version).alias("version"), "n_rows")

    files.publish_versioned(even, root, "v1")
    out = seen(1, "datasets")
    files.publish_versioned(docs, root, "v2")
    files.publish_versioned(even, root, "v1", kind="models")
    out = out.union(seen(2, "datasets")).union(seen(2, "models"))
    files.point_latest(spark, root, "datasets", "v1")
    return out.union(seen(3, "datasets"))
