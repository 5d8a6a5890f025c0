"""JSONL / manifest / log sources and the sinks.

Everything is a DataFrame reader or writer; nothing is read through the driver except one-row
manifests.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

NORMALIZED_SCHEMA = "uri string, text string, content_hash string"


def read_jsonl(spark: SparkSession, path: str, schema: str | ST.StructType = NORMALIZED_SCHEMA) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, a bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, UTF-8, non-ASCII kept as is, null fields written as null."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_manifest(spark: SparkSession, path: str, schema: str | ST.StructType | None = None) -> DataFrame:
    """A (multi-line) JSON manifest; a missing file gives an empty table (callers left-join
    and ``coalesce`` to the reference's defaults)."""
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.json(path)
    except Exception as e:  # noqa: BLE001 - missing path
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            if schema is None:
                return spark.createDataFrame([], "run_name string")
            return spark.createDataFrame([], schema)
        raise


def write_manifest(df: DataFrame, path: str) -> None:
    """One JSON document per row as a single text file (manifests are one row)."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def newest_artifact(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """Per directory under ``root`` the newest file matching ``glob`` (content is not read)."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        .load(root).select("path", "modificationTime")
    )
    d = files.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]+$", 1))
    return d.groupBy("dir").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"),
                                F.max("modificationTime").alias("modified_at"))


def publish_versioned(df: DataFrame, root: str, version: str, pointer_root: str | None = None, kind: str = "datasets") -> str:
    """Write ``root/<kind>/<version>`` once (fails if it exists), then point ``latest`` at it, so a
    reader never sees a pointer to a partial version. ``kind`` is ``datasets`` or ``models``."""
    target = f"{root.rstrip('/')}/{kind}/{version}"
    df.write.mode("errorifexists").parquet(target)
    point_latest(df.sparkSession, pointer_root or root, kind, version, target)
    return target


def _pointer(root: str, kind: str) -> str:
    return f"{root.rstrip('/')}/latest" if kind == "datasets" else f"{root.rstrip('/')}/{kind}/latest"


def point_latest(spark: SparkSession, root: str, kind: str, version: str, location: str | None = None) -> None:
    """Replaces the pointer ``latest`` in one step: the new one is written beside it and renamed over it, so a reader
    at any time finds the old one or the new one. A local or mounted folder renames by POSIX, other
    stores by Hadoop's rename with overwrite, which HDFS does in one step."""
    jvm, pointer = spark._jvm, _pointer(root, kind)
    content = json.dumps({"version": version, "location": location or f"{root.rstrip('/')}/{kind}/{version}"}).encode()
    hadoop = jvm.org.apache.hadoop.fs
    done = hadoop.Path(pointer)
    store = done.getFileSystem(spark._jsc.hadoopConfiguration())
    done = store.makeQualified(done)
    store.mkdirs(done.getParent())
    new = hadoop.Path(done.getParent(), f".latest-{uuid.uuid4().hex}")
    if store.getScheme() == "file":
        with open(new.toUri().getPath(), "wb") as out:
            out.write(content)
        os.replace(new.toUri().getPath(), done.toUri().getPath())
        return
    out = store.create(new, True)
    out.write(bytearray(content))
    out.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(done.toUri(), spark._jsc.hadoopConfiguration()).rename(new, done, over)


def read_latest(spark: SparkSession, root: str, kind: str = "datasets") -> tuple[DataFrame, str]:
    """The rows and the version that ``latest`` names now. The pointer is read once, so a publish meanwhile changes nothing."""
    found = spark.read.schema("version string, location string").json(_pointer(root, kind)).first()
    return spark.read.parquet(found.location), found.version


STEP_LINE = (r"Step (\d+)/(\d+) \| Loss: ([0-9.eE+-]+|(?i:nan|-?inf(?:inity)?)) \| LR: ([0-9.eE+-]+) \| "
             r"Tokens/sec: ([0-9.]+) \| GPU Mem: ([0-9.]+)MB")
RESUME_LINE = r"Resumed from step (\d+)"


def training_log_progress(spark: SparkSession, path: str) -> DataFrame:
    """Per log file, the last logged step (by line order), its loss, learning rate, throughput and GPU memory, and the
    step the run resumed from (null when it never resumed)."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), "value"
    )  # ids grow along each file (read sequentially by one task), so they order a file's lines
    step = F.regexp_extract("value", STEP_LINE, 1).try_cast("long")
    parsed = lines.select(
        "file", "line_no",
        F.when(step.isNotNull(), step).alias("step"),
        F.when(step.isNotNull(), F.regexp_extract("value", STEP_LINE, 3).try_cast("double")).alias("loss"),
        F.when(step.isNotNull(), F.regexp_extract("value", STEP_LINE, 5).try_cast("double")).alias("tokens_per_sec"),
        F.when(step.isNotNull(), F.regexp_extract("value", STEP_LINE, 4).try_cast("double")).alias("lr"),
        F.when(step.isNotNull(), F.regexp_extract("value", STEP_LINE, 6).try_cast("double")).alias("gpu_mem_mb"),
        F.regexp_extract("value", RESUME_LINE, 1).try_cast("long").alias("resumed"),
    )
    return parsed.groupBy("file").agg(
        F.max_by("step", F.when(F.col("step").isNotNull(), F.col("line_no"))).alias("last_step"),
        F.max_by("loss", F.when(F.col("step").isNotNull(), F.col("line_no"))).alias("last_loss"),
        F.max_by("tokens_per_sec", F.when(F.col("step").isNotNull(), F.col("line_no"))).alias("last_tokens_per_sec"),
        F.max_by("lr", F.when(F.col("step").isNotNull(), F.col("line_no"))).alias("last_lr"),
        F.max_by("gpu_mem_mb", F.when(F.col("step").isNotNull(), F.col("line_no"))).alias("last_gpu_mem_mb"),
        F.max_by("resumed", F.when(F.col("resumed").isNotNull(), F.col("line_no"))).alias("resumed_from_step"),
    )


def packed_records(packed: DataFrame) -> DataFrame:
    """Each packed sequence as its on-disk record, ``L`` little-endian int32 values, keyed by
    ``seq_id`` (concatenating records in ``seq_id`` order gives the reference's ``packed.bin``)."""
    from corpuslab.functions.binary import int32_le

    return packed.select("seq_id", int32_le(F.col("tokens")).alias("record"))
