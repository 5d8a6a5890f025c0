"""Stream twins of batch queries: they read the driver's tables as streams, up to what is there now."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.session import checkpoint_root, read_table
from corpuslab.sources import derived as D
from corpuslab.streaming import corpus, steps, telemetry
from corpuslab.streaming.runner import run_as_arrived, run_to_table, slice_of, table_stream

PARTS = 6  # of the readings' time range, one arrival each; readings far too late come as one more


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = D.telemetry_of(table_stream(spark, sf_dir, "events"))
    return readings.withColumn("ts", F.col("ts").cast("timestamp"))  # event time must carry a zone


def stream_gpu_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, ST2: the windows that the watermark has closed."""
    out = run_to_table(telemetry.window_means_stream(_readings(spark, sf_dir)), "gpu-means")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5, ST6: documents kept by the restartable incremental build."""
    root = f"{checkpoint_root(spark).rstrip('/')}/streams/dedup-{uuid.uuid4().hex}"
    docs = table_stream(spark, sf_dir, "documents")
    corpus.incremental_dedup(docs, f"{root}/kept", f"{root}/progress").awaitTermination()
    return spark.read.parquet(f"{root}/kept").select("doc_id", "content_hash")


def stream_dedup_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5, ST6: documents arrive in three parts, and the build is started anew for each, against the hashes kept so far."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("_part", slice_of(docs, "doc_id", 3))
    root = run_as_arrived(docs, "_part", 3, "dedup-arrivals", lambda s, at: corpus.incremental_dedup(s, f"{at}/kept", f"{at}/progress"))
    return spark.read.parquet(f"{root}/kept").select("doc_id", "content_hash")


def stream_idle_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3: alarms over readings that arrive up to 7.5 minutes late, thus out of order, within the watermark's delay; every
    53rd of the first third arrives after all others, beyond the delay, and does not count."""
    readings = D.telemetry(spark, sf_dir).select("instance_id", F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")
    readings = readings.withColumn("_at", F.unix_micros("ts") + F.pmod("event_id", F.lit(4)) * 150_000_000)
    readings = readings.withColumn("_part", slice_of(readings, "_at", PARTS))
    lost = (F.pmod("event_id", F.lit(53)) == 7) & (F.col("_part") < PARTS // 3)
    readings = readings.withColumn("_part", F.when(lost, PARTS).otherwise(F.col("_part"))).drop("_at", "event_id")

    def start(stream: DataFrame, root: str):
        return (telemetry.idle_alarm_stream(stream).writeStream.format("parquet").option("path", f"{root}/rows")
                .option("checkpointLocation", f"{root}/progress").outputMode("append").trigger(availableNow=True).start())

    root = run_as_arrived(readings, "_part", PARTS + 1, "idle-alarm", start)
    out = spark.read.schema(telemetry.ALARM_OUT).parquet(f"{root}/rows")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4, F14: step metrics of runs that arrive in three parts, those of non-finite loss in quarantine."""
    given = D.step_events(spark, sf_dir).select(*steps.COLUMNS)
    given = given.withColumn("_part", slice_of(given, "ts_us", 3))
    root = run_as_arrived(given, "_part", 3, "steps", lambda s, at: steps.step_metrics(s, at, f"{at}/progress"))
    tables = [spark.read.parquet(f"{root}/{name}").drop("batch_id", "loss").withColumn("sink", F.lit(name)) for name in ("steps", "quarantine")]
    return tables[0].unionByName(tables[1])
