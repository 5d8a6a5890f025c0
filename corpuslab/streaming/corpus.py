"""Incremental corpus build (ST5) with restartable progress (ST6).

New document files are classified and deduplicated against every hash kept so far. Each
micro-batch writes its survivors to ``<kept>/batch_id=<id>`` with overwrite, so re-running a batch
after a failure replaces its own output instead of appending twice; the anti join reads every
earlier batch but never the current one. Progress lives in the stream's ``checkpointLocation``.
The kept table is first cut down to the hashes that the batch has too, then anti-joined; adaptive
execution broadcasts the batch's side where its measured size is small.
"""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators import dedup, quality


def _batch_writer(kept_path: str):
    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cls = quality.classify(batch.select("doc_id", "text")).filter(F.col("reason") == "passed")
        firsts = dedup.keep_first(cls.select("doc_id", F.col("norm_text").alias("text"), "content_hash"))
        to = os.path.join(kept_path, f"batch_id={batch_id}")
        try:
            earlier = spark.read.parquet(kept_path).filter(F.col("batch_id") != batch_id).select("content_hash")
        except Exception as e:  # noqa: BLE001 - nothing kept yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            firsts.write.mode("overwrite").parquet(to)  # read once, so not persisted
            return
        firsts = firsts.persist(StorageLevel.MEMORY_AND_DISK)  # read by the semi join and the anti join
        try:
            seen = earlier.join(firsts.select("content_hash"), on="content_hash", how="left_semi")
            firsts.join(seen, on="content_hash", how="left_anti").write.mode("overwrite").parquet(to)
        finally:
            firsts.unpersist()
    return process


def incremental_dedup(docs_stream: DataFrame, kept_path: str, checkpoint: str, available_now: bool = True):
    """ST5: start the query; returns the ``StreamingQuery``. The final kept set equals batch
    keep-first over all documents when files arrive in order-key order."""
    w = docs_stream.writeStream.foreachBatch(_batch_writer(kept_path)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
