"""Checkpoint catalogue and artifact bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.ordering import dense_positions


def checkpoint_step(path_col: str = "path"):
    """Numeric step of a ``checkpoint-<n>`` directory name, null when not numeric."""
    return F.regexp_extract(F.element_at(F.split(F.col(path_col), "/"), -1), r"^checkpoint-(\d+)$", 1).try_cast("long")


def is_valid(ck: DataFrame) -> DataFrame:
    """sharded = model shards and train state present; full = state file present and its
    checksum equals the recorded one (sharded ones carry no checksum: ``verified`` = false)."""
    valid = F.when(F.col("sharded"), F.col("has_model") & F.col("has_train_state")).otherwise(
        F.col("has_state") & F.col("checksum").isNotNull() & (F.col("checksum") == F.col("actual_checksum"))
    )
    return ck.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn("verified", ~F.col("sharded"))


def latest_valid(ck: DataFrame) -> DataFrame:
    """Per run the newest valid checkpoint (falls back to older ones when newer are bad)."""
    v = is_valid(ck).filter("valid")
    return v.groupBy("run_name").agg(F.max_by("path", "step").alias("path"), F.max("step").alias("step"))


def retention(ck: DataFrame, keep: int = 3) -> DataFrame:
    """Per run, checkpoints beyond the newest ``keep`` (by step) are expired."""
    pos = dense_positions(ck.select("run_name", "step"), [("step", True)], "_rank", group=["run_name"])
    return pos.select("run_name", "step", (F.col("_rank") >= keep).alias("expired"))


def rank_agreement(reports: DataFrame) -> DataFrame:
    """All ranks restored the same step, else the restore is discarded (step 0)."""
    g = reports.groupBy("checkpoint").agg(
        F.count(F.lit(1)).alias("n_ranks"), F.count_distinct("step").alias("_d"), F.min("step").alias("_s")
    )
    agreed = F.col("_d") == 1
    return g.select("checkpoint", "n_ranks", agreed.alias("agreed"),
                    F.when(agreed, F.col("_s")).otherwise(F.lit(0)).alias("step"))


def integrity(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """Recorded (path, checksum) vs recomputed (path, checksum): ok / corrupt / missing /
    unlisted. One full outer join on path."""
    j = manifest.select("path", F.col("checksum").alias("_rec")).join(
        observed.select("path", F.col("checksum").alias("_obs")), on="path", how="full_outer"
    )
    status = (
        F.when(F.col("_obs").isNull() & F.col("_rec").isNotNull(), F.lit("missing"))
        .when(F.col("_rec").isNull(), F.lit("unlisted"))
        .when(F.col("_rec") == F.col("_obs"), F.lit("ok"))
        .otherwise(F.lit("corrupt"))
    )
    return j.select("path", status.alias("status"))


def artifact_kind(listing: DataFrame) -> DataFrame:
    """an artifact holding ``state.pt`` but no ``config.json`` is a raw checkpoint."""
    name = F.element_at(F.split("rel_path", "/"), -1)
    g = listing.groupBy("artifact").agg(F.bool_or(name == "state.pt").alias("_s"), F.bool_or(name == "config.json").alias("_c"))
    return g.select("artifact", F.when(F.col("_s") & ~F.col("_c"), F.lit("raw_checkpoint")).otherwise(F.lit("serveable")).alias("kind"))


def artifact_index(listing: DataFrame) -> DataFrame:
    """Relative file list in path order per artifact (bounded by the artifact's files)."""
    return listing.groupBy("artifact").agg(F.sort_array(F.collect_list("rel_path")).alias("files"))


def directory_digest(files: DataFrame) -> DataFrame:
    """Per artifact, SHA-256 over (relative path + SHA-256 of content) in path order, file
    count and byte sum. ``files``: (artifact, rel_path, content binary). The per-file digests are
    computed where the bytes are; only 64-char digests are gathered per artifact."""
    per_file = files.select("artifact", "rel_path", F.sha2("content", 256).alias("h"), F.length("content").alias("n"))
    g = per_file.groupBy("artifact").agg(
        F.sort_array(F.collect_list(F.struct("rel_path", "h"))).alias("_p"),
        F.count(F.lit(1)).alias("artifact_file_count"), F.sum("n").alias("artifact_size_bytes"),
    )
    joined = F.array_join(F.transform("_p", lambda x: F.concat(x["rel_path"], F.lit("\t"), x["h"])), "\n")
    return g.select("artifact", F.concat(F.lit("sha256:"), F.sha2(joined, 256)).alias("artifact_checksum"),
                    "artifact_file_count", "artifact_size_bytes")
