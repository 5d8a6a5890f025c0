"""Manifest assembly helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replay(raw_manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Each ``files[]`` entry of a raw-input manifest matched to the archive inventory on its
    location (left: a listed file that is gone keeps a row with null inventory columns)."""
    entries = raw_manifest.select("run_name", F.posexplode("files").alias("file_index", "f")).select(
        "run_name", "file_index", F.col("f.artifact_location").alias("path"),
        F.col("f.raw_checksum_sha256").alias("listed_checksum"))
    return replay_entries(entries, inventory)


def replay_entries(entries: DataFrame, inventory: DataFrame) -> DataFrame:
    """J9 on manifest entries that are rows already, so that no manifest's list is gathered."""
    return entries.join(inventory, on="path", how="left")


def lineage(datasets: DataFrame, runs: DataFrame, checkpoints: DataFrame, evals: DataFrame,
            published: DataFrame) -> DataFrame:
    """Dataset -> training run -> checkpoint -> eval -> published model, each link a left
    equi-join, so a chain that stops early keeps nulls after the last known link."""
    return (
        datasets.join(runs, on="dataset_version", how="left")
        .join(checkpoints, on="run_id", how="left")
        .join(evals, on="checkpoint_path", how="left")
        .join(published, on="checkpoint_path", how="left")
    )


def dataset_digest(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A4: content digest of a table, independent of file layout and row order. Each row is hashed
    (SHA-256 of its columns, each written as its length in bytes, ``:`` and its text, null as ``-``);
    all 256 bits of the hashes are summed exactly, in five parts (a multiset hash, so the aggregate is
    partial+final like any sum and never gathers rows), and the digest is SHA-256 of the count and the
    sums, joined by ``:``."""
    text = [F.col(c).cast("string") for c in cols]
    fields = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    hashed = df.select(F.sha2(F.concat(*fields), 256).alias("_h"))
    parts = [F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(28,0)") for i in range(5)]
    sums = [F.coalesce(F.sum(p).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias(f"_s{i}") for i, p in enumerate(parts)]
    t = hashed.agg(F.count(F.lit(1)).alias("n_rows"), *sums)
    joined = F.concat_ws(":", "n_rows", *[F.col(f"_s{i}").cast("string") for i in range(5)])
    return t.select("n_rows", F.sha2(joined, 256).alias("digest"))


def _mean(c: str) -> Column:
    return F.sum(c).cast("double") / F.count(c)  # the sum of decimals is exact


def step_timing(steps: DataFrame) -> DataFrame:
    """A10: per step forward + backward in ms, and per run mean/total (``forward_sec``,
    ``backward_sec`` per step row)."""
    s = steps.select("run_name", "step", (F.col("forward_sec") * 1000).alias("forward_ms"),
                     (F.col("backward_sec") * 1000).alias("backward_ms"))
    s = s.withColumn("total_ms", F.col("forward_ms") + F.col("backward_ms"))
    return s.groupBy("run_name").agg(F.count(F.lit(1)).alias("steps"), _mean("forward_ms").alias("avg_forward_ms"),
                                     _mean("backward_ms").alias("avg_backward_ms"), _mean("total_ms").alias("avg_total_ms"),
                                     F.sum("total_ms").cast("double").alias("total_ms"))


def first_n(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """L1: the first ``n`` rows in order (0 = all), a ``TakeOrderedAndProject`` when n > 0."""
    return df if n == 0 else df.orderBy(*order).limit(n)


def select_split(df: DataFrame, dataset_spec: str, split: str, split_col: str = "split") -> DataFrame:
    """``name/config`` dataset spec and a split; rows of that dataset, config and split."""
    name, _, config = dataset_spec.partition("/")
    cond = (F.col("dataset") == name) & (F.col(split_col) == split)
    if config:
        cond = cond & (F.col("config") == config)
    return df.filter(cond)


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A batched map with column drop: ``fn`` gets Arrow batches as pandas frames and returns
    the new columns only."""
    return df.mapInPandas(lambda it: (fn(b) for b in it), schema)
