"""Exact dedup by skew-safe combining, in DataFrame operations only.

Copies are combined three times, each time by digest and full normalised text: within a task (the
partial aggregate), among the tasks of a salt, and among the salts' winners. A text held by a third
of all rows thus reaches a reducer as one row per task, and its last reducer as one row per salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import join_hot, lower_az
from corpuslab.session import stage

SALTS = 16  # map tasks are dealt to so many first-level reducers per text


def _sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null counts as empty, so null and empty texts
    form one group. The largest doc_id of a group stays. Rows that repeat a doc_id each count in
    group_size and share the fate of that doc_id. A null doc_id stays only where its group has no
    other. An empty table gives an empty result; other columns of ``df`` are ignored, whatever they
    are called. ``digest`` only deals out the work: a weak one gives the same result.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), lower_az(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    docs = docs.withColumn("digest", digest(F.col("norm")))
    best = [F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")]
    salted = (
        docs.select(F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"), "digest", "norm",
                    F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
        .groupBy("salt", "digest", "norm").agg(*best)
    )
    winners = stage(salted.groupBy("digest", "norm").agg(*best).select("digest", "keep_id", "group_size"), "exact")
    rows = docs.select("doc_id", "digest", F.sha2("norm", 256).alias("text_sha256"), "norm")
    shared = winners.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    if shared.isEmpty():
        out = join_hot(rows.drop("norm"), winners, "digest", "group_size", "doc_id")
    else:
        out = _join_by_text(rows, winners, shared)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      "text_sha256")


def _join_by_text(rows: DataFrame, winners: DataFrame, shared: DataFrame) -> DataFrame:
    """Where different texts share a digest, a row's winner is the one whose text it has."""
    plain = winners.join(shared, "digest", "left_anti")
    tied = rows.join(shared, "digest", "left_semi")
    groups = tied.groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    exact = tied.join(groups, ["digest", "norm"])
    cols = ["doc_id", "keep_id", "group_size", "text_sha256"]
    return join_hot(rows.drop("norm"), plain, "digest", "group_size", "doc_id").select(cols).unionByName(exact.select(cols))
