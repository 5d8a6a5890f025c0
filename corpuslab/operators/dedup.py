"""Exact deduplication, keep-first.

The reference keeps the first record of each SHA-256 in input order. Here "first" is the smallest
order key. The plan is a partial+final aggregate ``min(order) by hash``: a hash held by a third of
all rows collapses to one row per map task before the shuffle, so hot hashes cost nothing extra.
Marking duplicates then joins on the order key, which is unique on both sides, so that join has
no skewed key either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fill_hash(df: DataFrame, hash_col: str = "content_hash", text_col: str = "text") -> DataFrame:
    """A record without a hash gets the SHA-256 of its text; missing text counts as ''."""
    return df.withColumn(hash_col, F.coalesce(F.col(hash_col), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))


def first_per_hash(df: DataFrame, hash_col: str = "content_hash", order_col: str = "doc_id") -> DataFrame:
    """One row per hash: (hash, smallest order key). Shuffle key: hash, after map-side combine."""
    return df.groupBy(hash_col).agg(F.min(order_col).alias(order_col))


def keep_first(df: DataFrame, hash_col: str = "content_hash", order_col: str = "doc_id") -> DataFrame:
    """Surviving rows of ``df`` (all columns): ``min_by(struct(row), order)`` per hash. One
    shuffle, keyed by hash, after the map-side combine; no join, so the row bodies (text) move
    once and a hash held by a third of all rows still leaves each task as one row."""
    cols = [c for c in df.columns if c != hash_col]
    kept = df.groupBy(hash_col).agg(F.min_by(F.struct(*cols), F.col(order_col)).alias("_row"))
    return kept.select(*[F.col(f"_row.{c}").alias(c) for c in cols], hash_col).select(*df.columns)


def mark_duplicates(classified: DataFrame, order_col: str = "doc_id") -> DataFrame:
    """Adds ``verdict``: the quality reason, or 'duplicate' for a passed row that is not the first
    of its hash."""
    passed = classified.filter(F.col("reason") == "passed")
    firsts = first_per_hash(passed, "content_hash", order_col).select(order_col, F.lit(True).alias("_first"))
    return (
        classified.join(firsts, on=order_col, how="left")
        .withColumn(
            "verdict",
            F.when((F.col("reason") == "passed") & F.col("_first").isNull(), F.lit("duplicate")).otherwise(F.col("reason")),
        )
        .drop("_first")
    )


def dedup_stats(df: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """A3: total, removed, surviving, ratio (4 dp; 0.0 when empty). One shuffle on hash."""
    per_hash = df.groupBy(hash_col).agg(F.count(F.lit(1)).alias("_n"))
    totals = per_hash.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("total_input"),
                          F.count(F.lit(1)).cast("long").alias("surviving"))
    return totals.select(
        "total_input",
        (F.col("total_input") - F.col("surviving")).alias("duplicates_removed"),
        "surviving",
        F.when(F.col("total_input") > 0,
               F.round((F.col("total_input") - F.col("surviving")) / F.col("total_input"), 4))
        .otherwise(F.lit(0.0)).alias("dedup_ratio"),
    )


def verdict_counts(classified: DataFrame, group_col: str = "lang", order_col: str = "doc_id") -> DataFrame:
    """(group, verdict, n, n_bytes) without marking every row: rejected rows are counted by reason;
    the first row of each hash comes from ``min_by(struct(group, bytes), order)`` per hash (one
    shuffle keyed by hash, combined map-side); duplicates per group = passed - firsts. The only join
    left is between two per-group aggregates."""
    passed = F.col("reason") == "passed"
    rejected = classified.filter(~passed).groupBy(group_col, F.col("reason").alias("verdict")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_bytes").cast("long").alias("n_bytes"))
    ok = classified.filter(passed)
    all_passed = ok.groupBy(group_col).agg(F.count(F.lit(1)).alias("_n"), F.sum("n_bytes").alias("_b"))
    firsts = ok.groupBy("content_hash").agg(
        F.min_by(F.struct(F.col(group_col).alias("g"), F.col("n_bytes").alias("b")), F.col(order_col)).alias("f"))
    first_counts = firsts.groupBy(F.col("f.g").alias(group_col)).agg(F.count(F.lit(1)).alias("_fn"),
                                                                     F.sum("f.b").alias("_fb"))
    kept = first_counts.select(group_col, F.lit("passed").alias("verdict"), F.col("_fn").alias("n"),
                               F.col("_fb").cast("long").alias("n_bytes"))
    # a null group is a group like any other
    both = all_passed.join(first_counts.withColumnRenamed(group_col, "_g"), F.col(group_col).eqNullSafe(F.col("_g")), "left")
    dups = both.select(
        group_col, F.lit("duplicate").alias("verdict"),
        (F.col("_n") - F.coalesce(F.col("_fn"), F.lit(0))).alias("n"),
        (F.col("_b") - F.coalesce(F.col("_fb"), F.lit(0))).cast("long").alias("n_bytes"),
    ).filter(F.col("n") > 0)
    return rejected.unionByName(kept).unionByName(dups)
