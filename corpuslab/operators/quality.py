"""Quality filter (F4-F9) and its statistics (A1).

Shuffles: ``classify`` none (a projection); ``filter_stats`` one partial+final aggregate keyed by
(group, reason), a few rows per group after the map-side combine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as T


def classify(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``reason`` ('passed' or the first failing rule), ``norm_text`` and ``content_hash``
    (only for passed rows), ``n_bytes`` (UTF-8 bytes of the stripped input) and ``norm_bytes``.

    Two passes as in the reference: rules on the stripped raw text, then NFC + blank collapsing +
    strip, then the rules again; the reason comes from the first failure. Normalization runs only
    on rows that passed the first pass.
    """
    raw = docs.withColumn("_t", T.py_strip(F.col(text_col)))
    raw = raw.withColumn("_r1", T.low_signal_reason(F.col("_t")))
    norm = raw.withColumn("_n", T.nfc(F.when(F.col("_r1").isNull(), F.col(text_col))))
    # ``explode`` of one value: a filter on the verdict isn't pushed below it, which would put a copy of the whole
    # normalization into the filter for each use of its result
    norm = norm.withColumn("norm_text", F.explode(F.array(T.collapse_and_strip(F.col("_n")))))
    # the second pass can only differ when normalization changed more than the ends
    norm = norm.withColumn("_r2", F.explode(F.array(F.when(F.col("_r1").isNull() & (F.col("norm_text") != F.col("_t")),
                                                           T.low_signal_reason(F.col("norm_text"))))))
    passed = F.col("_r1").isNull() & F.col("_r2").isNull()
    return (
        norm.withColumn("reason", F.coalesce("_r1", "_r2", F.lit("passed")))
        .withColumn("norm_text", F.when(passed, F.col("norm_text")))
        .withColumn("content_hash", F.when(passed, T.sha256_hex(F.col("norm_text"))))
        .withColumn("n_bytes", F.octet_length("_t").cast("long"))
        .withColumn("norm_bytes", F.octet_length("norm_text").cast("long"))
        .drop("_t", "_n", "_r1", "_r2")
    )


def filter_stats(classified: DataFrame, group_col: str = "source") -> DataFrame:
    """A1: counts per group and stats key (``passed``, ``rejected_<reason>``) plus ``total``
    rows per group (a null group stays null) and over all groups (``*``), like the per-file stats merged by the reference.
    """
    key = F.when(F.col("reason") == "passed", F.lit("passed")).otherwise(F.concat(F.lit("rejected_"), F.col("reason")))
    return (
        classified.select(F.col(group_col).alias("_g"), key.alias("_k"))
        .rollup("_g", "_k")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping("_g").alias("_all"), F.grouping("_k").alias("_sum"))
        .select(
            F.when(F.col("_all") == 1, F.lit("*")).otherwise(F.col("_g")).alias(group_col),
            F.when(F.col("_sum") == 1, F.lit("total")).otherwise(F.col("_k")).alias("reason"),
            "n",
        )
    )
