"""Corpus build queries over the ``documents`` table (order key ``doc_id``).

Plan shape (sf-independent): scan (ids, text) -> classify projection -> staged narrow table ->
aggregates (first of each hash by ``min_by``, counts). The classification (all the regex work)
runs once per document; everything after it reads the staged narrow table. The deduplicated text
for the token phase is one job: classify -> passed -> ``min_by(struct(row), doc_id)`` per hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators import dedup, quality
from corpuslab.operators.tokens import n_tokens
from corpuslab.session import read_table, spread, stage

NARROW = ["doc_id", "lang", "source", "reason", "content_hash", "n_bytes", "norm_bytes"]


def classified_documents(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """Narrow per-document verdict table (no text). Materialized once when several branches read
    it: a re-scan would run every regex again."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    narrow = quality.classify(docs).select(*NARROW)
    return stage(narrow, "classified") if materialize else narrow


def corpus_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: documents per (lang, verdict) with their bytes; verdict = rule reason,
    'duplicate' or 'passed'."""
    return dedup.verdict_counts(classified_documents(spark, sf_dir), "lang")


def filter_stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.filter_stats(classified_documents(spark, sf_dir, materialize=False), "source")


def normalize_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = classified_documents(spark, sf_dir, materialize=False).filter(F.col("reason") == "passed")
    return passed.select("doc_id", "content_hash", F.col("norm_bytes").alias("n_bytes"))


def deduped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized documents with the first of each hash kept (doc_id, text, content_hash): one job,
    classify -> passed -> ``min_by`` per hash, with no intermediate table (keep-first needs no join)."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    passed = quality.classify(docs).filter(F.col("reason") == "passed")
    return dedup.keep_first(passed.select("doc_id", F.col("norm_text").alias("text"), "content_hash"), "content_hash", "doc_id")


def deduped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_words) of the kept documents. Tokens are counted in the classify pass, so the
    first of each hash is found on counts and no text moves."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    passed = quality.classify(docs).filter(F.col("reason") == "passed")
    counts = passed.select("doc_id", "content_hash", F.col("norm_bytes").cast("long").alias("n_bytes"),
                           n_tokens(F.col("norm_text"), "word").alias("n_words"))
    return dedup.keep_first(counts, "content_hash", "doc_id").drop("content_hash")


def dedup_exact_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = classified_documents(spark, sf_dir, materialize=False).filter(F.col("reason") == "passed")
    return dedup.first_per_hash(passed, "content_hash", "doc_id")


def dedup_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = classified_documents(spark, sf_dir, materialize=False).filter(F.col("reason") == "passed")
    return dedup.dedup_stats(passed.select("content_hash"))
