"""Registry of named queries (Spark callables) and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuslab.plans import analytics, archives_q, builds_q, corpus, gates, oracle, oracle_runs, streams_q, tokenize

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "corpus_verdicts": corpus.corpus_verdicts,
        "filter_stats_rollup": corpus.filter_stats_rollup,
        "normalize_text": corpus.normalize_text_query,
        "dedup_exact": corpus.dedup_exact_query,
        "dedup_stats": corpus.dedup_stats_query,
        "token_counts": tokenize.token_counts,
        "token_offsets": tokenize.token_offsets,
        "pack_bytes": tokenize.pack_bytes,
        "word_vocabulary": tokenize.word_vocabulary,
        "pack_words": tokenize.pack_words,
        "pack_stats": tokenize.pack_stats,
        "pad_truncate": tokenize.pad_truncate,
        "synthetic_sequences": tokenize.synthetic_sequences,
        "epoch_shards": tokenize.epoch_shards,
        "perplexity_gate": gates.perplexity_gate,
        "perplexity_gate_first500": gates.perplexity_gate_first500,
        "dataset_manifest": gates.dataset_manifest,
        "verdicts_null_groups": gates.verdicts_null_groups,
        "manifest_null_groups": gates.manifest_null_groups,
        "dataset_digest": gates.dataset_digest,
        "build_diff": builds_q.build_diff,
        "packed_shards": builds_q.packed_shards,
        "published_versions": builds_q.published_versions,
        "wet_roundtrip": archives_q.wet_roundtrip,
        "archive_inventory": archives_q.archive_inventory,
        "raw_inventory": archives_q.raw_inventory,
        "archive_documents": archives_q.archive_documents,
        "archive_stats": archives_q.archive_stats,
        "stream_gpu_means": streams_q.stream_gpu_means,
        "stream_dedup": streams_q.stream_dedup,
        "stream_dedup_arrivals": streams_q.stream_dedup_arrivals,
        "stream_idle_alarm": streams_q.stream_idle_alarm,
        "stream_step_metrics": streams_q.stream_step_metrics,
    }
    for name in oracle_runs.RUN_SQL:
        q[name] = getattr(analytics, name)
    return q


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql.update(oracle.CORPUS_SQL)
    sql.update(oracle.TOKEN_SQL)
    sql.update(oracle_runs.RUN_SQL)
    sql.update(oracle.GATE_SQL)
    sql.update(oracle.ARCHIVE_SQL)
    sql.update(oracle_runs.STREAM_SQL)
    sql["stream_dedup"] = sql["stream_dedup_arrivals"] = oracle.CORPUS_SQL["dedup_exact"]
    return sql
