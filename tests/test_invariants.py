"""Pipeline invariants on the driver data (sf0.001): counts that must reconcile across phases."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from corpuslab.plans import corpus, tokenize

SF = "/root/testdata/sf0.001"


def test_corpus_counts_reconcile(spark):
    verdicts = {(r.lang, r.verdict): r.n for r in E.entry(spark).collect()}
    total_docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum(verdicts.values()) == total_docs  # every document gets exactly one verdict
    stats = {(r.source, r.reason): r.n for r in corpus.filter_stats_rollup(spark, SF).collect()}
    assert stats[("*", "total")] == total_docs
    per_source = {(s_, k): n for (s_, k), n in stats.items() if s_ != "*"}
    passed = sum(n for (_, k), n in per_source.items() if k == "passed")
    rejected = sum(n for (_, k), n in per_source.items() if k.startswith("rejected_"))
    assert passed + rejected == total_docs  # passed + rejected = total
    for src in {s_ for s_, _ in per_source}:
        assert per_source[(src, "total")] == sum(n for (s_, k), n in per_source.items() if s_ == src and k != "total")
    passed_or_dup = sum(n for (_, v), n in verdicts.items() if v in ("passed", "duplicate"))
    assert passed_or_dup == passed
    ds = corpus.dedup_stats_query(spark, SF).collect()[0]
    assert ds.surviving == sum(n for (_, v), n in verdicts.items() if v == "passed")  # survivors = distinct hashes
    assert ds.total_input == ds.surviving + ds.duplicates_removed


def test_tokens_reconcile(spark):
    stats = {r.tokenizer: r for r in tokenize.pack_stats(spark, SF).collect()}
    packed_bytes = tokenize.pack_bytes(spark, SF).count()
    packed_words = tokenize.pack_words(spark, SF).count()
    for tok, n_seq in (("byte", packed_bytes), ("word", packed_words)):
        st = stats[tok]
        assert st.sequence_count == n_seq
        remainder = st.total_tokens - st.tokens_packed
        assert 0 <= remainder < tokenize.SEQ_LEN  # tokens in = tokens packed + dropped remainder
    counts = tokenize.token_counts(spark, SF).agg(F.sum("n_bytes").alias("b"), F.sum("n_words").alias("w")).collect()[0]
    assert counts.b == stats["byte"].total_tokens and counts.w == stats["word"].total_tokens
