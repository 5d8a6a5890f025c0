"""Quality gate (A6, F11, F12, P11) and dataset manifest (J1, A2, A3, A5, C14) queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import constants as K
from corpuslab.operators import tokens as TK
from corpuslab.operators.ordering import dense_positions
from corpuslab.operators.dedup import verdict_counts
from corpuslab.plans.corpus import classified_documents
from corpuslab.plans.tokenize import SEQ_LEN, corpus_docs
from corpuslab.session import read_table, stage

EVAL_MAX_LENGTH = 512  # truncation length of the reference's evaluation
MAX_PERPLEXITY = 2000.0  # gate threshold for the corpus word model (the reference's 90 is for a GPT-2 model)


def unigram_loss_table(docs: DataFrame) -> tuple[DataFrame, float]:
    """Add-one unigram word model fitted on ``docs``: (word, n) and log(N + V). The two totals are
    one aggregate row, read as scalars."""
    counts = docs.select(F.explode(TK.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts, "word-counts")  # read by the totals below and by the scoring join
    t = counts.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("V")).first()
    import math

    return counts, math.log((t["N"] or 0) + (t["V"] or 0))


def evaluate_perplexity(samples: DataFrame, counts: DataFrame, log_norm: float, group: str = "source",
                        max_samples: int | None = None, max_length: int | None = None) -> DataFrame:
    """A6 + F11 per group: perplexity = exp(sum of token losses / tokens) over all samples of at least 2
    tokens, infinite when no tokens remain. ``max_samples`` takes the first so many samples of a group
    in order (before the length filter), ``max_length`` the first so many tokens of each.

    Tokens are counted per (group, word) before the vocabulary join, so a hot word is one row per group.
    """
    if max_samples is not None:
        samples = dense_positions(samples.select(group, "doc_id", "text"), ["doc_id"], "_i", group=[group]).filter(F.col("_i") < max_samples)
    words = TK.words(F.col("text"))
    toks = samples.select(group, (words if max_length is None else F.slice(words, 1, max_length)).alias("_ws"))
    toks = toks.filter(F.size("_ws") >= 2).select(group, F.explode("_ws").alias("word"))
    used = toks.groupBy(group, "word").agg(F.count(F.lit(1)).alias("_c"))
    loss = F.lit(log_norm) - F.log(F.coalesce(F.col("n"), F.lit(0)) + 1)
    scored = used.join(counts, on="word", how="left").groupBy(F.col(group).alias("_g")).agg(
        F.sum(loss * F.col("_c")).alias("_loss"), F.sum("_c").alias("_n")
    )
    groups = samples.select(group).distinct()
    out = groups.join(scored, F.col(group).eqNullSafe(F.col("_g")), "left")  # a null group is a group like any other
    return out.select(group, *_perplexity(F.coalesce("_n", F.lit(0)), F.col("_loss")))


def _perplexity(tokens: Column, loss: Column) -> list[Column]:
    avg = F.when(tokens > 0, loss / tokens).otherwise(F.lit(float("inf")))
    return [tokens.alias("tokens_evaluated"), avg.alias("avg_loss"), F.exp(avg).alias("perplexity")]


def overall_perplexity(results: DataFrame, group: str = "source") -> DataFrame:
    """The row ``*`` over all groups, from the groups' sums: the samples are not scored again."""
    seen = F.col("tokens_evaluated") > 0
    total = results.groupBy(F.lit("*").alias(group)).agg(
        F.sum("tokens_evaluated").alias("_n"),
        F.sum(F.when(seen, F.col("avg_loss") * F.col("tokens_evaluated"))).alias("_loss"))
    return total.select(group, *_perplexity(F.col("_n"), F.col("_loss")))


def gate(results: DataFrame, max_perplexity: float | None, baseline: Column | None) -> DataFrame:
    """one reason per failed rule; a null threshold disables its rule."""
    ppl = F.col("perplexity")
    r1 = F.when(ppl > F.lit(max_perplexity), F.lit("exceeds_threshold")) if max_perplexity is not None else F.lit(None)
    r2 = F.when(ppl > baseline * K.GATE_BASELINE_TOLERANCE, F.lit("regressed_vs_baseline")) if baseline is not None else F.lit(None)
    reasons = F.array_compact(F.array(r1.cast("string"), r2.cast("string")))
    return results.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def perplexity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, log_norm = unigram_loss_table(corpus_docs(spark, sf_dir))
    labeled = read_table(spark, sf_dir, "labels").select("doc_id")
    samples = read_table(spark, sf_dir, "documents").join(labeled, on="doc_id", how="left_semi")
    # one row per source: staged, so the overall row and the baseline do not score the samples again
    per_source = stage(evaluate_perplexity(samples, counts, log_norm, "source"), "perplexity")
    overall = overall_perplexity(per_source)
    # one-row baseline: join on a literal true would be a cross join, so carry it as a scalar
    base = overall.first()
    res = gate(per_source.unionByName(overall), MAX_PERPLEXITY, F.lit(base["perplexity"] if base else None).cast("double"))
    return res.select("source", "tokens_evaluated", F.round("perplexity", 4).alias("perplexity"), "passed",
                      F.size("reasons").alias("n_reasons"))


def perplexity_gate_first500(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate with the reference's limits as its feature: per language the first 500 documents, of each
    the first 512 tokens."""
    counts, log_norm = unigram_loss_table(corpus_docs(spark, sf_dir))
    docs = read_table(spark, sf_dir, "documents")
    res = gate(evaluate_perplexity(docs, counts, log_norm, "lang", K.GATE_MAX_SAMPLES, EVAL_MAX_LENGTH), MAX_PERPLEXITY, None)
    return res.select("lang", "tokens_evaluated", F.round("perplexity", 4).alias("perplexity"), "passed")


def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per corpus run (a source), the raw, normalize, dedup and tokenize phase summaries joined
    left on the run, with the reference's defaults for a missing phase and the list of missing
    phases (our addition). Tokens: byte tokenizer, sequence length 1024."""
    return manifest_of(classified_documents(spark, sf_dir))


def manifest_of(cls: DataFrame) -> DataFrame:
    """The manifest of classified documents; those without a source are a run of their own (null)."""
    passed = F.col("reason") == "passed"
    raw = cls.groupBy("source").agg(F.count(F.lit(1)).alias("source_file_count"),
                                    F.sum("n_bytes").cast("long").alias("source_total_bytes"))
    norm = cls.groupBy("source").agg(F.count_if(passed).alias("output_record_count"),
                                     F.count_if(~passed).alias("rejected_count"))
    hashes = cls.filter(passed).groupBy("source", "content_hash").agg(F.count(F.lit(1)).alias("_c"),
                                                                      F.max("norm_bytes").alias("_b"))
    dd = hashes.groupBy("source").agg(F.sum("_c").cast("long").alias("total_input"), F.count(F.lit(1)).alias("surviving"),
                                      F.sum("_b").cast("long").alias("token_count"))
    dd = dd.withColumn("duplicates_removed", F.col("total_input") - F.col("surviving")).withColumn(
        "dedup_ratio", F.when(F.col("total_input") > 0,
                              F.round((F.col("total_input") - F.col("surviving")) / F.col("total_input"), 4)).otherwise(0.0))
    tok = dd.select("source", "token_count",
                    F.floor(F.col("token_count") / SEQ_LEN).cast("long").alias("sequence_count"),
                    F.when(F.col("token_count") > 0,
                           F.round(F.floor(F.col("token_count") / SEQ_LEN) * SEQ_LEN / F.col("token_count"), 4))
                    .otherwise(F.lit(0.0)).alias("pack_efficiency")).filter(F.col("token_count") > 0)
    m = raw
    for i, phase in enumerate((norm, dd.drop("token_count"), tok.withColumn("_t", F.lit(1)))):
        m = m.join(phase.withColumnRenamed("source", f"_s{i}"), F.col("source").eqNullSafe(F.col(f"_s{i}")), "left")
    missing = F.concat_ws(",", F.when(F.col("surviving").isNull(), F.lit("dedup")), F.when(F.col("_t").isNull(), F.lit("tokenize")))
    return m.select(
        F.col("source").alias("run_name"), "source_file_count", "source_total_bytes",
        F.coalesce("output_record_count", F.lit(0)).alias("output_record_count"),
        F.coalesce("rejected_count", F.lit(0)).alias("rejected_count"),
        F.coalesce("total_input", F.lit(0)).alias("dedup_total_input"),
        F.coalesce("duplicates_removed", F.lit(0)).alias("duplicates_removed"),
        F.coalesce("surviving", F.lit(0)).alias("surviving"),
        F.coalesce("dedup_ratio", F.lit(0.0)).alias("dedup_ratio"),
        F.coalesce("token_count", F.lit(0)).alias("token_count"),
        F.coalesce("sequence_count", F.lit(0)).alias("sequence_count"),
        F.coalesce("pack_efficiency", F.lit(0.0)).alias("pack_efficiency"),
        missing.alias("missing_phases"),
    )


def _null_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classified documents, every fourth without a language and every third without a source."""
    cls = classified_documents(spark, sf_dir)
    return cls.withColumns({"lang": F.when(F.col("doc_id") % 4 != 0, F.col("lang")), "source": F.when(F.col("doc_id") % 3 != 0, F.col("source"))})


def verdicts_null_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship's counts where documents lack a language."""
    return verdict_counts(_null_groups(spark, sf_dir), "lang")


def manifest_null_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 where documents lack a source."""
    return manifest_of(_null_groups(spark, sf_dir))


def dataset_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 over the deduplicated corpus (doc_id, text)."""
    from corpuslab.operators.manifests import dataset_digest as digest

    return digest(corpus_docs(spark, sf_dir), ["doc_id", "text"])
