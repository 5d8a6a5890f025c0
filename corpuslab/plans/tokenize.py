"""Token queries over the deduplicated corpus (the reference's tokenize + pack phase input)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators import tokens as TK
from corpuslab.operators.ordering import running_offsets
from corpuslab.plans.corpus import deduped_counts, deduped_documents
from corpuslab.session import read_table, stage

SEQ_LEN = 1024  # the reference's max_length for packing
PAD_LEN = 128
PAD_ID = 0
SYNTH_LEN, SYNTH_VOCAB = 32, 128  # the reference's synthetic dataset defaults
EPOCH, WORLD_SIZE, BATCH_SIZE = 1, 8, 4


def corpus_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated normalized documents (doc_id, text), staged for queries that read the text twice."""
    return stage(deduped_documents(spark, sf_dir).select("doc_id", "text"), "deduped")


def corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents cut into words once (doc_id, words), staged for the vocabulary and the ids."""
    docs = deduped_documents(spark, sf_dir)
    return stage(docs.select("doc_id", TK.words(F.col("text")).alias("words")), "deduped-words")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped_counts(spark, sf_dir)


def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = deduped_counts(spark, sf_dir).select("doc_id", F.col("n_bytes").alias("n_tokens"))
    return running_offsets(counts, ["doc_id"], "n_tokens", "off", persist_input=True)


def pack_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = TK.pack_bytes(corpus_docs(spark, sf_dir), SEQ_LEN)
    return packed.select("seq_id", F.sha2("packed", 256).alias("seq_digest"))


def word_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = deduped_documents(spark, sf_dir)  # read once, by the count of words
    return TK.fit_vocabulary(docs)


def pack_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus_words(spark, sf_dir)
    packed = TK.pack_word_ids(docs, TK.fit_vocabulary(docs, "words"), SEQ_LEN, text_col="words")
    return packed.select("seq_id", TK.sequence_digest(F.col("tokens")).alias("seq_digest"))


def pack_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stage(deduped_counts(spark, sf_dir).filter(F.col("n_bytes") > 0), "counts")
    out = None
    for tok in ("byte", "word"):
        counts = docs.select(F.col(f"n_{tok}s").alias("n_tokens"))
        stats = TK.pack_stats(counts, SEQ_LEN).select(F.lit(tok).alias("tokenizer"), "*")
        out = stats if out is None else out.unionByName(stats)
    return out


def pad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus_words(spark, sf_dir)
    ids = TK.doc_word_ids(docs, TK.fit_vocabulary(docs, "words"), text_col="words", max_pos=PAD_LEN)
    padded, mask = TK.pad_truncate(F.col("ids"), PAD_LEN, PAD_ID)
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("mask_sum"),
        TK.sequence_digest(padded).alias("ids_digest"),
    )


def synthetic_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    return docs.select(F.col("doc_id").alias("id"),
                       TK.sequence_digest(TK.synthetic_tokens(F.col("doc_id"), SYNTH_LEN, SYNTH_VOCAB)).alias("tokens_digest"))


def epoch_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TK.epoch_shards(stage(deduped_counts(spark, sf_dir).select("doc_id"), "kept-ids"), EPOCH, WORLD_SIZE, BATCH_SIZE)
