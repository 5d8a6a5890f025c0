"""The training-data pipeline: language ID, near-dedup, decontamination, mixing, token files.

Each stage's result is written as Parquet under the shared folder of ``spark.checkpoint.dir`` and read
back as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import decontaminate, langid, mixing, simhash
from corpuslab.llm.common import free_name
from corpuslab.llm.queries import WEIGHTS, _fold, domain, token_output
from corpuslab.session import read_table, stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, however sure the language of the others is; none if nothing was
    learned. Learns as the operator's query does."""
    model = langid.train(docs.where(~_fold(3, 1)), langid.default_vocabulary())
    if not model.languages:
        return docs
    judged, c = langid.identify(docs, model)
    return judged.where(F.col(c)["lang_pred"] != "und").select(*docs.columns)


def _digest(docs: DataFrame) -> Column:
    """Of all columns of a row, so only rows that are the same throughout share it."""
    return F.sha2(F.to_json(F.struct(*docs.columns)), 256)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: that with the smallest doc_id, null last, then the smallest digest.
    Of rows that are the same throughout, one stays."""
    name = free_name(docs, "_row")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), _digest(docs).alias("digest"))
    found = simhash.near_duplicates(docs.withColumn(name, key), id_col=name)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = stage(first.groupBy(F.col("doc_id")["digest"].alias(name)).agg(F.count(F.lit(1)).alias("n")), "kept")
    rows = docs.withColumn(name, _digest(docs))
    alone = rows.join(kept.where("n = 1"), name, "left_semi")
    copies = rows.join(kept.where("n > 1"), name, "left_semi").dropDuplicates([name])
    return alone.select(*docs.columns).union(copies.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as came in, shared out by the weights; a document may come up to four times, and the
    one across a leaf's budget is cut there. Rows find their plan by the digest of all their columns."""
    name = free_name(docs, "_row")
    rows = docs.withColumn(name, _digest(docs))
    return mixing.mix(rows, mixing.plan_mixture(rows, domain(), WEIGHTS, keep=(name,)), key=name).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document from the token files: doc_id, start, n_tokens, ids_crc32, shard."""
    return token_output(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_tokens),
]

#: SQL can't express language ID, SimHash or the tokenizer; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
