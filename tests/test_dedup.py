from pyspark.sql import functions as F

from corpuslab.operators import dedup


def test_keep_first_and_stats(spark):
    rows = [(5, "h1", "a"), (2, "h1", "a"), (9, "h2", "b"), (1, None, "a"), (3, None, None), (4, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, content_hash string, text string")
    filled = dedup.fill_hash(df)
    kept = sorted(r.doc_id for r in dedup.keep_first(filled).collect())
    # h1 keeps 2; h2 keeps 9; sha256('a') is new (1); null text and '' share sha256('') -> keep 3
    assert kept == [1, 2, 3, 9]
    st = dedup.dedup_stats(filled).collect()[0]
    assert (st.total_input, st.duplicates_removed, st.surviving, st.dedup_ratio) == (6, 2, 4, round(2 / 6, 4))


def test_stats_empty(spark):
    df = spark.createDataFrame([], "content_hash string")
    st = dedup.dedup_stats(df).collect()[0]
    assert (st.total_input, st.surviving, st.dedup_ratio) == (0, 0, 0.0)


def test_hot_hash(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("content_hash"))
    kept = dedup.first_per_hash(df).filter(F.col("content_hash") == "hot").collect()
    assert kept[0].doc_id == 0


def test_verdict_counts_across_groups(spark):
    rows = [(3, "en", "passed", "h", 10), (1, "de", "passed", "h", 10), (2, "en", "passed", "h", 10),
            (4, "en", "passed", "k", 5), (5, "fr", "too_short", None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, reason string, content_hash string, n_bytes long")
    got = {(r.lang, r.verdict): (r.n, r.n_bytes) for r in dedup.verdict_counts(df, "lang").collect()}
    # doc 1 (de) is the first of hash h, so both en copies of h are duplicates
    assert got == {("de", "passed"): (1, 10), ("en", "passed"): (1, 5), ("en", "duplicate"): (2, 20),
                   ("fr", "too_short"): (1, 3)}
    marked = dedup.mark_duplicates(df).groupBy("lang", "verdict").count().collect()
    assert {(r.lang, r.verdict): r["count"] for r in marked} == {k: v[0] for k, v in got.items()}
