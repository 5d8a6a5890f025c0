from pyspark.sql import functions as F

from corpuslab.operators import tokens as TK


def _docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_pack_bytes_edge_cases(spark):
    L = 16
    cases = [
        ["abc"],  # below L
        ["abcdefgh", "ijklmnop"],  # exactly L
        ["abcdefgh", "ijklmnopq"],  # one over
        ["x" * 50, "", "é" * 10, "y" * 7],  # spans 3+ sequences, an empty document between
    ]
    for texts in cases:
        packed = TK.pack_bytes(_docs(spark, texts), L).orderBy("seq_id").collect()
        stream = "".join(texts).encode()
        assert b"".join(bytes(r.packed) for r in packed) == stream[: len(stream) // L * L]
        assert [(r.seq_id, len(r.packed)) for r in packed] == [(i, L) for i in range(len(stream) // L)]


def test_pack_words_matches_serial(spark):
    texts = ["one two three", "", "four five six seven eight nine ten", "eleven " * 9, "x y"]
    docs = _docs(spark, texts)
    vocab = TK.fit_vocabulary(docs)
    ids = {r.word: r.id for r in vocab.collect()}
    L = 5
    got = TK.pack_word_ids(docs, vocab, L).orderBy("seq_id").collect()
    import re

    stream = [ids[w] for t in texts for w in re.findall(r"[^\W_]+", t)]
    assert [x for r in got for x in r.tokens] == stream[: len(stream) // L * L]
    assert all(len(r.tokens) == L for r in got)


def test_word_ids_with_and_without_rare_words(spark):
    long = "z" * 100
    texts = ["the cat the dog", None, "", "the " * 30 + long, f"{long} {long} bird the", "... !"]
    docs = _docs(spark, texts)
    cut = docs.select("doc_id", TK.words(F.col("text")).alias("words"))
    vocab = TK.fit_vocabulary(docs)
    ids = {r.word: r.id for r in vocab.collect()}
    assert ids == {"the": 1, long: 2, "bird": 3, "cat": 4, "dog": 5}
    expected = [[1, 4, 1, 5], [], [], [1] * 30 + [2], [2, 2, 3, 1], []]
    packed = [1, 4, 1, 5] + [1] * 30 + [2, 2, 2, 3, 1]
    for n in (1, 3, 1 << 16):  # the broadcast part of the vocabulary must not change results
        for table, col in ((docs, "text"), (cut, "words")):
            got = TK.doc_word_ids(table, vocab, text_col=col, n_frequent=n).orderBy("doc_id").collect()
            assert [list(r.ids) for r in got] == expected
            short = TK.doc_word_ids(table, vocab, text_col=col, max_pos=2, n_frequent=n).orderBy("doc_id").collect()
            assert [list(r.ids) for r in short] == [x[:2] for x in expected]
            seqs = TK.pack_word_ids(table, vocab, 4, text_col=col, n_frequent=n).orderBy("seq_id").collect()
            assert [x for r in seqs for x in r.tokens] == packed[: len(packed) // 4 * 4]
            assert [r.seq_id for r in seqs] == list(range(len(packed) // 4))


def test_vocabulary_order(spark):
    docs = _docs(spark, ["b a b c", "a b"])
    v = {r.word: r.id for r in TK.fit_vocabulary(docs).collect()}
    assert v == {"b": 1, "a": 2, "c": 3}


def test_pad_truncate_and_synthetic(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],), (list(range(10)),)], "ids array<int>")
    padded, mask = TK.pad_truncate(F.col("ids"), 5, 0)
    rows = df.select(padded.alias("p"), mask.alias("m")).collect()
    assert [list(r.p) for r in rows] == [[1, 2, 3, 0, 0], [0] * 5, [0, 1, 2, 3, 4]]
    assert [list(r.m) for r in rows] == [[1, 1, 1, 0, 0], [0] * 5, [1] * 5]
    s = spark.range(3).select(TK.synthetic_tokens(F.col("id"), 4, 3).alias("t")).collect()
    assert [list(r.t) for r in s] == [[(j % 3 + i) % 3 for j in range(4)] for i in range(3)]


def test_epoch_shards_partition_rows(spark):
    docs = spark.range(103).withColumnRenamed("id", "doc_id")
    out = TK.epoch_shards(docs, 1, 4, 5).toPandas()
    assert sorted(out.doc_id) == list(range(103))
    counts = out.groupby("shard").size().tolist()
    assert max(counts) - min(counts) <= 1
    assert out.groupby(["shard", "batch"]).size().max() <= 5


def test_salted_vocab_join_equals_plain_join(spark):
    rows = [(i, j, "the" if (i + j) % 3 == 0 else f"w{(i * 7 + j) % 50}") for i in range(60) for j in range(30)]
    tokens = spark.createDataFrame(rows, "doc_id long, pos long, word string")
    docs_vocab = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    from corpuslab.operators.ordering import dense_positions

    vocab = dense_positions(docs_vocab, [("n", True), "word"], "id").withColumn("id", (F.col("id") + 1).cast("int"))
    salted = TK.join_word_ids(tokens, vocab, ["doc_id", "pos"], n_hot=4, salts=8)
    plain = tokens.join(vocab.select("word", "id"), on="word")
    key = ["doc_id", "pos", "word", "id"]
    assert sorted(map(tuple, salted.select(*key).collect())) == sorted(map(tuple, plain.select(*key).collect()))
    assert salted.count() == len(rows)


def test_frequent_words_are_no_rows(spark, monkeypatch):
    """Frequent words are looked up in batches of documents of any size, and never exploded into rows."""
    monkeypatch.setattr(TK, "ROWS", 2)
    texts = ["a b a c", "", None, "b " * 11, "c d e", "a"]
    docs = _docs(spark, texts).repartition(1)
    vocab = TK.fit_vocabulary(docs)
    ids = {r.word: r.id for r in vocab.collect()}
    stream = [ids[w] for t in texts for w in (t or "").split()]
    for n in (0, 2, 100):
        seqs = TK.pack_word_ids(docs, vocab, 3, n_frequent=n)
        assert [x for r in seqs.orderBy("seq_id").collect() for x in r.tokens] == stream[: len(stream) // 3 * 3]
        assert "posexplode" not in seqs._jdf.queryExecution().toString()
