import hypothesis.strategies as st
from hypothesis import HealthCheck, given, settings
from pyspark.sql import functions as F

from corpuslab.operators import tokens as TK
from corpuslab.operators.ordering import running_offsets

ALPH = "abc é漢\n 1"


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=ALPH, max_size=40), min_size=1, max_size=12), st.integers(min_value=1, max_value=17))
def test_pack_bytes_property(spark, texts, L):
    df = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [bytes(r.packed) for r in TK.pack_bytes(df, L).orderBy("seq_id").collect()]
    stream = "".join(texts).encode()
    assert all(len(s) == L for s in got) and len(got) == len(stream) // L
    assert stream.startswith(b"".join(got))


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(min_value=0, max_value=30), min_size=1, max_size=40), st.integers(min_value=1, max_value=9))
def test_offsets_property(spark, sizes, parts):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "k long, n long")
    got = [r.off for r in running_offsets(df, ["k"], "n", "off", n_parts=parts).orderBy("k").collect()]
    want, acc = [], 0
    for n in sizes:
        want.append(acc)
        acc += n
    assert got == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab cd\nxyz", max_size=30), min_size=1, max_size=8))
def test_word_counts_match_regex(spark, texts):
    import regex

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(TK.n_tokens(F.col("t"), "word").alias("n")).collect()]
    assert got == [len(regex.findall(r"[\p{L}\p{N}]+", t)) for t in texts]
