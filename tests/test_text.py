import hashlib

from pyspark.sql import functions as F

from corpuslab.functions import constants as K
from corpuslab.functions import text as T
from corpuslab.operators import quality

# (text, expected reason, expected normalized text if it passes)
CASES = [
    ("", "too_short", None),
    ("    ", "too_short", None),
    ("a" * 199, "too_short", None),
    ("\u00e9" * 100, "passed", "\u00e9" * 100),  # 200 bytes, 100 code points
    ("\u00e9" * 99 + "a", "too_short", None),  # 199 bytes
    ("abc 12 " * 40, "non_alpha_ratio", None),  # 3 letters in 7
    ("x" * 120 + "1" * 80, "passed", "x" * 120 + "1" * 80),  # exactly 0.4 are no letters
    ("x" * 119 + "1" * 81, "non_alpha_ratio", None),
    ("privacy policy\n" + "y" * 300, "passed", "privacy policy\n" + "y" * 300),  # half, not more
    ("privacy policy\n  READ MORE \n" + "y" * 300, "boilerplate", None),
    ("privacy policy\r\nread more\x85" + "y" * 300, "boilerplate", None),
    ("  " + "word " * 50 + "  ", "passed", ("word " * 50).strip()),
    ("word\t\t  word " * 20 + "\n\n\n\n" + "end " * 10, "passed", ("word word " * 20 + "\n\n" + "end " * 10).strip()),
    ("Cafe\u0301 " * 60, "passed", ("Caf\u00e9 " * 60).strip()),  # composed
    ("a" * 150 + " " * 100 + "b" * 30, "too_short", None),  # long enough only before blanks collapse
]


def _spark_classify(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = quality.classify(df).select("doc_id", "reason", "content_hash").collect()
    return {r.doc_id: (r.reason, r.content_hash) for r in rows}


def test_reasons_and_hashes(spark):
    got = _spark_classify(spark, [t for t, _, _ in CASES])
    for i, (text, reason, normal) in enumerate(CASES):
        digest = hashlib.sha256(normal.encode()).hexdigest() if normal is not None else None
        assert got[i] == (reason, digest), (i, text[:60], got[i])


def test_normalize_and_strip(spark):
    cases = ["  a\t\tb  \n\n\n\nc  ", "Cafe\u0301", "\x1c\x1dx\x1e\x1f", "a\r\n\r\n\r\nb", "a\n\n\nb\n\nc"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in df.select(T.normalize_text(F.col("t"))).collect()]
    assert got == ["a b \n\nc", "Caf\u00e9", "x", "a\r\n\r\n\r\nb", "a\n\nb\n\nc"]


def test_line_counts(spark):
    cases = ["a\nb\n\n  \nc", "privacy policy\r\n  READ MORE  x", "", "\n\n", "click here"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    rows = df.select(T.nonblank_line_count(F.col("t")).alias("n"), T.boilerplate_line_count(F.col("t")).alias("b")).collect()
    assert [(r.n, r.b) for r in rows] == [(3, 0), (3, 2), (0, 0), (0, 0), (1, 1)]


def test_every_fixed_line_counts_as_boilerplate(spark):
    lines = list(K.BOILERPLATE_LINES)
    df = spark.createDataFrame([("\n".join(f" {x.upper()}\t" for x in lines),)], "t string")
    assert df.select(T.boilerplate_line_count(F.col("t"))).first()[0] == len(lines)


def test_nonblank_lines_are_counted_from_their_start(spark):
    cases = {"": 0, " \t ": 0, "a": 1, "  a b  \n\n \n c": 2, "a\r\nb\rc   d": 4, "\x1c\x1f\x1dx\x85": 1,
             " " * 100_000: 0, (" " * 50_000 + "x\n") * 2: 2}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, n int")
    bad = rows.where(T.nonblank_line_count(F.col("t")) != F.col("n")).collect()
    assert not bad, [r.t[:20] for r in bad]
    assert rows.count() == len(cases)
