import random

import pandas as pd
import pytest

from corpuslab.operators.ordering import dense_positions, running_offsets


def test_running_offsets_global(spark):
    rnd = random.Random(7)
    rows = [(i * 3 + rnd.randint(0, 2), rnd.randint(0, 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, w long").repartition(5)
    got = running_offsets(df, ["k"], "w", "off", n_parts=7).toPandas().sort_values("k")
    exp = pd.DataFrame(rows, columns=["k", "w"]).sort_values("k")
    exp["off"] = exp["w"].cumsum() - exp["w"]
    assert got["off"].tolist() == exp["off"].tolist()


def test_running_offsets_grouped_with_hot_group(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.6 else f"g{rnd.randint(0, 9)}", i, rnd.randint(1, 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k long, w long")
    got = running_offsets(df, ["k"], "w", "off", group=["g"], n_parts=6).toPandas().sort_values(["g", "k"])
    exp = pd.DataFrame(rows, columns=["g", "k", "w"]).sort_values(["g", "k"])
    exp["off"] = exp.groupby("g")["w"].cumsum() - exp["w"]
    assert got["off"].tolist() == exp["off"].tolist()


def test_dense_positions_desc_order(spark):
    rows = [(f"w{i}", i % 7) for i in range(100)]
    df = spark.createDataFrame(rows, "word string, n long")
    got = dense_positions(df, [("n", True), "word"], "pos", n_parts=4).toPandas()
    exp = pd.DataFrame(rows, columns=["word", "n"]).sort_values(["n", "word"], ascending=[False, True])
    exp["pos"] = range(len(exp))
    m = got.merge(exp, on=["word", "n"], suffixes=("", "_e"))
    assert (m["pos"] == m["pos_e"]).all() and len(m) == 100


@pytest.mark.parametrize("n_parts", [4, 40, 200])
@pytest.mark.parametrize("desc", [False, True])
def test_null_keys_hot_group_and_negative_weights(spark, n_parts, desc):
    rnd = random.Random(11)
    rows = [(None if rnd.random() < 0.4 else f"g{rnd.randint(0, 3)}", None if i == 7 else i, rnd.randint(-9, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k long, w long")
    got = {(r.g, r.k): r.off for r in running_offsets(df, [("k", desc)], "w", "off", group=["g"], n_parts=n_parts).collect()}
    want, sums = {}, {}
    # nulls come first ascending, last descending
    for g, k, w in sorted(rows, key=lambda r: -1 if r[1] is None else r[1], reverse=desc):
        want[g, k] = sums.get(g, 0)
        sums[g] = want[g, k] + w
    assert got == want


def test_nan_and_other_columns_pass_through(spark):
    from pyspark.sql import functions as F

    rows = [(i, 1, float("nan") if i % 5 == 0 else i / 2, f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "k long, w long, x double, s string")
    out = running_offsets(df, ["k"], "w", "off", n_parts=40).orderBy("k").collect()
    assert [r.off for r in out] == list(range(200))
    assert sum(1 for r in out if r.x != r.x) == 40 and [r.s for r in out] == [f"t{i}" for i in range(200)]
    assert df.filter(F.isnan("x")).count() == 40
