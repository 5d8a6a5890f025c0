from math import exp, inf, log

import pytest

from corpuslab.plans.gates import evaluate_perplexity, overall_perplexity


def test_perplexity_per_source_and_overall(spark):
    samples = spark.createDataFrame(
        [("a", 1, "x x y"), (None, 2, "x y"), ("b", 3, "x"), ("b", 4, None), ("b", 5, "")],
        "source string, doc_id long, text string")
    counts = spark.createDataFrame([("x", 1), ("y", 3)], "word string, n long")
    lx, ly = log(3), log(1.5)  # (4 tokens + 2 words) / (n + 1)
    per_source = evaluate_perplexity(samples, counts, log(6))
    got = {r.source: r for r in per_source.collect()}
    assert {k: r.tokens_evaluated for k, r in got.items()} == {"a": 3, None: 2, "b": 0}
    assert got["a"].perplexity == pytest.approx(exp((2 * lx + ly) / 3))
    assert got[None].perplexity == pytest.approx(exp((lx + ly) / 2))
    assert got["b"].perplexity == inf
    total = overall_perplexity(per_source).collect()
    assert [(r.source, r.tokens_evaluated) for r in total] == [("*", 5)]
    assert total[0].perplexity == pytest.approx(exp((3 * lx + 2 * ly) / 5))


def test_perplexity_without_samples(spark):
    samples = spark.createDataFrame([], "source string, doc_id long, text string")
    counts = spark.createDataFrame([("x", 1)], "word string, n long")
    per_source = evaluate_perplexity(samples, counts, log(2))
    assert per_source.count() == 0
    assert overall_perplexity(per_source).count() == 0
