import pytest
from pyspark.sql import functions as F

from corpuslab.operators import incidents as I

DAY = 86_400_000_000


def _steps(spark, rows):
    return spark.createDataFrame(rows, "run_name string, step long, ts_us long, loss double, saved boolean")


@pytest.fixture(scope="module")
def hot(spark):
    """One run with most steps, a null run, and a short one."""
    rows = [("hot", i, i * DAY // 4, float(i % 7) + (100.0 if i % 50 == 0 else 0.0), i % 11 == 0) for i in range(1, 301)]
    rows += [(None, i, i * DAY * (2 if i > 3 else 1), 1.0, False) for i in range(1, 6)]
    rows += [("short", 1, 0, None, True), ("short", 2, 5, float("nan"), None), ("short", 3, 9, float("inf"), False)]
    return _steps(spark, rows)


@pytest.mark.parametrize("fn", [
    lambda d, b: I.loss_spikes(d, block=b),
    lambda d, b: I.stalls(d, 86_400, block=b),
    lambda d, b: I.lost_work(d, F.isnan("loss") | (F.col("step") % 13 == 0), F.col("saved"), block=b),
])
def test_blocks_do_not_change_answers(hot, fn):
    whole, cut = (sorted(map(tuple, fn(hot, b).collect()), key=repr) for b in (1 << 20, 20))
    assert whole and whole == cut


def test_loss_spikes_literal(spark, hot):
    got = sorted((r.run_name, r.step) for r in I.loss_spikes(hot).collect())
    assert got == [("hot", s) for s in (50, 100, 150, 200, 250, 300)]
    assert I.loss_spikes(_steps(spark, [])).count() == 0


def test_stalls_literal(spark, hot):
    got = sorted((r.step, r.gap_sec) for r in I.stalls(hot, 86_400).collect())
    assert got == [(3, 5 * 86_400.0), (4, 2 * 86_400.0)]  # steps at days 1, 2, 3, 8, 10


def test_lost_work_literal(spark, hot):
    got = {(r.run_name, r.crash_step): (r.checkpoint_step, r.lost_steps)
           for r in I.lost_work(hot, F.col("step").isin(2, 11, 25), F.col("saved")).collect()}
    assert got == {("hot", 2): (0, 2), ("hot", 11): (11, 0), ("hot", 25): (22, 3), (None, 2): (0, 2), ("short", 2): (1, 1)}


def test_step_numbers_and_token_cost(spark):
    rows = spark.createDataFrame([("a", 5, 2), ("a", 5, 1), ("a", 1, 3), (None, 1, 4)], "run_name string, ts_us long, event_id long")
    got = sorted((r.run_name or "", r.event_id, r.step) for r in I.number_steps(rows).collect())
    assert got == [("", 4, 1), ("a", 1, 2), ("a", 2, 3), ("a", 3, 1)]
    runs = spark.createDataFrame([("a", 500_000, 2.0), ("b", 0, 1.0), ("c", 10, None)], "run_name string, total_tokens long, estimated_cost_usd double")
    assert {r.run_name: r.usd_per_million_tokens for r in I.token_cost(runs).collect()} == {"a": 4.0, "b": None, "c": None}
