import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from corpuslab.operators import artifacts as AR
from corpuslab.operators import runs as R
from corpuslab.plans import gates


def _requests(spark, spec):
    rows = []
    t0 = dt.datetime(2024, 1, 1)
    for run, n_ok, n_fail in spec:
        for i in range(n_ok + n_fail):
            lat = Decimal(f"{((i * 37) % 101) / 100 + 0.01:.4f}")
            rows.append((run, i, t0 + dt.timedelta(seconds=i), lat, 10, None if i < n_ok else "boom"))
    return spark.createDataFrame(rows, "run_name string, request_id long, ts timestamp, latency_sec decimal(15,4), "
                                       "tokens_generated long, error string")


def test_percentiles_by_index(spark):
    spec = [("r0", 0, 3), ("r1", 1, 0), ("r20", 20, 2), ("r100", 100, 0)]
    got = {r.run_name: r for r in R.latency_summary(_requests(spark, spec), concurrency=8).collect()}
    for run, n_ok, n_fail in spec:
        lats = sorted(round(((i * 37) % 101) / 100 + 0.01, 3) for i in range(n_ok))
        row = got[run]
        assert row.successful == n_ok and row.failed == n_fail
        if lats:
            assert row.latency_p50_sec == lats[len(lats) // 2]
            assert row.latency_p95_sec == lats[int(len(lats) * 0.95)]
            assert row.latency_p99_sec == lats[int(len(lats) * 0.99)]
        else:
            assert (row.latency_p50_sec, row.latency_p95_sec, row.latency_p99_sec) == (0.0, 0.0, 0.0)


def test_scaling_edge_cases(spark):
    rows = [
        ("no1gpu", "a", 1, 2, 0, 100.0), ("no1gpu", "b", 2, 4, 0, 180.0),
        ("allfail", "a", 1, 1, 1, 100.0), ("allfail", "b", 2, 2, 1, 100.0),
        ("zero", "a", 1, 1, 0, 0.0), ("zero", "b", 2, 2, 0, 50.0),
        ("ok", "a", 1, 1, 0, 100.0), ("ok", "b", 2, 2, 0, 190.0), ("ok", "c", 3, 4, 2, 10.0),
    ]
    df = spark.createDataFrame(rows, "suite string, config string, config_order int, num_gpus int, exit_code int, final_tokens_per_sec double")
    got = {(r.suite, r.config): (r.speedup, r.scaling_efficiency) for r in R.scaling_efficiency(df).collect()}
    assert got[("no1gpu", "a")] == (1.0, 100.0) and got[("no1gpu", "b")] == (1.8, 90.0)
    assert got[("allfail", "a")] == (None, None)
    assert got[("zero", "b")] == (None, None)  # zero-throughput baseline: null, not a division error
    assert got[("ok", "b")] == (1.9, 95.0) and got[("ok", "c")] == (0.0, 0.0)


def test_gate_rules(spark):
    df = spark.createDataFrame([("a", 80.0), ("b", 95.0), ("c", float("inf"))], "source string, perplexity double")
    rows = {r.source: (r.passed, list(r.reasons)) for r in gates.gate(df, 90.0, F.lit(85.0)).collect()}
    assert rows["a"] == (True, [])
    assert rows["b"] == (False, ["exceeds_threshold", "regressed_vs_baseline"])
    assert rows["c"][0] is False
    off = {r.source: r.passed for r in gates.gate(df, None, None).collect()}
    assert off == {"a": True, "b": True, "c": True}
    exact = spark.createDataFrame([("x", 105.0)], "source string, perplexity double")
    assert gates.gate(exact, None, F.lit(100.0)).collect()[0].passed is True  # exactly baseline x 1.05 passes


def test_checkpoint_catalogue(spark):
    rows = [
        # run, path, step, sharded, checksum, actual, has_model, has_train_state, has_state
        ("r", "c/checkpoint-9", 9, False, "h9", "h9", False, False, True),
        ("r", "c/checkpoint-10", 10, False, "h10", "bad", False, False, True),  # newest corrupt -> falls back to 9
        ("s", "s/checkpoint-5", 5, True, None, None, True, False, False),  # sharded without train state
        ("s", "s/checkpoint-4", 4, True, None, None, True, True, False),
    ]
    ck = spark.createDataFrame(rows, "run_name string, path string, step long, sharded boolean, checksum string, "
                                     "actual_checksum string, has_model boolean, has_train_state boolean, has_state boolean")
    got = {r.run_name: (r.path, r.step) for r in AR.latest_valid(ck).collect()}
    assert got == {"r": ("c/checkpoint-9", 9), "s": ("s/checkpoint-4", 4)}
    ret = {(r.run_name, r.step): r.expired for r in AR.retention(ck, keep=1).collect()}
    assert ret == {("r", 10): False, ("r", 9): True, ("s", 5): False, ("s", 4): True}
    ranks = spark.createDataFrame([(1, 0, 7), (1, 1, 7), (2, 0, 7), (2, 1, 6)], "checkpoint long, rank int, step long")
    agree = {r.checkpoint: (r.agreed, r.step) for r in AR.rank_agreement(ranks).collect()}
    assert agree == {1: (True, 7), 2: (False, 0)}


def test_report_unknown_instance_and_missing_eval(spark):
    runs = spark.createDataFrame(
        [("a", 0, "g5.xlarge", 1, 1, 3600.0, 100.0, 0), ("b", 1, "g5.xlarge", 1, 2, 7200.0, 120.0, 0),
         ("c", 2, "zz.unknown", 1, 1, 3600.0, 50.0, 0)],
        "run_name string, user_id long, instance_type string, gpus_per_node int, world_size int, total_time_sec double, "
        "final_tokens_per_sec double, resumed_from_step long")
    evals = spark.createDataFrame([("a", 40.0, True)], "run_name string, perplexity double, passed boolean")
    exports = spark.createDataFrame([], "run_name string, artifact_checksum string")
    s = R.run_summary(runs, evals, exports)
    rep = {(r.run_name, r.metric): (r.baseline, r.current, r.delta) for r in R.run_report(s).collect()}
    assert rep[("b", "gpu_hours")] == (1.0, 4.0, 3.0)
    assert rep[("b", "cost_usd")] == (1.01, 4.02, 3.02)
    assert rep[("b", "perplexity")] == (40.0, None, None)
    assert rep[("c", "cost_usd")] == (None, None, None)
    md = {r.metric: r.line for r in R.report_markdown(R.run_report(s)).filter("run_name = 'b'").collect()}
    assert md["perplexity"] == "| Perplexity | 40.00 | n/a | n/a |"
