import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from corpuslab.operators import dedup, quality, runs
from corpuslab.session import read_table
from corpuslab.sources import derived
from corpuslab.streaming import corpus as SC
from corpuslab.streaming import telemetry as ST

SF = "/root/testdata/sf0.001"


def _files(pdf: pd.DataFrame, d: str, key: str, n: int, start: int = 0):
    pdf = pdf.sort_values(key)
    for i, chunk in enumerate(_split(pdf, n)):
        chunk.to_parquet(os.path.join(d, f"part-{start + i:03d}.parquet"), index=False)


def _split(pdf, n):
    size = (len(pdf) + n - 1) // n
    return [pdf.iloc[i * size:(i + 1) * size] for i in range(n)]


def _run(stream_df, out_dir, ck, mode="append"):
    q = stream_df.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", ck) \
        .outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return q


def _telemetry_pdf(spark):
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    t = derived.telemetry(spark, SF).select("instance_id", F.timestamp_diff("MICROSECOND", epoch, F.col("ts")).alias("ts_us"),
                                            F.col("value").cast("double"))
    return t.toPandas()


def _stream(spark, d, schema):
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d)
    return s.withColumn("ts", F.timestamp_micros("ts_us"))


def test_window_means_stream_equals_batch(spark):
    d, out, ck = (tempfile.mkdtemp(prefix=p) for p in ("tin-", "tout-", "tck-"))
    pdf = _telemetry_pdf(spark)
    _files(pdf, d, "ts_us", 4)
    flush = pd.DataFrame({"instance_id": ["flush"], "ts_us": [int(pdf.ts_us.max()) + 3_600_000_000], "value": [50.0]})
    flush.to_parquet(os.path.join(d, "part-999.parquet"), index=False)
    _run(ST.window_means_stream(_stream(spark, d, "instance_id string, ts_us long, value double")), out, ck)
    got = spark.read.parquet(out).toPandas().sort_values(["instance_id", "window_start"]).reset_index(drop=True)
    batch_in = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_micros("ts_us")).withColumn("value", F.col("value").cast("decimal(12,2)"))
    want = runs.window_means(batch_in).toPandas().sort_values(["instance_id", "window_start"]).reset_index(drop=True)
    assert len(got) == len(want)
    assert (got[["instance_id", "n", "sum_cents"]].values == want[["instance_id", "n", "sum_cents"]].values).all()


def test_idle_alarm_stream_equals_batch(spark):
    d, out, ck = (tempfile.mkdtemp(prefix=p) for p in ("ain-", "aout-", "ack-"))
    base = 1_700_000_100_000_000 - (1_700_000_100_000_000 % 300_000_000)
    rows = []
    def add(inst, periods, value):
        for p in periods:
            rows.append((inst, base + p * 300_000_000 + 10_000_000, value))
            rows.append((inst, base + p * 300_000_000 + 70_000_000, value))
    add("three", [0, 1, 2], 1.0)
    add("two", [0, 1], 2.0)
    add("two", [2], 50.0)
    add("gap", [0, 1, 3, 4], 1.0)
    add("four", [0, 1, 2, 3], 4.99)
    pdf = pd.DataFrame(rows, columns=["instance_id", "ts_us", "value"])
    _files(pdf, d, "ts_us", 3)
    pd.DataFrame({"instance_id": ["flush"], "ts_us": [base + 100 * 300_000_000], "value": [50.0]}).to_parquet(
        os.path.join(d, "part-999.parquet"), index=False)
    _run(ST.idle_alarm_stream(_stream(spark, d, "instance_id string, ts_us long, value double")), out, ck)
    got = sorted((r.instance_id, r.window_start) for r in spark.read.parquet(out).collect())
    batch_in = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_micros("ts_us")).withColumn("value", F.col("value").cast("decimal(12,2)"))
    want = sorted((r.instance_id, r.window_start) for r in runs.idle_alarm(runs.window_means(batch_in)).collect())
    assert got == want
    assert sorted(set(i for i, _ in got)) == ["four", "three"] and len(got) == 3


def test_running_throughput_stream_equals_batch(spark):
    d, out, ck = (tempfile.mkdtemp(prefix=p) for p in ("sin-", "sout-", "sck-"))
    steps = derived.step_events(spark, SF).select("run_name", "event_id", "ts_us", "tokens", "loss")
    pdf = steps.toPandas()
    _files(pdf, d, "ts_us", 4)
    s = spark.readStream.schema("run_name string, event_id long, ts_us long, tokens long, loss double") \
        .option("maxFilesPerTrigger", 1).parquet(d)
    _run(ST.running_throughput_stream(s), out, ck)
    got = spark.read.parquet(out).toPandas().sort_values(["run_name", "step"]).reset_index(drop=True)
    want = runs.running_throughput(steps).toPandas().sort_values(["run_name", "step"]).reset_index(drop=True)
    assert len(got) == len(want)
    assert (got.tokens_processed.values == want.tokens_processed.values).all()
    assert (abs(got.elapsed_sec.values - want.elapsed_sec.values) < 1e-9).all()
    assert got.nonfinite.sum() == pdf.loss.isna().sum()


def test_incremental_dedup_restarts(spark):
    d, kept, ck = (tempfile.mkdtemp(prefix=p) for p in ("din-", "dkept-", "dck-"))
    docs = read_table(spark, SF, "documents").select("doc_id", "text").toPandas().sort_values("doc_id")
    parts = _split(docs, 4)
    for i in range(2):
        parts[i].to_parquet(os.path.join(d, f"part-{i:03d}.parquet"), index=False)
    src = lambda: spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(d)
    SC.incremental_dedup(src(), kept, ck).awaitTermination(300)
    for i in range(2, 4):
        parts[i].to_parquet(os.path.join(d, f"part-{i:03d}.parquet"), index=False)
    SC.incremental_dedup(src(), kept, ck).awaitTermination(300)  # resumes from the checkpoint
    got = sorted(r.doc_id for r in spark.read.parquet(kept).select("doc_id").collect())
    cls = quality.classify(read_table(spark, SF, "documents").select("doc_id", "text")).filter(F.col("reason") == "passed")
    want = sorted(r.doc_id for r in dedup.first_per_hash(cls.select("doc_id", "content_hash")).collect())
    assert got == want


def test_late_rows_beyond_watermark_are_dropped(spark):
    """Spark drops a row older than the previous batch's watermark (rows between the two
    watermarks may still count), so the late file comes two batches after the time jump."""
    d, out, ck = (tempfile.mkdtemp(prefix=p) for p in ("lin-", "lout-", "lck-"))
    base = 1_700_000_100_000_000 - (1_700_000_100_000_000 % 300_000_000)
    frames = [
        pd.DataFrame({"instance_id": ["a"] * 4, "ts_us": [base + i * 300_000_000 for i in range(4)],
                      "value": [10.0, 20.0, 30.0, 40.0]}),
        pd.DataFrame({"instance_id": ["a"], "ts_us": [base + 50 * 300_000_000], "value": [1.0]}),
        pd.DataFrame({"instance_id": ["a"], "ts_us": [base + 50 * 300_000_000 + 1_000_000], "value": [1.0]}),
        pd.DataFrame({"instance_id": ["a"], "ts_us": [base + 300_000_000 + 5_000_000], "value": [99.0]}),  # late
    ]
    for i, f in enumerate(frames):
        path = os.path.join(d, f"part-00{i}.parquet")
        f.to_parquet(path, index=False)
        os.utime(path, (1_000_000 + i * 60, 1_000_000 + i * 60))  # the file source takes files by mtime
    _run(ST.window_means_stream(_stream(spark, d, "instance_id string, ts_us long, value double")), out, ck)
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 4 and {r.n for r in rows} == {1}  # the late reading was dropped, not counted


def test_step_metrics_batches(spark):
    """Steps go on from batch to batch, bad losses and null runs included; a batch run again replaces its rows."""
    from corpuslab.streaming import steps

    folder = tempfile.mkdtemp(prefix="steps-")
    schema = "run_name string, event_id long, ts_us long, tokens long, loss double, extra string"
    first = [("a", 1, 1_000_000, 10, 1.0, "x"), ("a", 2, 3_000_000, None, float("nan"), "x"), (None, 3, 5_000_000, 7, 2.0, None)]
    second = [("a", 4, 4_000_000, 5, float("-inf"), "x"), ("b", 5, 4_000_000, 1, None, "x"), (None, 6, 6_000_000, 1, 0.5, "x")]
    for rows, i in ((first, 0), (second, 1), (second, 1), ([], 2), ([("a", 9, 5_000_000, 1, 3.0, "x")], 3)):
        steps.write_batch(spark.createDataFrame(rows, schema), i, folder, log_every=2)
    got = {name: sorted((r.run_name or "", r.step, r.tokens_processed, r.elapsed_sec, r.tokens_per_sec, r.logged)
                        for r in spark.read.parquet(f"{folder}/{name}").collect()) for name in ("steps", "quarantine")}
    assert got == {
        "steps": [("", 1, 7, 0.0, None, False), ("", 2, 8, 1.0, 8.0, True), ("a", 1, 10, 0.0, None, False), ("a", 4, 16, 4.0, 4.0, True)],
        "quarantine": [("a", 2, 10, 2.0, 5.0, True), ("a", 3, 15, 3.0, 5.0, False), ("b", 1, 1, 0.0, None, False)]}
    totals = spark.read.parquet(f"{folder}/totals/batch_id=3").collect()
    assert sorted((r.run_name or "", r.t0, r.tokens, r.steps) for r in totals) == [("", 5_000_000, 8, 2), ("a", 1_000_000, 16, 4), ("b", 4_000_000, 1, 1)]


def test_arrivals(spark):
    """Slices are equal parts of the range; a query started anew for each gets every row once."""
    from corpuslab.streaming import runner

    df = spark.createDataFrame([(i,) for i in (0, 1, 4, 5, 9)] + [(None,)], "k long")
    parts = df.withColumn("part", runner.slice_of(df, "k", 2))
    assert sorted((r.part, r.k) for r in parts.where("k is not null").collect()) == [(0, 0), (0, 1), (0, 4), (1, 5), (1, 9)]
    seen = []

    def start(stream, root):
        return stream.writeStream.foreachBatch(lambda b, i: seen.append(sorted(r.k if r.k is not None else -1 for r in b.collect()))) \
            .option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()

    runner.run_as_arrived(parts, "part", 3, "arrivals", start)
    assert [x for x in seen if x] == [[-1, 0, 1, 4], [5, 9]]
    none = df.where("false")
    assert none.withColumn("part", runner.slice_of(none, "k", 2)).count() == 0


def test_idle_alarm_has_no_python_state(spark):
    """The alarm is windows all through, with no call of Python for each instance and batch."""
    d = tempfile.mkdtemp(prefix="plan-")
    plan = ST.idle_alarm_stream(_stream(spark, d, "instance_id string, ts_us long, value double"))._jdf.queryExecution().analyzed().toString()
    assert "WithState" not in plan and plan.count("Aggregate") == 2


def test_first_batch_is_not_persisted(spark, monkeypatch):
    """With nothing kept yet the batch is read once, so it is written straight away."""
    docs = read_table(spark, SF, "documents").select("doc_id", "text")
    kept = tempfile.mkdtemp(prefix="first-") + "/kept"
    with monkeypatch.context() as m:
        m.setattr(type(docs), "persist", lambda *_: (_ for _ in ()).throw(AssertionError("persisted")))
        SC._batch_writer(kept)(docs, 0)
    SC._batch_writer(kept)(docs, 1)
    passed = quality.classify(docs).filter(F.col("reason") == "passed")
    assert spark.read.parquet(kept).count() == passed.select("content_hash").distinct().count()
    assert spark.read.parquet(f"{kept}/batch_id=1").count() == 0


def test_normalization_is_not_repeated_by_a_filter(spark):
    docs = read_table(spark, SF, "documents").select("doc_id", "text")
    plan = quality.classify(docs).filter(F.col("reason") == "passed").select("content_hash")._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("{3,}") <= 2
