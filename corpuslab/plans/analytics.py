"""Run-analytics queries over tables derived from the driver data (see ``sources/derived.py``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators import artifacts as AR
from corpuslab.operators import incidents as I
from corpuslab.operators import manifests as M
from corpuslab.operators import runs as R
from corpuslab.sources import derived as D


BENCH_CONCURRENCY = 8  # request workers of the reference's load generator


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latency_summary(D.requests(spark, sf_dir), BENCH_CONCURRENCY)


def inference_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = R.latency_summary(D.requests(spark, sf_dir), BENCH_CONCURRENCY)
    runs = D.requests(spark, sf_dir).select("run_name", "user_id").distinct()
    typed = summary.join(runs, on="run_name").join(
        D.customers(spark, sf_dir).select("user_id", F.col("inference_instance_type").alias("instance_type")), on="user_id"
    )
    return R.inference_cost(typed, "instance_type")


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.prompt_assignment(D.requests(spark, sf_dir))


def running_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.running_throughput(D.step_events(spark, sf_dir))


def nonfinite_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nonfinite_guard(D.step_events(spark, sf_dir))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.run_summary(D.runs(spark, sf_dir), D.evals(spark, sf_dir), D.exports(spark, sf_dir))


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.run_report(run_summary(spark, sf_dir))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's rows as Markdown lines."""
    return R.report_markdown(run_report(spark, sf_dir))


def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.token_cost(run_summary(spark, sf_dir))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.number_steps(D.step_events(spark, sf_dir).select("run_name", "event_id", "ts_us", "loss", "saved"))


def loss_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.loss_spikes(_numbered(spark, sf_dir))


def stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that stood still for over a day."""
    return I.stalls(_numbered(spark, sf_dir), 86_400)


def lost_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A non-finite loss ends the run there."""
    return I.lost_work(_numbered(spark, sf_dir), F.isnan("loss"), F.col("saved"))


def step_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.step_timing(D.step_times(spark, sf_dir))


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full checkpoints listed in a run's manifest, against the files that are there."""
    from corpuslab.operators.ordering import dense_positions

    full = D.checkpoints(spark, sf_dir).where(~F.col("sharded"))
    listed = full.where("in_manifest").select("run_name", "path", "step", F.col("checksum").alias("listed_checksum"))
    entries = dense_positions(listed, ["step"], "file_index", group=["run_name"]).drop("step")
    there = full.where("has_state").select("path", F.col("actual_checksum").alias("raw_checksum_sha256"))
    return M.replay_entries(entries, there)


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset is a source of ``documents``; run ``run-<n>`` was trained on ``src<n mod 25>``."""
    from corpuslab.session import read_table

    datasets = read_table(spark, sf_dir, "documents").groupBy(F.col("source").alias("dataset_version")).agg(F.count("*").alias("n_docs"))
    runs = D.runs(spark, sf_dir).select(F.concat(F.lit("src"), (F.col("user_id") % 25).cast("string")).alias("dataset_version"),
                                        F.col("run_name").alias("run_id"))
    newest = AR.latest_valid(D.checkpoints(spark, sf_dir)).select(F.col("run_name").alias("run_id"), F.col("path").alias("checkpoint_path"))
    evals = newest.join(D.evals(spark, sf_dir).select(F.col("run_name").alias("run_id"), "passed"), on="run_id") \
        .select("checkpoint_path", "passed")
    published = newest.join(D.exports(spark, sf_dir).select(F.col("run_name").alias("run_id"), "storage_location"), on="run_id") \
        .join(evals.where("passed").select("checkpoint_path"), on="checkpoint_path").select("checkpoint_path", "storage_location")
    return M.lineage(datasets, runs, newest, evals, published)


def artifact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AR.directory_digest(D.artifact_files(spark, sf_dir))


def fleet_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    inst = D.telemetry(spark, sf_dir).select("instance_id", "user_id").distinct()
    typed = inst.join(D.customers(spark, sf_dir).select("user_id", "instance_type"), on="user_id", how="left")
    return R.fleet_cost(typed)


def mfu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mfu(D.runs(spark, sf_dir), D.INSTANCE_GPU_MODEL, D.MODEL_PARAMS)


def profile_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.profile_breakdown(R.key_averages(D.op_events(spark, sf_dir)))


def top_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_ops(R.key_averages(D.op_events(spark, sf_dir)))


def scaling_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scaling_efficiency(D.scaling(spark, sf_dir))


def gpu_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.window_means(D.telemetry(spark, sf_dir))


def idle_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.idle_alarm(R.window_means(D.telemetry(spark, sf_dir)))


def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AR.latest_valid(D.checkpoints(spark, sf_dir))


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AR.retention(D.checkpoints(spark, sf_dir))


def rank_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AR.rank_agreement(D.rank_reports(spark, sf_dir))


def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    ck = D.checkpoints(spark, sf_dir).filter(~F.col("sharded"))
    manifest = ck.filter("in_manifest").select("path", "checksum")
    observed = ck.filter("has_state").select("path", F.col("actual_checksum").alias("checksum"))
    return AR.integrity(manifest, observed)


def artifact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per artifact, its files in path order (joined with ',') and their count."""
    idx = AR.artifact_index(D.artifact_listing(spark, sf_dir))
    return idx.select("artifact", F.size("files").cast("long").alias("n_files"), F.array_join("files", ",").alias("files"))


def artifact_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw checkpoint (state.pt without config.json) or serveable, per artifact."""
    return AR.artifact_kind(D.artifact_listing(spark, sf_dir))


LOG_EVERY = 10  # the reference logs every 10th step


def write_training_logs(spark: SparkSession, sf_dir: str) -> str:
    """One log per run in the reference's line format, from the derived step events, written as
    text partitioned by run under the checkpoint folder."""
    import uuid

    from corpuslab.operators.ordering import dense_positions
    from corpuslab.session import checkpoint_root

    st = D.step_events(spark, sf_dir).select("run_name", "event_id", "ts_us", "tokens", "loss")
    numbered = dense_positions(st, ["ts_us", "event_id"], "_i", group=["run_name"])
    n_steps = st.groupBy("run_name").agg(F.count(F.lit(1)).alias("_max"))
    step = F.col("_i") + 1
    line = F.format_string("Step %d/%d | Loss: %.4f | LR: %.2e | Tokens/sec: %.0f | GPU Mem: %.0fMB",
                           step, F.col("_max"), F.col("loss"), F.lit(1e-4), F.col("tokens").cast("double"), F.lit(900.0))
    logged = numbered.filter(F.pmod(step, F.lit(LOG_EVERY)) == 0).join(n_steps, on="run_name")
    path = f"{checkpoint_root(spark).rstrip('/')}/staged/logs-{uuid.uuid4().hex}"
    # one file per run, lines in step order
    logged.select("run_name", step.alias("_s"), line.alias("value")).repartition("run_name") \
        .sortWithinPartitions("run_name", "_s").drop("_s").write.partitionBy("run_name").text(path)
    return path


def log_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last logged step and the number of step lines per run, scanned from the logs."""
    from corpuslab.sources.files import STEP_LINE, training_log_progress

    path = write_training_logs(spark, sf_dir)
    prog = training_log_progress(spark, path)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"),
                                         F.regexp_extract("value", STEP_LINE, 1).alias("_s"))
    counts = lines.filter(F.col("_s") != "").groupBy("file").agg(F.count(F.lit(1)).alias("n_logged"))
    run = F.regexp_extract("file", r"run_name=([^/]+)/", 1)
    return prog.join(counts, on="file").select(run.alias("run_name"), "last_step", "n_logged")


def log_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of a run's last logged step, scanned from the logs."""
    from corpuslab.sources.files import training_log_progress

    prog = training_log_progress(spark, write_training_logs(spark, sf_dir))
    return prog.select(F.regexp_extract("file", r"run_name=([^/]+)/", 1).alias("run_name"), "last_step", "last_loss", "last_lr",
                       "last_tokens_per_sec", "last_gpu_mem_mb", "resumed_from_step")
