"""Run-analytics inputs derived from the driver's tables.

The reference reads one JSON file per run (training metrics, eval result, export manifest,
checkpoint ``meta.json``, profiler ``key_averages``, bench results). Here each becomes a table holding
many runs, derived from the driver tables so that its size grows with them. The same rules are
written in SQL in ``plans/oracle_runs.py``:

* requests: ``events`` row = one inference request of run ``run-<user_id>``; latency =
  ``value``/100 s (exact decimal), tokens = (``props.k`` + 1) x 16, ``event_type='error'`` = failed.
* steps: ``events`` of a user in (ts, event_id) order = training steps; tokens = (k + 1) x 1024,
  loss = ``value``/50, NaN for an 'error' event (a non-finite loss); a 'purchase' event saves a checkpoint.
* runs / evals / exports: per user; instance type from the customer's market segment.
* checkpoints: ``orders`` of customer c = checkpoints of ``run-<c>`` at step ``o_orderkey``.
* rank reports: ``lineitem`` rows of an order = one report per rank of that checkpoint.
* op events: ``lineitem`` rows = profiler events of ``run-<l_suppkey>``.
* telemetry: ``events`` = GPU utilization readings of instance ``i-<user_id>``, on a clock 120 times as fast (so
  that periods hold several readings and follow each other) and at a fifth of ``value`` (so that some are idle).
* scaling: ``lineitem`` grouped by (returnflag, linenumber) = configurations of a benchmark suite.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.session import read_table

# Derivation rules (ours, not reference values): market segment -> instance types, GPUs per node.
SEGMENT_TRAINING_INSTANCE = {
    "AUTOMOBILE": "g5.xlarge",
    "BUILDING": "g5.12xlarge",
    "FURNITURE": "p3.8xlarge",
    "HOUSEHOLD": "p4d.24xlarge",
    "MACHINERY": "trn1.2xlarge",
}
SEGMENT_INFERENCE_INSTANCE = {
    "AUTOMOBILE": "g5.xlarge",
    "BUILDING": "g5.2xlarge",
    "FURNITURE": "p3.2xlarge",
    "HOUSEHOLD": "p3.8xlarge",
    "MACHINERY": "p4d.24xlarge",
}
GPUS_PER_NODE = {"g5.xlarge": 1, "g5.12xlarge": 4, "p3.8xlarge": 4, "p4d.24xlarge": 8, "trn1.2xlarge": 1}
# GPU model by instance family, for MFU peak rates; anything else falls back to the default model.
INSTANCE_GPU_MODEL = {"p3.2xlarge": "V100", "p3.8xlarge": "V100", "p3.16xlarge": "V100",
                      "p4d.24xlarge": "A100", "p4de.24xlarge": "A100", "p5.48xlarge": "H100"}
OP_NAMES = ["aten::mm", "ncclKernel_AllReduce", "aten::addmm", "ncclKernel_AllGather", "aten::softmax",
            "aten::layer_norm", "aten::gelu"]
MODEL_PARAMS = 355_000_000  # gpt2-medium, the model of the reference's published runs

CENT = Decimal("0.01")
TELEMETRY_SPEED = 120


def _map(col: str, mapping: dict) -> F.Column:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.element_at(m, F.col(col)) if mapping else F.lit(None)


def _run(col: str) -> F.Column:
    return F.concat(F.lit("run-"), F.col(col).cast("string"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        _run("user_id").alias("run_name"),
        F.col("user_id"),
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("value").cast("decimal(12,2)") * F.lit(CENT)).alias("latency_sec"),
        ((F.get_json_object("props", "$.k").cast("long") + 1) * 16).alias("tokens_generated"),
        F.when(F.col("event_type") == "error", F.lit("request failed")).alias("error"),
    )


def step_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unnumbered step rows: (run_name, user_id, event_id, ts, ts_us, tokens, loss)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        _run("user_id").alias("run_name"),
        "user_id",
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        # microseconds since the epoch of the naive timestamp itself: no session time zone involved
        F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")).alias("ts_us"),
        ((F.get_json_object("props", "$.k").cast("long") + 1) * 1024).alias("tokens"),
        F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value") / 50.0).alias("loss"),
        (F.col("event_type") == "purchase").alias("saved"),  # a checkpoint was finished at this step
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("user_id"),
        _map("c_mktsegment", SEGMENT_TRAINING_INSTANCE).alias("instance_type"),
        _map("c_mktsegment", SEGMENT_INFERENCE_INSTANCE).alias("inference_instance_type"),
        (F.col("c_nationkey") % 2 + 1).alias("num_nodes"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per training run, the fields of the reference's training metrics file."""
    st = step_events(spark, sf_dir)
    per_run = st.groupBy("run_name", "user_id").agg(
        F.count(F.lit(1)).alias("total_steps"),
        F.sum("tokens").alias("total_tokens"),
        ((F.max("ts_us") - F.min("ts_us")).cast("double") / 1000000.0).alias("total_time_sec"),
    )
    c = customers(spark, sf_dir)
    gpn = F.coalesce(_map("instance_type", GPUS_PER_NODE), F.lit(1))
    return per_run.join(c, on="user_id", how="left").select(
        "run_name",
        "user_id",
        "instance_type",
        "inference_instance_type",
        gpn.cast("int").alias("gpus_per_node"),
        (gpn * F.coalesce(F.col("num_nodes"), F.lit(1))).cast("int").alias("world_size"),
        "total_time_sec",
        "total_steps",
        "total_tokens",
        F.try_divide(F.col("total_tokens").cast("double"), F.col("total_time_sec")).alias("final_tokens_per_sec"),
        F.lit(0).cast("long").alias("resumed_from_step"),
    )


def evals(spark: SparkSession, sf_dir: str, max_perplexity: float = 90.0) -> DataFrame:
    """Eval result per run: perplexity = exp(last finite loss); gate as in the reference."""
    st = step_events(spark, sf_dir).filter(~F.isnan("loss"))
    last = st.groupBy("run_name").agg(F.max_by("loss", F.struct("ts_us", "event_id")).alias("loss"))
    ppl = F.exp("loss")
    return last.select("run_name", ppl.alias("perplexity"), (ppl <= F.lit(max_perplexity)).alias("passed"))


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("artifact_file_count"),
        F.sum((F.col("o_totalprice").cast("decimal(15,2)") * 100).cast("long")).alias("artifact_size_bytes"),
        F.max("o_orderkey").alias("_last"),
    ).select(
        _run("o_custkey").alias("run_name"),
        "artifact_file_count",
        "artifact_size_bytes",
        F.concat(F.lit("sha256:"), F.sha2(F.col("_last").cast("string"), 256)).alias("artifact_checksum"),
        F.concat(F.lit("s3://models/"), _run("o_custkey")).alias("storage_location"),
    )


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint catalogue: status 'O' = write never finished, 'P' = full checkpoint whose bytes
    changed after the checksum was recorded."""
    o = read_table(spark, sf_dir, "orders")
    sharded = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    key = F.col("o_orderkey").cast("string")
    from corpuslab.operators.artifacts import checkpoint_step

    return o.select(
        _run("o_custkey").alias("run_name"),
        F.concat(F.lit("runs/"), _run("o_custkey"), F.lit("/checkpoint-"), key).alias("path"),
        "o_orderkey", "o_orderpriority", "o_orderstatus",
    ).select(
        "run_name", "path",
        checkpoint_step("path").alias("step"),  # S12: numeric step from the directory name
        sharded.alias("sharded"),
        F.when(~sharded, F.sha2(key, 256)).alias("checksum"),
        F.when(~sharded & (F.col("o_orderstatus") != "O"),
               F.sha2(F.concat(key, F.when(F.col("o_orderstatus") == "P", F.lit("-changed")).otherwise(F.lit(""))), 256)
               ).alias("actual_checksum"),
        (sharded & (F.col("o_orderstatus") != "O")).alias("has_model"),
        (sharded & (F.col("o_orderstatus") != "O")).alias("has_train_state"),
        (~sharded & (F.col("o_orderstatus") != "O")).alias("has_state"),
        (F.col("o_orderpriority") != "5-LOW").alias("in_manifest"),
    )


def rank_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("checkpoint"),
        F.col("l_linenumber").alias("rank"),
        F.when(F.col("l_returnflag") == "N", F.col("l_orderkey")).otherwise(F.col("l_orderkey") - 1).alias("step"),
    )


def op_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    name = F.element_at(F.array(*[F.lit(x) for x in OP_NAMES]), F.col("l_linenumber"))
    return li.select(
        _run("l_suppkey").alias("run_name"),
        F.concat(name, F.lit("/"), F.col("l_returnflag"), F.col("l_linestatus")).alias("key"),
        F.col("l_extendedprice").cast("decimal(15,2)").alias("cuda_time_us"),
        (F.col("l_extendedprice").cast("decimal(15,2)") * F.col("l_discount").cast("decimal(4,2)")).alias("cpu_time_us"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_of(read_table(spark, sf_dir, "events"))


def telemetry_of(ev: DataFrame) -> DataFrame:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    us = F.timestamp_diff("MICROSECOND", epoch, F.col("ts"))
    fast = F.floor(us / F.lit(TELEMETRY_SPEED)).cast("decimal(18,0)") * F.lit(Decimal("0.000001"))
    zero = F.lit(0)
    cents = F.floor((F.col("value").cast("decimal(12,2)") * 100).cast("long") / F.lit(5))
    return ev.select(
        # naive timestamps: windows are computed on the wall clock, independent of time zones
        (epoch + F.make_dt_interval(zero, zero, zero, fast.cast("decimal(18,6)"))).alias("ts"),
        F.concat(F.lit("i-"), F.col("user_id").cast("string")).alias("instance_id"),
        "event_id",
        F.lit("GPUUtilization").alias("metric"),
        (cents.cast("decimal(10,0)") * F.lit(CENT)).cast("decimal(12,2)").alias("value"),
        F.col("user_id"),
    )


def scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    g = li.groupBy("l_returnflag", "l_linenumber").agg(
        F.sum("l_quantity").alias("tps"), F.count(F.lit(1)).alias("n")
    )
    return g.select(
        F.col("l_returnflag").alias("suite"),
        F.concat(F.lit("g"), F.col("l_linenumber").cast("string")).alias("config"),
        F.col("l_linenumber").alias("config_order"),
        F.col("l_linenumber").alias("num_gpus"),
        F.when(F.col("l_linenumber") > 4, F.lit(2)).otherwise(F.lit(1)).alias("num_nodes"),
        F.lit(4).alias("batch_size"),
        F.when(F.col("n") % 7 == 0, F.lit(1)).otherwise(F.lit(0)).alias("exit_code"),
        F.col("tps").alias("final_tokens_per_sec"),
    )


EXPORT_FILES = ["config.json", "model.safetensors", "tokenizer.json", "export_manifest.json"]


def artifact_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artifact, rel_path): what an object-store listing shows for each checkpoint directory (its
    meta file plus the files the catalogue says exist) and each exported model directory."""
    ck = checkpoints(spark, sf_dir)
    files = F.array_compact(F.array(
        F.lit("meta.json"),
        F.when(F.col("has_model"), F.lit("model/__0_0.distcp")),
        F.when(F.col("has_train_state"), F.lit("train_state.pt")),
        F.when(F.col("has_state"), F.lit("state.pt")),
    ))
    ck_files = ck.select(F.col("path").alias("artifact"), F.explode(files).alias("rel_path"))
    ex = exports(spark, sf_dir).select(F.col("storage_location").alias("artifact"),
                                       F.explode(F.array(*[F.lit(f) for f in EXPORT_FILES])).alias("rel_path"))
    return ck_files.unionByName(ex)


def artifact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing with contents: a file's bytes are its own full path."""
    files = artifact_listing(spark, sf_dir)
    return files.withColumn("content", F.concat_ws("/", "artifact", "rel_path").cast("binary"))


def step_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward and backward seconds of profiled steps: ``lineitem`` of a supplier = steps of ``run-<l_suppkey>``."""
    li = read_table(spark, sf_dir, "lineitem")
    milli = F.lit(Decimal("0.001"))
    return li.select(
        _run("l_suppkey").alias("run_name"), F.col("l_orderkey").alias("step"),
        (F.col("l_quantity").cast("decimal(12,2)") * milli).alias("forward_sec"),
        (F.col("l_extendedprice").cast("decimal(15,2)") * milli).alias("backward_sec"),
    )

