"""Run analytics.

Each operator takes tables holding many runs and groups by the run key. Per-key lookup tables
(prices, peak rates, API prices) are fixed lists: they enter as map literals or an exploded array
literal, never as a cross join. Joins between per-run aggregates and row-level tables are plain
equi joins: AQE turns them into broadcasts when the measured size is small and splits skewed
partitions otherwise.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import constants as K
from corpuslab.operators.ordering import dense_positions, running_offsets
from corpuslab.session import stage


def map_lookup(col: Column, mapping: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), col)


# --- inference bench (A7, A8, F13, J3, J7, A13) ----------------------------------------------

def latency_summary(requests: DataFrame, concurrency: int | None = None) -> DataFrame:
    """Per run: counts, wall time, throughput and exact index percentiles (p50 = sorted[n // 2],
    p95 = sorted[int(n * 0.95)], p99 = sorted[int(n * 0.99)] over successful latencies).

    Wall time is the span from the first request start to the last request end; with
    ``concurrency`` given it is the closed-loop time instead, sum(latency) / concurrency (for
    request tables whose timestamps are not bench timestamps).

    Positions come from ``dense_positions`` grouped by run (range-partitioned, so one huge run is
    spread over many tasks); the three target positions per run are then equi-joined on
    (run, position), a key unique on both sides."""
    ok = requests.filter(F.col("error").isNull())
    start_us = F.unix_micros("ts")
    end_us = start_us + (F.col("latency_sec") * 1000000).cast("long")
    summary = requests.groupBy("run_name").agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(F.col("error").isNull()).alias("successful"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("tokens_generated"))), F.lit(0)).alias("total_tokens_generated"),
        (F.max(end_us) - F.min(start_us)).alias("_span_us"),
        F.sum("latency_sec").alias("_lat_sum"),
    )
    if concurrency:
        total_time = F.round(F.col("_lat_sum") * F.lit(Decimal(1) / Decimal(concurrency)), 2).cast("double")
    else:
        total_time = F.round(F.col("_span_us").cast("decimal(20,0)") * F.lit(Decimal("0.000001")), 2).cast("double")
    # one row per run, read by two branches: written once instead of re-aggregating every request
    summary = stage(summary.withColumn("total_time_sec", total_time).drop("_span_us", "_lat_sum"), "latency-summary")
    pos = dense_positions(ok.select("run_name", "request_id", "latency_sec"), ["latency_sec", "request_id"], "pos",
                          group=["run_name"])
    n = F.col("successful")
    targets = summary.filter(n > 0).select(
        "run_name",
        F.explode(F.array(
            F.struct(F.lit("p50").alias("q"), F.floor(n / 2).cast("long").alias("pos")),
            F.struct(F.lit("p95").alias("q"), F.floor(n * 0.95).cast("long").alias("pos")),
            F.struct(F.lit("p99").alias("q"), F.floor(n * 0.99).cast("long").alias("pos")),
        )).alias("t"),
    ).select("run_name", "t.q", "t.pos")
    picked = targets.join(pos, on=["run_name", "pos"]).groupBy("run_name").pivot("q", ["p50", "p95", "p99"]).agg(
        F.first(F.round("latency_sec", 3).cast("double"))
    )
    out = summary.join(picked, on="run_name", how="left")
    return out.select(
        "run_name", "total_requests", "successful", "failed", "total_time_sec", "total_tokens_generated",
        F.round(F.try_divide(F.col("total_tokens_generated").cast("double"), F.col("total_time_sec")), 1).alias("aggregate_tokens_per_sec"),
        F.round(F.try_divide(F.col("successful").cast("double"), F.col("total_time_sec")), 2).alias("requests_per_sec"),
        F.coalesce("p50", F.lit(0.0)).alias("latency_p50_sec"),
        F.coalesce("p95", F.lit(0.0)).alias("latency_p95_sec"),
        F.coalesce("p99", F.lit(0.0)).alias("latency_p99_sec"),
    )


def inference_cost(summary: DataFrame, instance_col: str = "instance_type") -> DataFrame:
    """Self-hosted cost per 1M tokens vs API prices. Inner lookup: unknown instance type or zero
    throughput gives no rows (J3). The API list is a fixed 3-row literal exploded per run (J7)."""
    cph = map_lookup(F.col(instance_col), K.INFERENCE_COST_PER_HOUR)
    base = summary.select("run_name", F.col(instance_col).alias("instance_type"), cph.alias("cost_per_hour"),
                          F.col("aggregate_tokens_per_sec").alias("tps"))
    base = base.filter(F.col("cost_per_hour").isNotNull() & (F.col("cost_per_hour") != 0) & (F.col("tps") != 0))
    cost_1m = (F.col("cost_per_hour") / 3600.0) / F.col("tps") * 1000000.0
    apis = F.array(*[F.struct(F.lit(k).alias("api"), F.lit(v).alias("api_cost_per_1m")) for k, v in K.API_PRICES_PER_1M.items()])
    return base.select("*", cost_1m.alias("_c1m"), F.explode(apis).alias("a")).select(
        "run_name", "instance_type", "cost_per_hour",
        F.round("_c1m", 4).alias("self_hosted_cost_per_1m_tokens"),
        F.col("a.api").alias("api"), F.col("a.api_cost_per_1m").alias("api_cost_per_1m"),
        F.round(F.col("_c1m") / F.col("a.api_cost_per_1m") * 100, 1).alias("breakeven_utilization_pct"),
        (F.col("_c1m") < F.col("a.api_cost_per_1m")).alias("cheaper_self_hosted"),
    )


def prompt_assignment(requests: DataFrame, n_prompts: int = len(K.PROMPTS)) -> DataFrame:
    """Request i of a run (in request order) gets prompt i % len(prompts)."""
    pos = dense_positions(requests.select("run_name", "request_id"), ["request_id"], "i", group=["run_name"])
    prompts = F.array(*[F.lit(p) for p in K.PROMPTS[:n_prompts]])
    idx = F.pmod(F.col("i"), F.lit(n_prompts)).cast("int")
    return pos.select("run_name", "request_id", idx.alias("prompt_index"), F.element_at(prompts, idx + 1).alias("prompt"))


# --- training progress (W4, F14, F15) -------------------------------------------------------------

def running_throughput(step_events: DataFrame, log_every: int = 10) -> DataFrame:
    """Per run and step: tokens processed so far, elapsed seconds since the run's first step,
    tokens/s, and whether the step is one the reference logs (every ``log_every``-th)."""
    run_start = step_events.groupBy("run_name").agg(F.min("ts_us").alias("_t0"))
    sums = running_offsets(step_events.select("run_name", "event_id", "ts_us", "tokens"), ["ts_us", "event_id"],
                           ["tokens", F.lit(1)], ["_before", "_step"], group=["run_name"])
    out = sums.join(run_start, on="run_name")
    elapsed = (F.col("ts_us") - F.col("_t0")).cast("double") / 1000000.0
    processed = F.col("_before") + F.col("tokens")
    return out.select(
        "run_name",
        (F.col("_step") + 1).alias("step"),
        processed.alias("tokens_processed"),
        elapsed.alias("elapsed_sec"),
        F.try_divide(processed.cast("double"), elapsed).alias("tokens_per_sec"),
        (F.pmod(F.col("_step") + 1, F.lit(log_every)) == 0).alias("logged"),
    )


def nonfinite_guard(step_events: DataFrame) -> DataFrame:
    """per run, how many steps had a non-finite loss and the first such event (the reference
    aborts the run there)."""
    bad = F.isnan("loss") | (F.abs("loss") == float("inf"))
    return step_events.groupBy("run_name").agg(
        F.count_if(bad).alias("bad_rows"),
        F.min(F.when(bad, F.col("ts_us"))).alias("first_bad_ts_us"),
    )


# --- cost report (A12, J2, J4, J5, S20) ------------------------------------------------------------

def run_summary(runs: DataFrame, evals: DataFrame, exports: DataFrame) -> DataFrame:
    """Training ⟕ eval ⟕ export per run, with GPU hours and cost; unknown instance -> null cost."""
    hourly = map_lookup(F.col("instance_type"), K.INSTANCE_HOURLY_PRICES)
    gpu_hours = (F.col("total_time_sec") / 3600.0) * F.col("world_size")
    s = runs.join(evals, on="run_name", how="left").join(exports, on="run_name", how="left")
    return s.select(
        "*",
        gpu_hours.alias("gpu_hours"),
        (gpu_hours * (hourly / F.col("gpus_per_node"))).alias("estimated_cost_usd"),
    )


REPORT_METRICS = [
    ("gpu_hours", "gpu_hours"),
    ("tokens_per_sec", "final_tokens_per_sec"),
    ("cost_usd", "estimated_cost_usd"),
    ("perplexity", "perplexity"),
    ("resumed_from_step", "resumed_from_step"),
]


def run_report(summary: DataFrame, baseline_key: str = "instance_type") -> DataFrame:
    """Every run against the baseline run of its group (the first run in run order), long form
    (run, metric, baseline, current, delta), values rounded to 2 digits like the report table;
    delta is null when either side is null."""
    summary = stage(summary, "run-summary")  # one row per run, read by both sides of the comparison
    base_ids = summary.groupBy(baseline_key).agg(F.min("user_id").alias("user_id"))
    metric_struct = [F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("v")) for m, c in REPORT_METRICS]
    cur = summary.select("run_name", baseline_key, F.explode(F.array(*metric_struct)).alias("m")).select(
        "run_name", baseline_key, "m.metric", F.col("m.v").alias("current_v"))
    base = summary.join(base_ids, on=[baseline_key, "user_id"], how="left_semi").select(
        baseline_key, F.explode(F.array(*metric_struct)).alias("b")).select(baseline_key, "b.metric", F.col("b.v").alias("base_v"))
    j = cur.join(base, on=[baseline_key, "metric"], how="left")
    return j.select(
        "run_name", "metric",
        F.round("base_v", 2).alias("baseline"),
        F.round("current_v", 2).alias("current"),
        # + 0.0 turns a rounded -0.0 into 0.0 (engines differ on the sign of a rounded tiny negative)
        (F.round(F.col("current_v") - F.col("base_v"), 2) + F.lit(0.0)).alias("delta"),
    )


# Row labels of the reference's report table, in its order.
REPORT_LABELS = {
    "gpu_hours": "GPU hours to passing checkpoint",
    "tokens_per_sec": "Tokens/sec",
    "cost_usd": "Cost per trained model (USD)",
    "perplexity": "Perplexity",
    "resumed_from_step": "Resumed from step",
}


def report_markdown(report: DataFrame) -> DataFrame:
    """The report table rows as Markdown lines ``| label | baseline | this run | delta |``;
    null -> n/a."""
    from corpuslab.functions.fmt import fmt_num

    label = map_lookup(F.col("metric"), REPORT_LABELS)
    line = F.concat(F.lit("| "), label, F.lit(" | "), fmt_num(F.col("baseline")), F.lit(" | "),
                    fmt_num(F.col("current")), F.lit(" | "), fmt_num(F.col("delta")), F.lit(" |"))
    return report.select("run_name", "metric", line.alias("line"))


def fleet_cost(instances: DataFrame) -> DataFrame:
    """Running instances per type x hourly price; unknown type -> null cost."""
    price = map_lookup(F.col("instance_type"), K.INSTANCE_HOURLY_PRICES)
    g = instances.groupBy("instance_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select("instance_type", "n", (F.col("n") * price).alias("hourly_cost"),
                    (F.col("n") * price * 24).alias("daily_cost"))


# --- MFU, profiler (A9, A10, A11, F16, L2) ------------------------------------------------------

def mfu(runs: DataFrame, gpu_model_of: dict, model_params: int) -> DataFrame:
    """tokens/s x 6 x params / 1e12 against peak TFLOPS x GPUs; unknown GPU -> V100."""
    model = F.coalesce(map_lookup(F.col("instance_type"), gpu_model_of), F.lit(K.DEFAULT_GPU_MODEL))
    theoretical = map_lookup(model, K.GPU_TFLOPS) * F.col("world_size")
    achieved = F.col("final_tokens_per_sec") * (6 * model_params) / 1e12
    return runs.select(
        "run_name",
        model.alias("gpu_model"),
        F.col("world_size").alias("gpu_count"),
        theoretical.alias("theoretical_tflops"),
        F.round(achieved, 1).alias("achieved_tflops"),
        F.round(achieved / theoretical * 100, 1).alias("mfu_percent"),
    )


def key_averages(op_events: DataFrame) -> DataFrame:
    return op_events.groupBy("run_name", "key").agg(
        F.sum("cuda_time_us").alias("cuda_time_us"), F.sum("cpu_time_us").alias("cpu_time_us"),
        F.count(F.lit(1)).alias("calls"),
    )


def profile_breakdown(averages: DataFrame, pattern: str = "nccl") -> DataFrame:
    """A9 + F16: communication (key contains ``pattern``, case-insensitive) vs compute time."""
    comm = F.lower(F.col("key")).contains(pattern)
    g = averages.groupBy("run_name").agg(
        F.sum("cuda_time_us").alias("_tot"), F.coalesce(F.sum(F.when(comm, F.col("cuda_time_us"))), F.lit(0)).alias("_comm")
    )
    tot, comm_t = F.col("_tot").cast("double"), F.col("_comm").cast("double")
    return g.select(
        "run_name",
        (F.col("_tot") * F.lit(Decimal("0.001"))).cast("double").alias("total_cuda_time_ms"),
        (F.col("_comm") * F.lit(Decimal("0.001"))).cast("double").alias("nccl_time_ms"),
        ((F.col("_tot") - F.col("_comm")) * F.lit(Decimal("0.001"))).cast("double").alias("compute_time_ms"),
        F.when(tot > 0, F.round(comm_t / tot * 100, 1)).otherwise(F.lit(0.0)).alias("nccl_percent"),
        F.when(tot > 0, F.round((tot - comm_t) / tot * 100, 1)).otherwise(F.lit(0.0)).alias("compute_percent"),
    )


def top_ops(averages: DataFrame, k: int = 10) -> DataFrame:
    """L2: the k ops with the most device time per run (ties by key). The window runs on the
    per-(run, key) aggregate, which holds one row per distinct op of a run."""
    w = Window.partitionBy("run_name").orderBy(F.col("cuda_time_us").desc(), F.col("key"))
    return averages.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "run_name", "rank", F.col("key").alias("name"),
        (F.col("cuda_time_us") * F.lit(Decimal("0.001"))).cast("double").alias("cuda_time_ms"),
        (F.col("cpu_time_us") * F.lit(Decimal("0.001"))).cast("double").alias("cpu_time_ms"),
        "calls",
    )


# --- scaling (W5, J6, A14) --------------------------------------------------------------------------

def scaling_efficiency(results: DataFrame, suite_col: str = "suite") -> DataFrame:
    """Baseline per suite: first successful 1-GPU config, else first successful config. Speedup
    (2 dp) and efficiency % (1 dp) against it; failed or zero-throughput configs get 0; a
    zero-throughput baseline gives null instead of dividing by zero."""
    ok = F.col("exit_code") == 0
    pref = F.when(ok & (F.col("num_gpus") == 1), F.lit(0)).when(ok, F.lit(1))
    w = Window.partitionBy(suite_col).orderBy(F.col("_pref").asc_nulls_last(), "config_order")
    ranked = results.withColumn("_pref", pref)
    first_row = F.first(F.when(F.col("_pref").isNotNull(), F.struct("final_tokens_per_sec", "num_gpus")), ignorenulls=True)
    with_base = ranked.withColumn("_b", first_row.over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    speed = F.try_divide(F.col("final_tokens_per_sec"), F.col("_b.final_tokens_per_sec"))
    ideal = F.col("num_gpus") / F.col("_b.num_gpus")
    dead = (~ok) | (F.col("final_tokens_per_sec") == 0)
    return with_base.select(
        suite_col, "config", "num_gpus", "exit_code",
        F.when(F.col("_b").isNull(), F.lit(None)).when(dead, F.lit(0.0)).otherwise(F.round(speed, 2)).alias("speedup"),
        F.when(F.col("_b").isNull(), F.lit(None)).when(dead, F.lit(0.0)).otherwise(F.round(speed / ideal * 100, 1)).alias("scaling_efficiency"),
    )


# --- telemetry (A16, ST2, W6) ----------------------------------------------------------------------

def window_means(telemetry: DataFrame, period: str = "5 minutes") -> DataFrame:
    """Per instance and tumbling period: readings, exact sum (cents) and mean (null if none)."""
    cents = (F.col("value") * 100).cast("long")
    g = telemetry.groupBy("instance_id", F.window("ts", period).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents).alias("sum_cents")
    )
    return g.select(
        "instance_id", F.col("w.start").alias("window_start"), "n", "sum_cents",
        (F.col("sum_cents").cast("double") / F.col("n") / 100.0).alias("mean_value"),
    )


def idle_alarm(means: DataFrame, threshold: float = K.ALARM_THRESHOLD, periods: int = K.ALARM_EVALUATION_PERIODS,
               period_sec: int = K.ALARM_PERIOD_SEC) -> DataFrame:
    """``periods`` consecutive periods (adjacent window starts, no gap) with mean < threshold.
    Missing data breaks the streak. The window runs on per-period aggregates (one row per
    instance and period), not on raw readings."""
    low = means.withColumn("_low", F.col("sum_cents") < F.col("n") * int(round(threshold * 100)))
    w = Window.partitionBy("instance_id").orderBy("window_start")
    cond = F.col("_low")
    for i in range(1, periods):
        prev_start = F.lag("window_start", i).over(w)
        prev_low = F.lag("_low", i).over(w)
        cond = cond & prev_low & (F.timestamp_diff("SECOND", prev_start, F.col("window_start")) == i * period_sec)
    return low.withColumn("alarm", F.coalesce(cond, F.lit(False))).filter("alarm").select("instance_id", "window_start")
