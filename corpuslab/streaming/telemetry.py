"""Telemetry streams (ST1-ST3) and the step-metric stream (ST4).

Input streams carry event time as ``TIMESTAMP`` (``withWatermark`` rejects ``TIMESTAMP_NTZ``, so
cast first). Spark drops rows older than the previous batch's watermark (rows between that and the
current watermark may still count); windows are emitted once closed (append mode), so a stream's
output equals its batch twin on closed windows when data arrives within the delay.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from corpuslab.functions import constants as K


def window_means_stream(readings: DataFrame, period: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """ST1/ST2: per instance and tumbling period, readings, exact sum and mean (append mode).
    Same columns as the batch ``runs.window_means``."""
    cents = (F.col("value").cast("decimal(12,2)") * 100).cast("long")
    g = readings.withWatermark("ts", delay).groupBy("instance_id", F.window("ts", period).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents).alias("sum_cents")
    )
    return g.select("instance_id", F.col("w.start").alias("window_start"), "n", "sum_cents",
                    (F.col("sum_cents").cast("double") / F.col("n") / 100.0).alias("mean_value"))


ALARM_OUT = "instance_id string, window_start timestamp"


def idle_alarm_stream(readings: DataFrame, threshold: float = K.ALARM_THRESHOLD, periods: int = K.ALARM_EVALUATION_PERIODS,
                      period_sec: int = K.ALARM_PERIOD_SEC, delay: str = "10 minutes") -> DataFrame:
    """ST3: alarm at a period that closes ``periods`` adjacent low periods (mean < threshold);
    missing data (no readings in a period) breaks the streak. Two windows after each other, both closed by the watermark:
    the periods' counts and sums, and for the low ones a window of ``periods`` of them, sliding by one, which is
    an alarm where all are low. State holds the open periods (bounded by the watermark delay) and the low ones of open windows."""
    period = f"{period_sec} seconds"
    cents = (F.col("value").cast("decimal(12,2)") * 100).cast("long")
    closed = readings.withWatermark("ts", delay).groupBy("instance_id", F.window("ts", period).alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents).alias("sum_cents"))
    low = closed.where(F.col("sum_cents") < F.col("n") * int(round(threshold * 100)))
    runs = low.groupBy("instance_id", F.window("p", f"{period_sec * periods} seconds", period).alias("w")).agg(F.count(F.lit(1)).alias("n_low"))
    last = F.timestamp_micros(F.unix_micros("w.end") - period_sec * 1_000_000)
    return runs.where(F.col("n_low") == periods).select("instance_id", last.alias("window_start"))


STEP_STATE = "t0 long, before long, steps long"
STEP_OUT = ("run_name string, step long, tokens_processed long, elapsed_sec double, tokens_per_sec double, "
            "logged boolean, nonfinite boolean")


def _steps_fn(log_every: int):
    def fn(key, batches, state):
        t0, before, steps = state.get if state.exists else (None, 0, 0)
        pdf = pd.concat(list(batches), ignore_index=True)
        if pdf.empty:
            return
        pdf = pdf.sort_values(["ts_us", "event_id"], kind="mergesort")
        if t0 is None:
            t0 = int(pdf["ts_us"].iloc[0])
        tok = pdf["tokens"].astype("int64").to_numpy()
        processed = before + np.cumsum(tok)
        step = steps + np.arange(1, len(pdf) + 1)
        elapsed = (pdf["ts_us"].to_numpy() - t0).astype("float64") / 1000000.0
        with np.errstate(divide="ignore", invalid="ignore"):
            tps = np.where(elapsed != 0, processed.astype("float64") / np.where(elapsed != 0, elapsed, 1.0), np.nan)
        loss = pdf["loss"].astype("float64").to_numpy()
        state.update((t0, int(processed[-1]), int(step[-1])))
        out = pd.DataFrame({
            "run_name": key[0], "step": step, "tokens_processed": processed, "elapsed_sec": elapsed,
            "tokens_per_sec": tps, "logged": step % log_every == 0, "nonfinite": ~np.isfinite(loss),
        })
        out["tokens_per_sec"] = out["tokens_per_sec"].astype("float64").where(elapsed != 0, None)
        yield out
    return fn


def running_throughput_stream(steps: DataFrame, log_every: int = 10) -> DataFrame:
    """ST4: running tokens, elapsed time and tokens/s per run across micro-batches, with the
    non-finite-loss flag (F14). Assumes each run's steps arrive in order (a trainer's log does)."""
    return steps.groupBy("run_name").applyInPandasWithState(
        _steps_fn(log_every), STEP_OUT, STEP_STATE, "append", GroupStateTimeout.NoTimeout
    )
