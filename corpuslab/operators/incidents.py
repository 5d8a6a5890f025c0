"""Incidents of training runs: loss spikes (P13), stalls (P14), work lost to crashes (P12), token cost (P10).

A run may hold any share of all steps. Steps are numbered by the ordering helper, and windows then run
over blocks of ``BLOCK`` steps of a run, so no task gets a whole run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.ordering import dense_positions

BLOCK = 1 << 14  # steps of a run in one window partition; answers do not depend on it


def number_steps(steps: DataFrame) -> DataFrame:
    """``steps`` (run_name, ts_us, event_id, ...) plus ``step``, 1-based in time order."""
    pos = dense_positions(steps, ["ts_us", "event_id"], "_pos", group=["run_name"])
    return pos.withColumn("step", F.col("_pos") + 1).drop("_pos")


def _blocks(numbered: DataFrame, reach: int, block: int) -> DataFrame:
    """Rows with their block; the last ``reach`` rows of a block come again in the next one, not owned."""
    if reach > block:
        raise ValueError("a window may not reach past the block before")
    at = F.col("step") - 1
    own = F.floor(at / block)
    copies = F.when(F.pmod(at, F.lit(block)) >= block - reach,
                    F.array(F.struct(own.alias("n"), F.lit(True).alias("own")), F.struct((own + 1).alias("n"), F.lit(False).alias("own"))))
    copies = copies.otherwise(F.array(F.struct(own.alias("n"), F.lit(True).alias("own"))))
    return numbered.withColumn("_b", F.explode(copies))


def loss_spikes(numbered: DataFrame, trailing: int = 20, least: int = 10, sigmas: int = 3, unit: float = 1e4,
                block: int = BLOCK) -> DataFrame:
    """Steps whose loss lies more than ``sigmas`` sample deviations above the mean of the finite losses
    among the ``trailing`` steps before, given at least ``least`` of those. Losses are rounded to
    1/``unit``, so sums are whole numbers. A null or non-finite loss is never a spike."""
    loss = F.col("loss")
    finite = loss.isNotNull() & ~F.isnan(loss) & (F.abs(loss) < float("inf"))
    rows = _blocks(numbered, trailing, block).withColumn("_x", F.when(finite, F.round(loss * unit).cast("long")))
    w = Window.partitionBy("run_name", "_b.n").orderBy("step").rowsBetween(-trailing, -1)
    rows = rows.select("run_name", "step", "_x", F.col("_b.own").alias("_own"), F.count("_x").over(w).alias("_n"),
                       F.sum("_x").over(w).alias("_s"), F.sum(F.col("_x") * F.col("_x")).over(w).alias("_q"))
    n = F.col("_n")
    above = n * F.col("_x") - F.col("_s")
    spread = n * F.col("_q") - F.col("_s") * F.col("_s")
    squared = above.cast("double") * above.cast("double") * (n - 1)
    spike = (n >= least) & (above > 0) & (squared > spread.cast("double") * n * (sigmas * sigmas))
    return rows.where(F.col("_own") & spike).select(
        "run_name", "step", (F.col("_x") / unit).alias("loss"), n.alias("n_before"),
        (F.col("_s").cast("double") / n / unit).alias("mean_before"))


def stalls(numbered: DataFrame, gap_sec: int, block: int = BLOCK) -> DataFrame:
    """Steps after which a run stood still for more than ``gap_sec`` seconds."""
    w = Window.partitionBy("run_name", "_b.n").orderBy("step")
    # the first row of a block was the last of the one before, where the gap after it was not known yet
    gaps = _blocks(numbered, 1, block).select("run_name", "step", F.col("ts_us").alias("stall_start_us"),
                                              (F.lead("ts_us").over(w) - F.col("ts_us")).alias("_gap"))
    return gaps.where(F.col("_gap") > gap_sec * 1_000_000).select(
        "run_name", "step", "stall_start_us", (F.col("_gap").cast("double") / 1000000.0).alias("gap_sec"))


def lost_work(numbered: DataFrame, crashed: Column, saved: Column, block: int = BLOCK) -> DataFrame:
    """Per crash, the newest checkpoint at or before its step (0: none) and the steps lost. The latest
    save within a block comes from a window, that of earlier blocks from one row per run and block."""
    rows = numbered.select("run_name", "step", F.coalesce(crashed, F.lit(False)).alias("_crash"),
                           F.when(saved, F.col("step")).alias("_save"), F.floor((F.col("step") - 1) / block).alias("_b"))
    inside = Window.partitionBy("run_name", "_b").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("run_name").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("run_name", "_b").agg(F.max("_save").alias("_m"))
    carried = carried.select(F.col("run_name").alias("_r"), F.col("_b").alias("_rb"), F.max("_m").over(before).alias("_prior"))
    crashes = rows.withColumn("_here", F.max("_save").over(inside)).where("_crash")
    crashes = crashes.join(carried, crashes["run_name"].eqNullSafe(carried["_r"]) & (crashes["_b"] == carried["_rb"]), "left")
    kept = F.coalesce("_here", "_prior", F.lit(0))
    return crashes.select("run_name", F.col("step").alias("crash_step"), kept.alias("checkpoint_step"),
                          (F.col("step") - kept).alias("lost_steps"))


def token_cost(summary: DataFrame) -> DataFrame:
    """P10: dollars for a million trained tokens, null for a run without tokens or of unknown price."""
    return summary.select("run_name", "total_tokens", (F.try_divide(F.col("estimated_cost_usd"), F.col("total_tokens").cast("double")) * 1000000.0)
                          .alias("usd_per_million_tokens"))
