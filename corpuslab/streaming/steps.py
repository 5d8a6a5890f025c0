"""Step metrics of training runs as they arrive (ST4), with steps of non-finite loss in quarantine.

Each micro-batch is one batch job: running sums by ``ordering.running_offsets``, which spreads a run of any size over
tasks, on top of the totals that the batches before left. It gives three tables under one folder, each batch in
``batch_id=<id>`` with overwrite, so that a batch run again after a failure replaces its own rows:

* ``steps``: the steps with a finite loss;
* ``quarantine``: the others, with the loss as it came;
* ``totals``: per run its first time, tokens and steps so far. A batch reads those of the batch before it.

Steps count in arrival order of batches, and by (ts_us, event_id) within one. A step in quarantine has been run, so its
tokens and its number count. A null loss is not finite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuslab.operators.ordering import running_offsets
from corpuslab.session import stage

COLUMNS = ["run_name", "event_id", "ts_us", "tokens", "loss"]
TOTALS = "run_name string, t0 long, tokens long, steps long"


def _totals(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    if batch_id < 0:
        return spark.createDataFrame([], TOTALS)
    return spark.read.schema(TOTALS).parquet(f"{folder}/totals/batch_id={batch_id}")


def write_batch(batch: DataFrame, batch_id: int, folder: str, log_every: int = 10) -> None:
    """One micro-batch of (run_name, event_id, ts_us, tokens, loss); other columns are ignored."""
    spark = batch.sparkSession
    rows = stage(batch.select(*COLUMNS), "steps")
    before = _totals(spark, folder, batch_id - 1).select("run_name", F.col("t0").alias("_t0"), F.col("tokens").alias("_tokens"), F.col("steps").alias("_steps"))
    new = rows.groupBy(F.col("run_name").alias("_run")).agg(F.min("ts_us").alias("t0"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("steps"))
    zero = F.lit(0).cast("long")
    totals = stage(before.join(new, before["run_name"].eqNullSafe(new["_run"]), "full").select(
        F.coalesce("run_name", "_run").alias("run_name"), F.coalesce("_t0", "t0").alias("t0"),
        (F.coalesce("_tokens", zero) + F.coalesce("tokens", zero)).alias("tokens"),
        (F.coalesce("_steps", zero) + F.coalesce("steps", zero)).alias("steps"),
        F.coalesce("_tokens", zero).alias("_tokens"), F.coalesce("_steps", zero).alias("_steps")), "totals")
    runs = totals.select(F.col("run_name").alias("_run"), "t0", "_tokens", "_steps")
    sums = running_offsets(rows, ["ts_us", "event_id"], ["tokens", F.lit(1)], ["_before", "_at"], group=["run_name"])
    joined = sums.join(runs, sums["run_name"].eqNullSafe(runs["_run"]), "left")
    processed = F.col("_tokens") + F.col("_before") + F.coalesce("tokens", zero)
    elapsed = (F.col("ts_us") - F.col("t0")).cast("double") / 1000000.0
    step = F.col("_steps") + F.col("_at") + 1
    finite = F.coalesce(~F.isnan("loss") & (F.abs("loss") != float("inf")), F.lit(False))
    metrics = stage(joined.select(
        "run_name", step.alias("step"), processed.alias("tokens_processed"), elapsed.alias("elapsed_sec"),
        F.try_divide(processed.cast("double"), elapsed).alias("tokens_per_sec"),
        (F.pmod(step, F.lit(log_every)) == 0).alias("logged"), "loss", finite.alias("_finite")), "step-metrics")
    for name, table in (("steps", metrics.where("_finite")), ("quarantine", metrics.where("not _finite"))):
        table.drop("_finite").write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={batch_id}")
    totals.drop("_tokens", "_steps").write.mode("overwrite").parquet(f"{folder}/totals/batch_id={batch_id}")


def step_metrics(steps: DataFrame, folder: str, checkpoint: str, log_every: int = 10) -> StreamingQuery:
    """Starts the query over the stream ``steps``; it ends when all that has arrived is written."""
    return (steps.writeStream.foreachBatch(lambda batch, i: write_batch(batch, i, folder, log_every))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
