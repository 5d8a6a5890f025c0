"""Runs a stream over what its source holds now and gives its output as a table, in one go or as rows arrive."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuslab.session import checkpoint_root, read_table


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = read_table(spark, sf_dir, name).schema
    # a pattern, since the stream source takes a plain path for a folder, and a table may be one file
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Output and progress lie in the shared checkpoint folder; a restarted query goes on from there."""
    spark = stream.sparkSession
    root = f"{checkpoint_root(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    query = (stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/progress")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def slice_of(df: DataFrame, at: str, slices: int) -> Column:
    """0 to ``slices`` - 1: equal parts of the range of ``at`` (a long), ascending. Null: 0. Two numbers reach the driver."""
    low, high = df.agg(F.min(at), F.max(at)).first()
    if low is None:
        return F.lit(0)
    part = F.least(F.floor((F.col(at) - F.lit(low)) * slices / F.lit(high - low + 1)), F.lit(slices - 1))
    return F.when(F.col(at).isNull(), 0).otherwise(part).cast("int")


def run_as_arrived(df: DataFrame, arrival: str, arrivals: int, name: str, start: Callable[[DataFrame, str], StreamingQuery]) -> str:
    """The rows of ``df`` arrive in ``arrivals`` parts (column ``arrival``: 0, 1, ...). After each, ``start(stream, folder)``
    starts the query, which goes on from its progress in ``folder``, takes what is new, and ends: a job run on a schedule.
    Returns the folder, which is in the shared checkpoint folder."""
    spark = df.sparkSession
    root = f"{checkpoint_root(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(arrival).parquet(f"{root}/given")
    given = spark.read.schema(df.schema).parquet(f"{root}/given")
    schema = df.drop(arrival).schema
    for i in range(arrivals):
        given.where(F.col(arrival) == i).drop(arrival).write.mode("append").parquet(f"{root}/arrived")
        start(spark.readStream.schema(schema).parquet(f"{root}/arrived"), root).awaitTermination()
    return root
