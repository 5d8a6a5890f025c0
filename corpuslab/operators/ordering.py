"""Ordered running sums and ranks without a single-task window (W2, W7, W8 building block).

``running_offsets`` gives every row the sum of ``weight`` over the rows before it in ``order``
(within its group, if any). One plan at every size: Spark's own ``repartitionByRange`` on (group,
order) cuts the key space into balanced, contiguous ranges, so a group holding a third of all rows is
spread over many tasks; a vectorized pass over each range's sorted Arrow batches (``mapInArrow``)
gives the local sums; and the result is staged, so the range assignment stays fixed. Then only the
ranges' totals per group travel: a window over that small table gives each group's base, and the
non-zero bases are broadcast. Only a group that crosses a range boundary has one, so at most R-1 rows
remain: a proven bound. Null groups and null order keys are keys like any other, in Spark's order
(first ascending, last descending).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from corpuslab.session import stage


def _local_exclusive(weights: list[str], outs: list[str]):
    """Per-partition exclusive running sums over rows sorted by (group, order), on Arrow batches:
    the other columns pass through untouched (no pandas conversion, so NaN stays NaN)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        carry_key, carry = None, np.zeros(len(weights), dtype=np.int64)
        for rb in batches:
            if rb.num_rows == 0:
                continue
            names = rb.schema.names
            key = rb.column(names.index("_gk"))
            new_group = np.empty(len(key), dtype=bool)
            new_group[0] = key[0].as_py() != carry_key
            new_group[1:] = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
            single = not new_group[1:].any()
            gid = np.cumsum(new_group)
            continues = not new_group[0]
            extra = []
            for j, wname in enumerate(weights):
                w = pc.fill_null(rb.column(names.index(wname)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                inclusive = np.cumsum(w) if single else pd.Series(w).groupby(gid).cumsum().to_numpy()
                local = inclusive - w
                if continues:
                    local[gid == gid[0]] += carry[j]
                carry[j] = int(inclusive[-1]) + (int(carry[j]) if continues and gid[-1] == gid[0] else 0)
                extra.append(pa.array(local, type=pa.int64()))
            carry_key = key[-1].as_py()
            keep = [i for i, n in enumerate(names) if n != "_gk"]
            yield pa.RecordBatch.from_arrays([rb.column(i) for i in keep] + extra,
                                             names=[names[i] for i in keep] + list(outs))
    return run


def running_offsets(df: DataFrame, order: Sequence, weight, out,
                    group: Sequence[str] = (), n_parts: int | None = None, persist_input: bool = False) -> DataFrame:
    """``df`` plus ``out`` = exclusive running sum of ``weight`` in ``order`` within ``group``.

    ``weight``/``out`` may be lists to compute several sums in the same pass; weights may be negative,
    and null counts as 0. ``order`` must be unique within a group (add an id as the last key); a key is
    a column name or a ``(name, descending)`` pair. ``persist_input`` writes an expensive input (an
    aggregate, a regex count) once, so the range partitioner's sample and the exchange read a narrow
    copy instead of recomputing it.
    """
    n_parts = n_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = list(group)
    weights = list(weight) if isinstance(weight, (list, tuple)) else [weight]
    outs = list(out) if isinstance(out, (list, tuple)) else [out]
    wnames = [f"_w{i}" for i in range(len(weights))]
    lnames = [f"_l{i}" for i in range(len(weights))]
    bnames = [f"_b{i}" for i in range(len(weights))]
    base = df
    for name, w in zip(wnames, weights):
        base = base.withColumn(name, (F.col(w) if isinstance(w, str) else w).cast("long"))
    if persist_input:
        base = stage(base, "ordered-input")
    keys = [F.col(g) for g in group]
    keys += [F.col(k) if isinstance(k, str) else (F.col(k[0]).desc() if k[1] else F.col(k[0])) for k in order]
    ranged = (
        base.repartitionByRange(n_parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_gk", F.to_json(F.struct(*[F.col(g) for g in group])) if group else F.lit(""))
    )
    schema = ST.StructType(
        [f for f in ranged.schema.fields if f.name != "_gk"] + [ST.StructField(n, ST.LongType(), False) for n in lnames]
    )
    local = stage(ranged.mapInArrow(_local_exclusive(wnames, lnames), schema), "offsets")
    totals = local.groupBy("_part", *group).agg(*[F.sum(w).alias(f"_t{i}") for i, w in enumerate(wnames)])
    prior = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("_part").alias("_bp"), *[F.col(g).alias(f"_bg{i}") for i, g in enumerate(group)],
                          *[F.coalesce(F.sum(f"_t{i}").over(prior), F.lit(0)).alias(b) for i, b in enumerate(bnames)])
    # only a group crossing a range boundary has a base: at most (ranges - 1) rows survive
    nonzero = F.lit(False)
    for b in bnames:
        nonzero = nonzero | (F.col(b) != 0)
    same = local["_part"] == F.col("_bp")
    for i, g in enumerate(group):
        same = same & local[g].eqNullSafe(F.col(f"_bg{i}"))
    joined = local.join(F.broadcast(bases.where(nonzero)), same, "left")
    for o, lname, b in zip(outs, lnames, bnames):
        joined = joined.withColumn(o, F.col(lname) + F.coalesce(F.col(b), F.lit(0)))
    return joined.drop("_part", "_bp", *[f"_bg{i}" for i in range(len(group))], *wnames, *lnames, *bnames)


def dense_positions(df: DataFrame, order: Sequence, out: str, group: Sequence[str] = (),
                    n_parts: int | None = None, persist_input: bool = False) -> DataFrame:
    """0-based row number in ``order`` (within ``group``); the distributed form of
    ``row_number() - 1`` over a whole table."""
    return running_offsets(df, order, F.lit(1), out, group, n_parts, persist_input)
