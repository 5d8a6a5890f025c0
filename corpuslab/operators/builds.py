"""Reproducibility (P9): where two builds of a dataset differ, by a hash tree over key ranges.

A range's digest is the exact sum of its rows' hashes (as in ``manifests.dataset_digest``), so a parent's digest is
the sum of its children's, rows need no order, and every level is a partial and a final aggregate. The tree
is descended from its root, and only into ranges whose digests differ; rows are compared in the last of them alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.session import stage

LEAF, FAN = 64, 16  # keys of a lowest range, and children of a range
_PARTS = [f"_s{i}" for i in range(5)]


def row_hash(cols: list[str]) -> Column:
    """SHA-256 of the columns, each written as its length in bytes, ``:`` and its text, null as ``-``."""
    text = [F.col(c).cast("string") for c in cols]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def leaf_digests(build: DataFrame, key: str, cols: list[str], leaf: int = LEAF) -> DataFrame:
    """(range, n, five sums): ``range`` is floor(key / leaf), null for rows without a key."""
    hashed = build.select(F.floor(F.col(key) / F.lit(leaf)).cast("long").alias("range"), row_hash([key, *cols]).alias("_h"))
    sums = [F.sum(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(28,0)")).cast("decimal(38,0)").alias(s) for i, s in enumerate(_PARTS)]
    return hashed.groupBy("range").agg(F.count(F.lit(1)).alias("n"), *sums)


def _odd(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ranges whose digests differ, or that one side lacks."""
    a, b = (d.select(F.col("range").alias(f"{s}r"), F.struct("n", *_PARTS).alias(f"{s}d")) for d, s in ((left, "a"), (right, "b")))
    both = a.join(b, F.col("ar").eqNullSafe(F.col("br")), "full")
    return both.where(~F.col("ad").eqNullSafe(F.col("bd"))).select(F.coalesce("ar", "br").alias("range")).distinct()


def _up(digests: DataFrame, fan: int) -> DataFrame:
    sums = [F.sum(s).cast("decimal(38,0)").alias(s) for s in _PARTS]
    return digests.groupBy(F.floor(F.col("range") / F.lit(fan)).cast("long").alias("range")).agg(F.sum("n").alias("n"), *sums)


def differing_ranges(left: DataFrame, right: DataFrame, key: str, cols: list[str], leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(range) of the lowest ranges in which two builds differ, found from the root down.

    Each level is written once; a level's ranges are compared only below a parent that differs. Nothing
    but the number of levels, from the greatest key, comes to the driver.
    """
    levels = [tuple(stage(leaf_digests(d, key, cols, leaf), "leaves") for d in (left, right))]
    span = levels[0][0].union(levels[0][1]).agg(F.max(F.abs("range"))).first()[0] or 0
    while span > 0:
        levels.append(tuple(stage(_up(d, fan), "ranges") for d in levels[-1]))
        span //= fan
    odd = _odd(*levels[-1])
    for pair in reversed(levels[:-1]):
        parents = stage(odd.select(F.col("range").alias("_p")), "odd")
        up = F.floor(F.col("range") / F.lit(fan)).cast("long")
        odd = _odd(*(d.join(parents, up.eqNullSafe(F.col("_p")), "left_semi") for d in pair))
    return stage(odd, "differing")


def diff_builds(left: DataFrame, right: DataFrame, key: str, cols: list[str], leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """One row a lowest range that differs: low, high (its keys), n_left, n_right (its rows), missing (keys
    only ``left`` has), added (only ``right``), changed (both, with other contents). Equal builds give none.

    A key that a build has more than once counts its rows as one content. Rows without a key are a range of
    their own, with null bounds. ``key`` is a whole number; other columns than ``cols`` are ignored.
    """
    ranges = differing_ranges(left, right, key, cols, leaf, fan)

    def rows(build: DataFrame, side: str) -> DataFrame:
        own = build.select(F.col(key).cast("long").alias("k"), F.floor(F.col(key) / F.lit(leaf)).cast("long").alias("r"), row_hash([key, *cols]).alias("h"))
        near = own.join(ranges, F.col("r").eqNullSafe(F.col("range")), "left_semi")
        # equal keys by their sorted different hashes and counts: as many as a key has different contents
        counted = near.groupBy("r", "k", "h").agg(F.count(F.lit(1)).alias("c"))
        return counted.groupBy("r", "k").agg(F.sum("c").alias(f"{side}_n"), F.sort_array(F.collect_list(F.struct("h", "c"))).alias(f"{side}_h"))

    a, b = rows(left, "a"), rows(right, "b").withColumnsRenamed({"r": "r2", "k": "k2"})
    both = a.join(b, F.col("r").eqNullSafe(F.col("r2")) & F.col("k").eqNullSafe(F.col("k2")), "full")
    count = lambda c: F.count_if(c).alias
    low = F.coalesce("r", "r2") * leaf
    return both.groupBy(low.alias("low"), (low + leaf - 1).alias("high")).agg(
        F.coalesce(F.sum("a_n"), F.lit(0)).alias("n_left"), F.coalesce(F.sum("b_n"), F.lit(0)).alias("n_right"),
        count(F.col("b_h").isNull())("missing"), count(F.col("a_h").isNull())("added"), count(F.col("a_h") != F.col("b_h"))("changed"))
