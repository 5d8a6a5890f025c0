"""Connected components of an edge table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each end of ``edges`` (a, b): root is the least node reachable.

    Each round hooks every node to the first, by hash, of itself and its neighbours, and goes on from there once more.
    Edges then join what their ends are hooked to, and those inside one are done, so a round reads the
    edges that are left and not all of them again. The first is by hash so that no order of the names makes long
    chains. Every round is written to the shared folder; nothing but whether edges are left comes to the driver.
    """
    edges = stage(edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while True:
        both = edges.union(edges.select("b", "a"))
        first = F.min(F.struct(F.xxhash64("b").alias("h"), "b")).alias("near")
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("b"))
        hooks = stage(both.groupBy("a").agg(first).select(F.col("a").alias("node"), F.least(own, "near")["b"].alias("to")), "hooks")
        up = hooks.select(F.col("node").alias("via"), F.col("to").alias("top"))
        rounds.append(hooks.join(up, F.col("to") == F.col("via")).select("node", F.col("top").alias("to")))
        edges = stage(relabelled(edges, rounds[-1].select("node", F.col("to").alias("root"))), "edges")
        if edges.isEmpty():
            break
    ends = rounds.pop()
    while rounds:
        later = ends.select(F.col("node").alias("via"), F.col("to").alias("top"))
        ends = rounds.pop().join(later, F.col("to") == F.col("via"), "left").select("node", F.coalesce("top", "to").alias("to"))
    ends = stage(ends, "ends")
    least = ends.groupBy("to").agg(F.min("node").alias("root"))
    return ends.join(least, "to").select("node", "root")


def relabelled(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The different ``edges`` (a, b) between what ``roots`` (node, root) make of their ends; an end without a root stays."""
    for end, other in (("a", "b"), ("b", "a")):
        edges = edges.join(roots, F.col(end) == F.col("node"), "left").select(F.coalesce("root", end).alias(end), other)
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def extended(known: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``components`` of all edges behind ``known`` (node, root) and of ``edges``; only those that join two roots are worked on."""
    if known is None:
        return stage(components(edges), "known")
    fresh = stage(relabelled(edges, known), "fresh")
    if fresh.isEmpty():
        return known
    more = stage(components(fresh), "more")
    moved = known.join(more.select(F.col("node").alias("via"), F.col("root").alias("top")), F.col("root") == F.col("via"), "left")
    new = more.join(known.select("node"), "node", "left_anti").select("node", "root")
    return stage(moved.select("node", F.coalesce("top", "root").alias("root")).union(new), "known")
