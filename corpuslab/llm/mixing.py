"""Mixing sources to target weights by hierarchical budgeting.

The token budget runs down a domain-language-source tree. At each node it is split by weight among
the children, none getting more than its subtree can give (its tokens times ``max_epochs``); what a
child cannot take goes to its siblings, and only what all siblings cannot take reaches the parent's
siblings. A leaf takes whole epochs of its documents and, for the rest of its budget, the token
prefix of one more epoch in a seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import free_name, join_hot
from corpuslab.session import stage

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS, SEED = 4, 17
NONE = "(none)"


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _weight(levels: tuple[str, ...], weights: dict[str, int]) -> Column:
    """Weight of a node by its path ``domain/lang/source`` or any head of it; 1 if not given. In a path, ``/`` and
    ``\\`` inside a name are written ``\\/`` and ``\\\\``."""
    if not weights:
        return F.lit(1).cast("decimal(12,0)")
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    path = F.concat_ws("/", *(F.replace(F.replace(F.col(x), F.lit("\\"), F.lit("\\\\")), F.lit("/"), F.lit("\\/")) for x in levels))
    return F.coalesce(F.try_element_at(table, path), F.lit(1)).cast("decimal(12,0)")


def _split(nodes: DataFrame, parent: tuple[str, ...], level: str) -> DataFrame:
    """Budget of each node from its parent's ``budget``: min(capacity, rate * weight).

    In order of capacity per weight, the filled children are a head of the list. A child is filled if
    an even rate over it and all later ones gives it at least its capacity; the first one that isn't
    fixes the rate. All in whole tokens, so fewer tokens than children stay unspent.
    """
    order = Window.partitionBy(*parent).orderBy((F.col("capacity").cast("double") / F.col("weight").cast("double")), level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        nodes.withColumn("left_over", (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))).cast("decimal(20,0)"))
        .withColumn("weights", F.sum("weight").over(onward).cast("decimal(16,0)"))
        .withColumn("filled", F.col("capacity") * F.col("weights") <= F.col("left_over") * F.col("weight"))
        .withColumn("rate", F.first(F.when(~F.col("filled"), F.struct("left_over", "weights")), ignorenulls=True).over(whole))
        .withColumn("budget", F.when(F.col("filled"), F.col("capacity")).otherwise(
            F.least(F.col("capacity"), F.expr("(rate.left_over * weight) div rate.weights").cast("decimal(20,0)"))))
        .drop("left_over", "weights", "filled", "rate")
    )


def leaf_budgets(leaves: DataFrame, weights: dict[str, int], budget: int | None, max_epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens, n) with each leaf's budget. The tree has as many nodes as the corpus has
    sources, languages and domains; it stays in Spark."""
    tree = leaves.withColumn("capacity", (F.col("tokens") * max_epochs).cast("decimal(20,0)"))
    for i in range(len(LEVELS)):
        tree = tree.withColumn(f"weight_{i}", _weight(LEVELS[: i + 1], weights))
    for i, level in enumerate(LEVELS):
        here, parent = LEVELS[: i + 1], LEVELS[:i]
        nodes = tree.groupBy(*here).agg(F.sum("capacity").cast("decimal(20,0)").alias("capacity"), F.sum("tokens").alias("tokens"),
                                        F.first(f"weight_{i}").alias("weight"))
        if parent:
            nodes = nodes.join(leaf.select(*parent, "budget"), list(parent))
        else:
            want = F.sum("tokens").over(Window.partitionBy()) if budget is None else F.lit(budget)
            nodes = nodes.withColumn("budget", F.least(want, F.sum("capacity").over(Window.partitionBy())).cast("decimal(20,0)"))
        leaf = _split(nodes, parent, level)
    return leaf.join(leaves.select(*LEVELS, "n"), list(LEVELS)).select(*LEVELS, "n", "tokens", F.col("budget").cast("long").alias("budget"))


def plan_mixture(df: DataFrame, domain: Column, weights: dict[str, int] | None = None, budget: int | None = None,
                 max_epochs: int = MAX_EPOCHS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, domain, lang, source, n_tokens, full_epochs, part_tokens, taken_tokens,
    and the columns ``keep``, by which rows of one doc_id and n_tokens are ordered.

    ``weights`` maps paths (``web``, ``web/en``, ``web/en/src0``) to whole numbers, 1 if not given;
    ``budget`` is in tokens (words; default: as many as there are). A document is taken ``full_epochs``
    times, and ``part_tokens`` more tokens of it stand in the leaf's prefix of one more epoch, where the
    document across the budget is cut. The order of epoch e is by the MD5 of ``seed:e:doc_id``, then
    doc_id and n_tokens. Null domain, lang or source count as ``(none)``; empty and null texts have no
    tokens, and are taken only by whole epochs. A null doc_id orders as the text ``null``. Repeated rows
    are rows of their own. An empty table gives an empty result; other columns are ignored.

    The prefix sums run in two steps, over order buckets and within each, with about as many buckets
    as rows per bucket, so a leaf with a third of all rows is spread over many tasks.
    """
    named = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for c, n in zip((domain, F.col("lang"), F.col("source")), LEVELS)]
    docs = stage(df.select(F.col("doc_id"), *keep, *named, count_words(F.col("text")).alias("n_tokens")), "mixing")
    rows = docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    leaves = stage(leaf_budgets(rows, weights or {}, budget, max_epochs)
                   .withColumn("full", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(1)))
                   .withColumn("part", F.when(F.col("tokens") > 0, F.col("budget") - F.col("full") * F.col("tokens")).otherwise(F.lit(0)))
                   .select(F.struct(*LEVELS).alias("leaf"), "n", "full", "part"), "leaves")
    n, digits = docs.count(), 1
    while 256**digits < n:  # 16 ** digits buckets: about the square root of the rows
        digits += 1
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    keyed = join_hot(docs.withColumn("leaf", F.struct(*LEVELS)), leaves, "leaf", "n", "doc_id").drop("leaf")
    keyed = keyed.withColumn("key", key).withColumn("bucket", F.substring("key", 1, digits))
    parts = keyed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("bucket_tokens"))
    ahead = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("bucket_tokens").over(ahead), F.lit(0))).drop("bucket_tokens")
    inside = Window.partitionBy(*LEVELS, "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "n_tokens", *keep).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    placed = keyed.join(parts, [*LEVELS, "bucket"]).withColumn("start", start)
    part = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("part") - F.col("start")))
    return placed.select("doc_id", *LEVELS, "n_tokens", F.col("full").cast("long").alias("full_epochs"), part.cast("long").alias("part_tokens"),
                         (F.col("full") * F.col("n_tokens") + part).cast("long").alias("taken_tokens"), *keep)


def mix(df: DataFrame, plan: DataFrame, key: str = "doc_id") -> DataFrame:
    """``df`` as often as ``plan`` takes each document, the last copy cut after its ``part_tokens``.

    Columns and their names are those of ``df``; ``n_chars``, if there is one, follows the cut text.
    Rows find their plan by ``key``; one that ``plan`` has more than once is taken as its first row says.
    """
    own, take, cut = (free_name(df, n) for n in ("_id", "_take", "_cut"))
    takes = plan.where("full_epochs > 0 or part_tokens > 0").groupBy(F.col(key).alias(own)).agg(
        F.min(F.struct("n_tokens", "full_epochs", "part_tokens")).alias(take))
    n, full, part = (F.col(take)[c] for c in ("n_tokens", "full_epochs", "part_tokens"))
    whole = F.lit(-1).cast("long")
    last = F.when(part > 0, F.array(F.when(part < n, part).otherwise(whole))).otherwise(F.array().cast("array<bigint>"))
    out = df.join(takes, F.col(key).eqNullSafe(F.col(own)))
    out = out.withColumn(cut, F.explode(F.concat(F.array_repeat(whole, full.cast("int")), last)))
    words = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    head = F.array_join(F.slice(words, 1, F.greatest(F.col(cut), F.lit(0)).cast("int")), "")
    out = out.withColumn("text", F.when(F.col(cut) >= 0, head).otherwise(F.col("text")))
    if "n_chars" in df.columns:
        kind = df.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(cut) >= 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*df.columns)
